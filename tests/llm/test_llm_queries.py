"""The registered queries on the smallest tables: beside their SQL, and the pipeline beside a brute-force version of its stages."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyspan.llm import decontaminate
from tallyspan.llm.oracles import llm_sql
from tallyspan.llm.queries import llm_queries
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = llm_queries()[name](spark, FOLDER)
    result = con.execute(llm_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], columns, result.fetchall()) is None


def test_all_are_registered():
    found = entry.queries()
    assert set(llm_queries()) | {"pipeline"} <= set(found) and set(llm_sql()) <= set(found)
    assert [name.split("_")[0] for name in llm_queries()] == [f"op{n}" for n in range(1, 14)]


def test_language_is_right_on_held_out_texts(spark, con):
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = [r for r in llm_queries()["op3_language"](spark, FOLDER).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in found) >= 0.97 * len(found)


def test_leaks_are_those_that_share_eight_words(spark, con):
    places = {}
    for item, text in con.execute("SELECT * FROM benchmark").fetchall():
        w = decontaminate.words(text)
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i:i + 8]), set()).add(item)
    expected = set()
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        w = decontaminate.words(text)
        expected |= {(doc, item) for i in range(len(w) - 7) for item in places.get(tuple(w[i:i + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in llm_queries()["op1_decontaminate"](spark, FOLDER).collect()} == expected and expected


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def _alike(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def test_pipeline_stages_take_effect(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    sets = {d: _shingles(t) for d, t in texts.items()}
    groups = {}
    for d in sorted(texts):
        near = {groups[e] for e in groups if _alike(sets[d], sets[e])}
        root = min(near, default=d)
        groups = {e: root if g in near else g for e, g in groups.items()} | {d: root}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert set(rows) == set(groups.values()) - leaks
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(texts[d].encode().split()) for d, r in rows.items())
