"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain computations."""

import hashlib
import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspan.llm import chat, decontaminate, language, licenses, mixing, simhash, syncmers
from tallyspan.llm.common import components

#: Columns whose names the operators use inside.
CLASHING = ("fp", "cell", "component_id", "key", "range", "size", "weight", "taken", "a", "b", "n", "value", "root", "target", "epochs", "own", "ids")


def documents(spark, rows):
    """Documents (doc_id, text, lang, source), with columns beside them that clash."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def words(seed, n, prefix=""):
    pick = random.Random(seed)
    return " ".join(prefix + "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 7))) for _ in range(n))


def edited(text, seed, n):
    pick, out = random.Random(seed), text.split()
    for _ in range(n):
        out[pick.randrange(len(out))] = f"new{pick.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    base = [words(i, 30 + 13 * i) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(3)] + [(200 + i, edited(base[11], i, 1), "en", None) for i in range(40)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", "s1"), (303, "one two", "en", "s1"), (304, "ONE TWO", "en", "s1"),
             (305, words(99, 20_000), "en", "s2"), (5, base[5], "en", "s2"), (5, base[5], "en", "s2"), (None, base[2], "en", "s1"), (None, words(77, 50), "en", "s1")]
    return rows


# --- fingerprints and groups


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def test_near_duplicates_match_all_pairs(spark, corpus):
    found = simhash.near_duplicates(documents(spark, corpus)).collect()
    prints = [(d, plain_fingerprint(t, 4)) for d, t, _, _ in corpus]
    groups = plain_groups({p for _, p in prints}, 4)
    least = {}
    for d, p in prints:
        if d is not None:
            least[groups[p]] = min(d, least.get(groups[p], d))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in found) == sorted((str(d), p, least[groups[p]] if groups[p] in least else None) for d, p in prints) or {
        (r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found} == {(d, p, least.get(groups[p])) for d, p in prints}
    assert len(found) == len(corpus)


@pytest.mark.parametrize("distance", (4, 6))
def test_links_join_what_all_pairs_join(spark, distance, monkeypatch):
    pick = random.Random(3)
    values = {pick.getrandbits(64) for _ in range(300)}
    centre = pick.getrandbits(64)
    for _ in range(400):
        near = centre
        for _ in range(pick.randint(0, 9)):
            near ^= 1 << pick.randrange(64)
        values.add(near)
    values |= {v ^ 1 << pick.randrange(64) for v in list(values)[:150]} | {0, 1, 2**64 - 1, 2**63}
    monkeypatch.setattr(simhash, "BLOCK", 50)
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    rows = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp bigint").select(F.col("fp").alias("node"), "fp", F.lit(0).cast("bigint").alias("also"))
    found = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(rows, distance)).collect()}
    plain = plain_groups(values, distance)
    signed = {v: min((w for w in values if plain[w] == plain[v]), key=lambda w: w - 2**64 if w >> 63 else w) for v in values}
    assert {v: found.get(v, v) for v in values} == signed


def test_keep_one_leaves_one_row_of_each_group(spark, corpus):
    docs = documents(spark, corpus)
    kept = simhash.keep_one(docs, simhash.Settings())
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    groups = {(r["root"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert ids == sorted(str(c) for c in groups.values())


def test_short_texts_are_copies_only_when_equal(spark):
    rows = [(i, " ".join(f"w{i}{j}" for j in range(6)), "en", "s") for i in range(400)] + [(1000, "w00 w01 w02 w03 w04 w05", "en", "s"), (1001, "W00 w01\n w02 w03 w04 w05", "en", "s")]
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()) == list(range(400))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 300), (50, 49)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


# --- closed syncmers


def test_edit_trial_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(syncmers, "STRETCH", 5)
    found = syncmers.edit_trial(documents(spark, corpus)).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = []
    for i, (d, text, _, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.append((str(d), len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(expected)
    by_text = {}
    texts = {d: t or "" for d, t, _, _ in corpus}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"]) if r["doc_id"] is not None else None
    assert all(len(x) == 1 for x in by_text.values())
    long_texts = [r for r in found if r["n_chars"] > 500 and r["doc_id"] is not None and r["doc_id"] < 100]
    assert min(r["near_edited"] for r in long_texts) > 0.1


def test_anchors_are_closed_syncmers(spark):
    text = words(5, 80)
    row = syncmers.with_anchors(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "text", "x").select("x.*").first()
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    signed = lambda v: v - 2**64 if v >> 63 else v
    chain = lambda *values: signed(_chained(values))
    inner = [chain(signed(h[i]), signed(h[i + 1])) for i in range(len(h) - 1)]
    at = [i for i in range(len(h) - syncmers.K + 1) if min(inner[i:i + syncmers.INNER]) in (inner[i], inner[i + syncmers.INNER - 1])]
    assert (row["hashes"], row["places"]) == ([chain(inner[i], inner[i + 2], inner[i + 4]) for i in at], at)


def _chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed


def test_likeness_of_equal_and_shifted_texts(spark):
    a = words(1, 300)
    rows = spark.createDataFrame([(1, a, a), (2, a, "some words before " + a), (3, a, words(2, 300)), (4, "", None), (5, "", "x"), (6, "x y", "x y")], "doc_id bigint, p string, q string")
    for text, x in ("p", "x"), ("q", "y"):
        rows = syncmers.with_links(syncmers.with_anchors(rows, text, f"{x}_anchors"), f"{x}_anchors", x)
    near = {r["doc_id"]: r["near"] for r in rows.select("doc_id", syncmers.likeness("x", "y").alias("near")).collect()}
    assert near[1] == near[4] == near[6] == 1 and near[2] > 0.9 and near[3] == near[5] == 0


def test_an_inserted_word_breaks_only_the_links_around_it(spark):
    a = words(1, 400).split()
    rows = spark.createDataFrame([(" ".join(a), " ".join([*a[:200], "inserted", *a[200:]]))], "p string, q string")
    for text, x in ("p", "x"), ("q", "y"):
        rows = syncmers.with_links(syncmers.with_anchors(rows, text, f"{x}_anchors"), f"{x}_anchors", x)
    assert rows.select(syncmers.likeness("x", "y")).first()[0] > 0.9


def test_passages_of_long_texts_are_found_where_they_stand(spark):
    """Two texts of 10,000 words share 50 words at different places; plain comparison says how far the stretch may reach."""
    shared = words(3, 50)
    a = " ".join([words(1, 4000), shared, words(2, 6000)])
    b = " ".join([words(4, 7000), shared, words(5, 3000)])
    docs = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "x " * 3000), (5, ("x " * 2000))], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 5), (1, None), (1, 9)], "a bigint, b bigint")
    found = syncmers.passages(docs, pairs).collect()
    of = lambda x, y: [r for r in found if (r["a"], r["b"]) == (x, y)]
    assert not of(1, 3) and not of(1, 9) and of(4, 5)
    u, v = a.split(), b.split()
    for r in of(1, 2):
        assert u[r["place_a"]:r["place_a"] + r["n_words"]] == v[r["place_b"]:r["place_b"] + r["n_words"]]
    best = max(of(1, 2), key=lambda r: r["n_words"])
    assert best["n_words"] > 30 and best["place_b"] - best["place_a"] == 3000
    assert syncmers.passages(docs.limit(0), pairs).count() == 0


# --- mixing


def test_mix_meets_targets_and_repeats(spark, corpus):
    docs = documents(spark, corpus)
    weights = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 0.0), (3, None), (None, 5.0), (999, 1.0)], "doc_id bigint, weight double")
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n), weights).select("doc_id", "size", "taken", "target", "source", "source_size").collect()), key=str) for n in (1, 5))
    assert first == again and len(first) == len(corpus)
    sizes = sum(r[1] for r in first)
    assert sizes == sum(len((t or "").split()) for _, t, _, _ in corpus)
    for source in {r[4] for r in first}:
        own = [r for r in first if r[4] == source]
        assert sum(r[2] for r in own) == pytest.approx(own[0][3], abs=1)
        assert all(0 <= r[2] <= 2 * r[1] for r in own) and own[0][3] <= 2 * own[0][5]
    assert sum({r[4]: r[3] for r in first}.values()) == pytest.approx(1.5 * sizes, abs=1e-3)


def test_targets_share_out_what_is_over(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 100, 1), (None, 50, 1)], "source string, source_size bigint, n bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert found["a"] == 20 and found["c"] == 200 and found[None] == 100 and found["b"] == pytest.approx(1740 - 320)


# --- chat


def test_chats_round_trip(spark):
    odd = "a\\b</s><</SYS>>[INST]\\<s><|im_end|><|im_start|>x\n</\\s>[/INST]\\\\"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 5, "assistant", "late"), (2, 3, "user", None), (2, None, None, "first"), (3, 0, "us\ner\\x;", "t"), (3, 0, "us\ner\\x;", "t"),
             (None, 1, "user", "q"), (None, 2, "assistant", ""), (4, 0, "user", "q"), (4, 1, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1)).withColumn("loss", F.lit("clash"))
    segments = chat.format_chats(df)
    found = {r["conv_id"]: r for r in chat.read_chats(segments).collect()}
    for key in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        learned = "".join(t or "" for _, _, r, t in own if r == "assistant")
        row = found[key]
        assert row["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_turns"] == len(own)
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and row["loss_chars"] == len(learned)
    assert {k: r["valid"] for k, r in found.items()} == {1: True, 2: False, 3: False, None: True, 4: True}
    inside = [r["text"] for r in segments.filter("part = 1").collect()]
    assert not any(c in t for t in inside for c in chat.CONTROL_STRINGS)
    with pytest.raises(ValueError):
        chat.Template(opening="")


# --- language


def test_mixtures_and_rest(spark):
    german, english = ("der die das und nicht ein eine schon geht haus " * 8).split(), ("the and with this that for are was have house " * 8).split()
    pick = random.Random(0)
    text = lambda w, n: " ".join(pick.choice(w) for _ in range(n))
    training = spark.createDataFrame([(text(german, 60), "de") for _ in range(20)] + [(text(english, 60), "en") for _ in range(20)] + [("lost", None), (None, "en")], "text string, lang string")
    docs = documents(spark, [(1, text(german, 30), "en", None), (2, text(english, 30), None, None), (3, text(german, 60) + " " + text(english, 20), None, None), (4, None, "de", None),
                             (5, "123 !!", "de", None), (None, text(english, 5).upper(), None, None), (7, text(german, 50_000), None, None), (2, "haus", None, None)])
    found = language.identify(docs, training).collect()
    assert len(found) == 8
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] != 2}
    assert [by_id[k]["lang_pred"] for k in (1, 3, 4, 5, None, 7)] == ["de", "de", "und", "und", "en", "de"]
    assert by_id[3]["proportions"]["en"] == pytest.approx(0.25, abs=0.06) and set(by_id[1]["proportions"]) == {"de"}
    assert {r["lang_pred"] for r in language.identify(docs, training.limit(0)).collect()} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "2", "3", "None", "7"])


# --- licences


def test_licences_against_plain_search(spark):
    rows = [(1, "Released under the MIT License.", None, None), (2, "Licensed under the Apache-License,\nVersion 2.0; under the mit license", None, None), (3, "mit der Katze under license the", None, None),
            (4, "This work is licensed under the GNU General Public License, version 3.", None, None), (5, None, None, None), (6, "", None, None), (None, "cc BY-nc cc by nc", None, None),
            (8, words(1, 30_000) + " CC BY NC " + words(2, 10), None, None), (9, "gnu general public license", None, None), (1, "Released under the MIT License.", None, None), (10, "ünder the mit license über", None, None)]
    found = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    got = {k: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for k, r in found.items()}
    assert got == {1: (1, 1, 1, "mit", "mit"), 2: (2, 3, 8, "apache-2,mit", "apache-2,mit"), 3: (0, None, None, "", ""), 4: (0, None, None, "", "gpl-3"), 5: (0, None, None, "", ""), 6: (0, None, None, "", ""),
                   None: (2, 0, 3, "cc-by-nc", "cc-by-nc"), 8: (1, 30_000, 30_000, "cc-by-nc", "cc-by-nc"), 9: (0, None, None, "", ""), 10: (0, None, None, "", "")}
    assert found[8]["n_words"] == 30_013 and found[4]["score"] == 1 and found[3]["score"] == 0 and licenses.scan(documents(spark, rows)).count() == len(rows)


# --- decontamination


def test_leaks_word_for_word_and_in_other_words(spark):
    items = [(i, words(1000 + i, 30 + i, "q") + ". " + words(2000 + i, 8, "q") + ".") for i in range(6)] + [(50, None), (51, ""), (52, "a b"), (0, words(1000, 30, "q") + ".")]
    clean = [(i, words(i, 200), "en", "s") for i in range(40)]
    second = items[1][1].split()
    rewritten = " ".join(w if i % 6 else f"other{i}" for i, w in enumerate(second))
    leaks = [(100, words(1, 90) + " " + items[0][1] + " " + words(2, 33), "en", "s"), (101, words(3, 5) + " " + rewritten, "en", "s"), (102, items[2][1].upper(), "en", "s"), (102, items[2][1].upper(), "en", "s"),
             (None, items[3][1], "en", "s"), (103, words(5, 40_000) + " " + items[4][1], "en", "s"), (104, None, "en", "s"), (105, "", "en", "s"), (106, " ".join(items[5][1].split()[:9]) + " " + words(9, 50), "en", "s")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("overlap", F.lit(1))
    docs = documents(spark, clean + leaks)
    found = decontaminate.find_leaks(docs, benchmark)
    assert sorted({(str(r["doc_id"]), r["item_id"]) for r in found.collect()}) == sorted([("100", 0), ("101", 1), ("102", 2), ("None", 3), ("103", 4)])
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 104, 105, 106]
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_longest_common_subsequence():
    pick = random.Random(1)
    for _ in range(50):
        a, b = ([pick.randrange(6) for _ in range(pick.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        places = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        assert decontaminate.common_length((len(a), places), b) == table[-1][-1]


# --- empty tables


def test_empty_documents(spark):
    docs = documents(spark, [])
    benchmark = spark.createDataFrame([(1, words(1, 20))], "item_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == simhash.keep_one(docs).count() == syncmers.edit_trial(docs).count() == mixing.mix(docs).count() == 0
    assert language.identify(docs, language.labelled(docs)).count() == licenses.scan(docs).count() == decontaminate.find_leaks(docs, benchmark).count() == 0
    assert language.keep_identified(docs).count() == decontaminate.drop_leaks(docs, benchmark).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_chats(chat.format_chats(turns)).count() == 0
