"""The near-copy stage beside the brute-force Jaccard similarity of five-word shingles."""

import itertools
import random

import corpus_pipeline
from tallyspan.llm import near_copies, simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_kept(rows):
    sets = [(d, plain_shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted({find(d) for d in root})


def corpus(seed):
    pick = random.Random(seed)
    text = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    line, rows = text(30), []
    for n in (1, 4, 5, 7, 8, 13, 20, 27, 28, 60, 200):
        for _ in range(3):
            base = text(n)
            rows += [base, base + ["more"], base[1:], ["other", *base[1:]], [*base[:-1], "other"]]
            for edits in (1, 2, 4, 8, 12):
                new = list(base)
                for _ in range(edits):
                    new[pick.randrange(n)] = f"new{pick.randrange(10**6)}"
                rows.append(new)
    large = text(90)
    for _ in range(80):
        new = list(large)
        for _ in range(pick.randint(1, 3)):
            new[pick.randrange(90)] = f"new{pick.randrange(10**6)}"
        rows.append(new)
    rows += [line + text(pick.randint(3, 40)) for _ in range(60)] + [["a"] * 5, ["a"] * 9, [], []]
    pick.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS", 500)
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == plain_kept(rows)


def test_short_near_copies_and_rows_without_id(spark):
    base = " ".join(f"w{i}" for i in range(20))
    rows = [(1, base), (2, base + " more"), (3, base.upper()), (4, None), (5, ""), (None, base + " more"), (None, "one two three four five six"), (None, "One two three four five  six")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["doc_id"] != 4) == [("1", base), ("None", "One two three four five  six")]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stage_compares_texts_of_near_fingerprints(spark, monkeypatch):
    taken, whole = [], near_copies.near_copies

    def spied(docs, linked):
        taken.append(sorted((r["a"], r["b"]) for r in linked.collect()))
        return whole(docs, linked)

    monkeypatch.setattr(near_copies, "near_copies", spied)
    rows = corpus(2)[:150]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == plain_kept(rows)
    prints = {near_copies._node(near_copies.byte_words(t)): simhash.fingerprint(t, 5) for _, t in rows}
    near = [(max(p), min(p)) for p in itertools.combinations(prints, 2) if ((prints[p[0]] ^ prints[p[1]]) % 2**64).bit_count() <= 4]
    assert near and taken == [sorted(near)]


def test_large_group_of_near_copies_meets_one_text(spark, monkeypatch):
    pick, met, verified = random.Random(3), [], near_copies._verified

    def spied(pairs, *rest):
        met.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", spied)
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    base = [f"w{i}" for i in range(150)]
    rows = [base]
    for i in range(400):
        new = list(base)
        for k in range(pick.randint(1, 6)):
            new[pick.randrange(150)] = f"new{i}-{k}"
        rows.append(new)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == plain_kept(rows)
    assert sum(met) < 10 * len(rows)
