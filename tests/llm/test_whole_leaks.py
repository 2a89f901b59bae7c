"""Leaks beside a plain search of every window: nothing that meets the rule may be lost on the way to the word check."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspan.llm import decontaminate
from tallyspan.llm.decontaminate import Settings, words


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def plain_leaks(docs, items, s):
    found = set()
    for item, text in items:
        w, answer = words(text), words(text.split(". ")[-1])
        n = (math.ceil(len(w) / s.cell) + 1) * s.cell
        for doc, t in docs:
            ws = words(t)
            for i in range(0, len(ws), s.cell):
                window = ws[i:i + n]
                kept = subsequence(w, window)
                if kept / len(w) >= s.overlap and kept >= min(s.least_words, len(w)) and (kept / len(w) >= s.verbatim or subsequence(answer, window) / len(answer) >= s.answer):
                    found.add((doc, item))
    return found


def planted(seed):
    """Items of common words with one or two rare ones, and texts that hold them whole or with the rare words changed, among other items' rare words."""
    pick = random.Random(seed)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(120)]
    items = []
    for i in range(24):
        n = (5, 6, 17, 30)[i % 4]
        own = [pick.choice(common) for _ in range(n)]
        for at in pick.sample(range(n), 2):
            own[at] = rare[2 * i + at % 2]
        items.append((i, " ".join(own[:n - 3]) + ". " + " ".join(own[n - 3:])))
    items += [(100 + i, " ".join(rare[50 + 3 * i:53 + 3 * i] + [rare[50 + 3 * i], rare[51 + 3 * i]])) for i in range(20)]
    filler = lambda n: " ".join(pick.choice(common) for _ in range(n))
    docs = [(i, filler(150)) for i in range(60)]
    for i, text in items[:24]:
        w = text.split()
        docs.append((1000 + i, filler(21) + " " + " ".join(rare[60:80]) + " " + text + " " + " ".join(rare[80:100]) + " " + filler(9)))
        changed = [f"other{x}" if x.startswith("r") else x for x in w]
        docs.append((2000 + i, filler(pick.randrange(30)) + " " + " ".join(changed) + " " + filler(40)))
        lost = set(pick.sample(range(len(w) - 3), round(0.35 * len(w)))) if len(w) > 10 else set()
        docs.append((3000 + i, filler(pick.randrange(30)) + " " + " ".join(f"new{j}" if j in lost else x for j, x in enumerate(w)) + " " + filler(40)))
    return docs, items


def test_leaks_match_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 500, raising=False)
    docs, items = planted(1)
    expected = plain_leaks(docs, items, Settings())
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_leaks(frame, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert len({d for d, _ in expected}) >= 50 and all(-1.001 <= r["cosine"] <= 1.001 for r in found)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(frame, benchmark).select(F.col("doc_id")).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_every_window_with_enough_terms_is_counted(monkeypatch):
    docs, items = planted(2)
    for probes in (1, 4, 50):
        monkeypatch.setattr(decontaminate, "PROBES", probes)
        index = decontaminate.Index(items, Settings())
        index.weigh(np.random.default_rng(0).integers(1, 50, len(index.terms)), 1000)
        index.project(np.eye(index.columns))
        ids = [index.ids(words(t)) for _, t in docs]
        found = {(docs[d][0], index.items[k].item_id) for d, k in decontaminate._confirmed(ids, index)}
        assert found == plain_leaks(docs, items, Settings())
