"""Byte-pair encoding, collocations and conversation repair beside plain versions, with nulls, ties, empty and odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyspan.llm import bpe, collocations, conversation_repair


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(vocabulary.pieces)}, special_tokens={})


WORDS = ["", None, " ", "a", "<|endoftext|>", "don't we'll 1234567 x²", "tab\there \r\n\n  end  ", "日本語のテキスト", "é" * 90, "ab" * 300, "a" * 2000, "=-" * 100 + "==", "\x00\x7f", "𝄞🙂‍↔️"]


def _texts():
    r = random.Random(3)
    return WORDS + ["".join(r.choice("aeinrst") for _ in range(r.randint(60, 400))) for _ in range(40)]


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, vocabulary, plain):
    texts = _texts()
    rows = [(i, "x", t, 1) for i, t in enumerate(texts)] + [(None, "x", "twice", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, ids string, text string, key int").repartition(3)
    encoded = bpe.encode(docs, vocabulary)
    found = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(found[i] == plain.encode_ordinary(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, vocabulary).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    digests = bpe.round_trip(docs, vocabulary).collect()
    assert len(digests) == len(rows) and sum(r["doc_id"] is None for r in digests) == 2
    for r in digests:
        text = "twice" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), vocabulary).count() == bpe.round_trip(docs.limit(0), vocabulary).count() == 0


def test_long_texts_pass_in_parts(spark, vocabulary, plain, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 7)
    monkeypatch.setattr(bpe, "KNOWN", 50_300)
    coder = bpe.Coder(vocabulary)
    text = "one two three, four five six seven eight nine ten eleven"
    parts = [w for some in coder.words(text) for w in some]
    assert "".join(parts) == text and max(map(len, coder.words(text))) <= 7
    for words in ([w] for w in ["alpha", " beta", " gammaray", "zzzzqqqq"] * 20):  # the memory of words is emptied on the way
        assert coder.encode(np.zeros(1, np.int64), bpe.pa.array(words)).column("ids").to_pylist()[0] == plain.encode_ordinary(words[0])


def _plain_collocations(rows, least, inside, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i:i + n])] += 1
    out = {}
    for (lang, words), a in counts.items():
        if len(words) == 1 or a < least:
            continue
        if any(100 * b >= inside * a for (other, w), b in counts.items() if other == lang and len(w) > len(words) and b >= least and words in (w[:-1], w[1:])):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:first]))


def _phrases(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "b", "cc", "dé", "e f", "g"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1c", " "]
    return [(r.choice(["en", "de", None, "und", ""]), r.choice([None, "", "".join(r.choice(vocabulary) + r.choice(marks) for _ in range(r.randint(0, 60)))])) for _ in range(60)]


@pytest.mark.parametrize("bits", [64, 3])
def test_collocations_equal_a_plain_count(spark, monkeypatch, bits):
    if bits == 3:  # nearly all fingerprints collide; counts are those of texts all the same
        monkeypatch.setattr(collocations, "_mixed", lambda x: x & np.uint64(7 << 61))
    rows = _phrases(5)
    docs = spark.createDataFrame([(i if i % 5 else None, *x, "p") for i, x in enumerate(rows)], "doc_id bigint, lang string, text string, phrase string").repartition(3)
    settings = collocations.Settings(least=4, first=9)
    found = collocations.collocations(docs, settings)
    assert sorted(tuple(r) for r in found.drop("doc_id", "place").collect()) == _plain_collocations(rows, 4, 50, 9)
    texts = {i: (t or "").encode().lower() for i, (_, t) in enumerate(rows)}
    for r in found.filter("doc_id is not null").collect():
        assert texts[r["doc_id"]][r["place"]:].replace(b"\t", b" ").split()[:len(r["phrase"].split(" "))][0] == r["phrase"].encode().split(b" ")[0]


def test_blocks_of_collocations_reach_python_a_few_at_a_time(spark, monkeypatch):
    most, whole = 20_000, collocations._by_text

    def bounded_only(least):
        inner = whole(least)

        def of(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows == 1 or batch.nbytes < 10 * most
                    yield batch

            return inner(seen())

        return of

    r = random.Random(8)
    rows = [(i, "en", " ".join(f"w{r.randrange(3000)}" for _ in range(400))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)
    settings = collocations.Settings(least=1)
    expected = sorted((x["phrase"], x["many"]) for x in collocations.phrase_counts(docs, settings).collect())
    monkeypatch.setattr(collocations, "_by_text", bounded_only)
    monkeypatch.setattr(collocations, "HELD_TEXTS", 5_000)
    monkeypatch.setattr(collocations, "STEP", 10_000)
    monkeypatch.setattr(collocations, "AT_ONCE", most, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted((x["phrase"], x["many"]) for x in collocations.phrase_counts(docs, settings).collect()) == expected
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert collocations.collocations(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, "en", ""), (2, "en", " .,\n")], "doc_id bigint, lang string, text string")
    assert collocations.collocations(nulls).count() == 0
    assert {(r["lang"], r["many"]) for r in collocations.phrase_counts(nulls).collect()} == {("und", 0), ("en", 0)}


def test_products_of_counts_stay_exact(spark):
    n = 3_000_000_000
    df = spark.createDataFrame([(n + 7, n + 9, n + 11)], "a bigint, l bigint, r bigint")
    assert df.select(collocations.score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * (n + 7) ** 2 // ((n + 9) * (n + 11))


def _fault(turns):
    seen, faults = set(), []
    for role, text in turns:
        stripped = text.strip("\t\n\x0b\x0c\r ")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else None if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def _cheapest(turns, faults):
    """Dijkstra over (cost, audit): the first complete repair that comes out is the cheapest and, among those, the least."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, lines
        state = (i, made[-1:] or "^")
        if (state, audit) in done or cost > 60:
            continue
        done.add((state, audit))
        options = [("user", "u"), ("assistant", "a")]
        for role, c in options:
            heapq.heappush(heap, (cost + 5, audit + "I", i, made + c, (*lines, (role, ""))))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a") and role:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, made + role[0], (*lines, (role, text))))
                for new, c in options:
                    heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, made + c, (*lines, (new, text))))
        # Only prefixes of the pattern can be completed.
        heap = [x for x in heap if re.fullmatch("s?(ua)*u?", x[3])]
        heapq.heapify(heap)
    raise AssertionError


def _conversations(seed, many):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(many)]:
        for _ in range(r.randint(0, 5)):
            rows.append((conv, r.choice([None, 0, 1, 2, 4, 7]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]),
                         r.choice([None, "", " \t\n", "Yes.", "No!", "Why? ", "open", "end.\x0b", "a.b", "nbsp. "])))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_repairs_are_the_cheapest_and_the_least(spark, chunk):
    rows = _conversations(chunk, 40)
    turns = spark.createDataFrame([(*x, "z") for x in rows], "conv_id bigint, turn int, role string, text string, position string").repartition(3)
    plan = conversation_repair.plan_repair(turns, chunk)
    found = {r["conv_id"]: r for r in conversation_repair.report(plan, turns).collect()}
    repaired = {}
    for r in sorted(conversation_repair.repaired_turns(plan).collect(), key=lambda r: (r["position"], r["part"])):
        repaired.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(found) == {x[0] for x in rows}
    for conv, r in found.items():
        own = sorted(((t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv),
                     key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        said = [x[1:] for x in own]
        faults = _fault(said)
        cost, audit, lines = _cheapest(said, faults)
        numbers = [t for t, _, _ in own if t is not None]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert repaired.get(conv, []) == list(lines)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()


def test_a_long_conversation_is_repaired_over_many_chunks(spark):
    r = random.Random(9)
    rows = [(1, i, r.choice(["user", "assistant"]), f"{r.randint(0, 400)}{r.choice(['.', '.', '!', '', ' '])}") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    whole, parts = (conversation_repair.report(conversation_repair.plan_repair(turns, n), turns).collect() for n in (4096, 16))
    assert whole == parts and whole[0]["cost"] > 0


def test_conversations_without_turns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    plan = conversation_repair.plan_repair(empty)
    assert conversation_repair.report(plan, empty).count() == 0 and conversation_repair.repaired_turns(plan).count() == 0
    ids = spark.createDataFrame([(3,), (None,), (3,)], "conv_id bigint")
    rows = conversation_repair.report(plan, ids).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(((r["conv_id"] or 0, *tuple(r)[1:]) for r in rows)) == [(0, 0, 0, 0, 0, 0, 0, "", nothing), (3, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", f"Hi. {c}! {t}?") for c in [None, *range(40)] for t in (None, 0, 1, 2)]
    damaged = conversation_repair.damage(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            expected += [row] * (2 if kind == 3 else 1)
    assert Counter(tuple(r) for r in damaged) == Counter(expected)
