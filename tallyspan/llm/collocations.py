"""Phrase collocations: Rabin-Karp fingerprints of every n-gram, exact counts of the frequent ones.

A task lays its texts end to end and takes numpy prefix polynomials modulo 2**64, first over bytes, which gives every word its number, then
over words, which gives every run of n words its fingerprint by one subtraction and one product. Three passes over the texts follow.

1. Fingerprints of one and two words are counted in each task; the shuffle brings equal ones together, and sums tell the frequent ones.
2. A longer run can be frequent only where both runs of one word less are. Its fingerprint is counted where a bit map of frequent
   fingerprints has both. The map is 16 MB, whatever the input; chance hits cost rows and nothing else.
3. Where an n-gram's fingerprint is in the map, its task compares the occurrences byte by byte and reads the words at one of them. The shuffle brings together
   what shares a fingerprint, with a pointer to an occurrence, and tells different texts apart: counts are those of texts, whatever collides.

Nothing but frequent phrases is ever turned into text. A group is one fingerprint and has at most one row a task and text, so no phrase, language or source
is too frequent for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401, reached as pa.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.llm.common import batches_under, bit_map, bounded, in_map, settle, shared

#: Different fingerprints that a task holds before it hands them on.
HELD = 1_200_000
#: Rows of texts that a task holds before it adds them up, and hands them on if more than half are left.
HELD_TEXTS = 600_000
#: Bytes of text whose words are numbered at once.
STEP = 2_000_000
#: Bytes of rows that reach a task's Python at once; rows of blocks are some hundred kilobytes each, and Spark would send a whole partition of them.
AT_ONCE = 4_000_000
#: Blocks of the range of fingerprints for each partition of a shuffle. One block is held at a time.
BLOCKS = 4
#: Stands for a document without number.
NO_DOC = -(1 << 63)
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2


@dataclass(frozen=True)
class Settings:
    """`longest`: words of a phrase at most. `least`: occurrences of a candidate at least. `inside`: a candidate goes if a longer one that holds it has this
    percentage of its occurrences or more. `first`: phrases returned for each language."""

    longest: int = 3
    least: int = 10
    inside: int = 50
    first: int = 2000


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self._bases = base, pow(base, -1, 1 << 64)
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def to(self, n: int) -> list[np.ndarray]:
        if len(self._tables[0]) < n:
            for i, b in enumerate(self._bases):
                steps = np.full(max(n, 1 << 16), b, np.uint64)
                steps[0] = 1
                self._tables[i] = np.multiply.accumulate(steps)
        return self._tables


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over all 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class _Texts:
    """The words of some texts, with fingerprints of their n-grams."""

    def __init__(self, texts: list[str | None], langs: list[str], powers: tuple[_Powers, _Powers]) -> None:
        encoded = [(t or "").encode() for t in texts]
        self.bytes = b"\n".join(encoded)
        codes = _LOWER[np.frombuffer(self.bytes, np.uint8)]
        self.codes, self.lower = codes, codes.tobytes()
        kind = _KIND[codes]
        edges = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])))
        self.starts, self.ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts] if len(self.starts) else self.starts
        begin = np.cumsum([0, *(len(e) + 1 for e in encoded)])
        self.begin = begin
        self.doc = np.searchsorted(begin, self.starts, side="right") - 1
        self.langs, self.lang_of = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.array([]), np.zeros(0, np.int64))
        self.lang = self.lang_of[self.doc] if len(self.doc) else self.doc
        self._polynomials(codes, powers)

    def _polynomials(self, codes: np.ndarray, powers: tuple[_Powers, _Powers]) -> None:
        up, down = powers[0].to(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        terms = sums[1:]
        terms += codes
        terms += np.uint64(1)
        terms *= up[:len(codes)]
        np.cumsum(terms, out=terms)
        # Lengths are mixed in: runs of bytes differ in number where they differ in text, but for rare collisions.
        words = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        del sums, terms
        self._up, self._down = powers[1].to(len(words) + 1)
        self._words = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self._up[:len(words)], out=self._words[1:])
        salts = np.array([hash_text(x) for x in self.langs], np.uint64)
        self._salt = salts[self.lang] if len(self.lang) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all runs of n words in one piece, and the runs' fingerprints; languages never share one but by chance."""
        many = max(0, len(self.starts) - n + 1)
        at = np.nonzero(self.piece[n - 1:] == self.piece[:many])[0] if many else np.zeros(0, np.int64)
        return at, self.prints(at, n)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mixed((self._words[at + n] - self._words[at]) * self._down[at] + self._salt[at] + np.uint64(n))

    def equal(self, at: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        """Whether the runs of n words at some places have the languages and the words, byte by byte, of the runs at other places."""
        same = self.lang[at] == self.lang[other]
        for k in range(n):
            size = self.ends[at + k] - self.starts[at + k]
            same &= size == self.ends[other + k] - self.starts[other + k]
            for i in range(0, len(at), 1 << 18):
                held = np.nonzero(same[i:i + (1 << 18)])[0] + i
                each = size[held]
                before = np.cumsum(each) - each
                inner = np.arange(int(each.sum())) - np.repeat(before, each)
                differ = self.codes[np.repeat(self.starts[at[held] + k], each) + inner] != self.codes[np.repeat(self.starts[other[held] + k], each) + inner]
                same[held[np.add.reduceat(differ, before) > 0] if len(held) else held] = False
        return same

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The n words from each place on, one space between."""
        from_, to = self.starts[at], self.ends[at + n - 1]
        plain = np.ones(len(at), bool)
        for k in range(1, n):
            gap = self.ends[at + k - 1]
            plain &= (self.starts[at + k] - gap == 1) & (self.codes[gap] == 0x20)
        text = self.lower
        found = [text[x:y] for x, y in zip(from_.tolist(), to.tolist(), strict=True)]
        for i in np.nonzero(~plain)[0].tolist():
            found[i] = b" ".join(found[i].split())
        return found


def hash_text(text: str) -> int:
    """A number for a language, the same in every task."""
    value = 1469598103934665603
    for c in text.encode():
        value = (value ^ c) * 1099511628211 % (1 << 64)
    return value


COUNTED = "block int, prints binary, times binary"


class _Counter:
    """Adds up numbers by fingerprint and hands them on when it holds many.

    A row has the fingerprints of one block of their range, rising, and their numbers, so the plan moves few rows and combines none a second time.
    """

    def __init__(self, blocks: int) -> None:
        self.blocks = blocks
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, prints: np.ndarray) -> None:
        keys, times = np.unique(prints, return_counts=True)
        self.parts.append((keys, times.astype(np.int32)))
        self.held += len(keys)

    def give(self, over: int) -> Iterator[pa.RecordBatch]:
        if self.held > over:
            keys, times = summed(self.parts)
            if over and len(keys) <= over // 2:
                self.parts, self.held = [(keys, times)], len(keys)
                return
            self.parts, self.held = [], 0
            block = _block(keys, self.blocks)
            cuts = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(keys)])).tolist() if len(keys) else [0]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            for i in range(0, len(spans), 64):
                some = spans[i:i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[x]) for x, _ in some], pa.int32()), pa.array([keys[x:y].tobytes() for x, y in some], pa.binary()),
                                                  pa.array([times[x:y].tobytes() for x, y in some], pa.binary())], names=["block", "prints", "times"])


def _block(prints: np.ndarray, blocks: int) -> np.ndarray:
    """Numbers of the blocks, of equal parts of the range of fingerprints, that fingerprints belong to."""
    return ((prints >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints of some lists, rising, and the sums of their numbers."""
    if len(parts) == 1:
        return parts[0]
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first, dtype=times.dtype) if len(first) else times


def _frequent(least: int):
    """Fingerprints of rows sorted by block that occur so many times or more; one block is held at a time."""

    def above(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, times = summed([(k, t.astype(np.int64)) for k, t in parts])
        if len(keys := keys[times >= least]):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["print"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for block, prints, times in zip(*(batch.column(c) for c in ("block", "prints", "times")), strict=True):
                if block.as_py() != now:
                    yield from above(parts)
                    now, parts = block.as_py(), []
                parts.append((np.frombuffer(prints.as_buffer(), np.uint64).copy(), np.frombuffer(times.as_buffer(), np.int32).copy()))
        yield from above(parts)

    return of


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
    powers = _Powers(BASE), _Powers(WORD_BASE)
    for batch in bounded(batches, "text", STEP):
        yield batch, _Texts(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), powers)


def _short(blocks: int):
    """Counts runs of one and two words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(blocks)
        for _, texts in _steps(batches):
            for n in (1, 2):
                counter.add(texts.grams(n)[1])
            yield from counter.give(HELD)
        yield from counter.give(0)

    return of


def _longer(n: int, blocks: int, model: Callable[[], np.ndarray]):
    """Counts runs of n words of which both runs of one word less are in the map."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counter = model(), _Counter(blocks)
        for _, texts in _steps(batches):
            at, prints = texts.grams(n)
            counter.add(prints[in_map(bits, texts.prints(at, n - 1)) & in_map(bits, texts.prints(at + 1, n - 1))])
            yield from counter.give(HELD)
        yield from counter.give(0)

    return of


#: Texts of one block: `langs` names the languages that `lang` has the numbers of; phrases are separated by line ends, which no phrase holds.
READ = "block int, langs array<string>, lang binary, phrases binary, times binary, docs binary, places binary"
_KEYS = ("print", "lang", "phrase")


def _read(longest: int, blocks: int, model: Callable[[], np.ndarray]):
    """Texts of the n-grams in the map, with how often they occur and one place of each; an empty one has the number of words of a language."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, rows = model(), [], 0
        for batch, texts in _steps(batches):
            ids, langs = pa.compute.fill_null(batch.column("doc_id"), NO_DOC), pa.array(texts.langs.tolist(), pa.string())
            words = pa.array(np.bincount(texts.lang, minlength=len(langs)))
            marks = np.array([hash_text(x) for x in texts.langs], np.uint64)
            parts = [(marks, langs, pa.array([""] * len(langs), pa.string()), words, pa.array([NO_DOC] * len(langs), pa.int64()), np.zeros(len(langs), np.int64))]
            for n in range(1, longest + 1):
                at, prints = texts.grams(n)
                kept = in_map(bits, prints)
                prints, first, count = _told_apart(texts, at[kept], prints[kept], n)
                doc = texts.doc[first]
                phrases = pa.array(texts.phrases(first, n), pa.binary()).cast(pa.string())
                parts.append((prints, langs.take(pa.array(texts.lang[first])), phrases, count, ids.take(pa.array(doc)), texts.starts[first] - texts.begin[doc]))
            for part in parts:
                held.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in part], names=[*_KEYS, "times", "doc", "place"]))
                rows += len(part[0])
            if rows > HELD_TEXTS:
                combined = _combined(held)
                held, rows = combined.to_batches(), combined.num_rows
                if rows > HELD_TEXTS // 2:
                    yield from _in_blocks(combined, blocks)
                    held, rows = [], 0
        if held:
            yield from _in_blocks(_combined(held), blocks)

    return of


def _combined(held: list[pa.RecordBatch]) -> pa.Table:
    """Equal texts of a task as one row, with one of their places."""
    found = pa.Table.from_batches(held).group_by(list(_KEYS), use_threads=False).aggregate([("times", "sum"), ("doc", "first"), ("place", "first")])
    return found.select([*_KEYS, "times_sum", "doc_first", "place_first"]).rename_columns([*_KEYS, "times", "doc", "place"])


def _in_blocks(rows: pa.Table, blocks: int) -> Iterator[pa.RecordBatch]:
    block = _block(rows.column("print").to_numpy(), blocks)
    order = np.argsort(block, kind="stable")
    block, rows = block[order], rows.take(pa.array(order))
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32)
    phrases = rows.column("phrase").to_pylist()
    times, docs, places = (rows.column(c).to_numpy().astype(np.int64) for c in ("times", "doc", "place"))
    cuts = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(block)])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        arrays = [[int(block[a])], [langs], [lang[a:b].tobytes()], ["\n".join(phrases[a:b]).encode()], *([x[a:b].tobytes()] for x in (times, docs, places))]
        kinds = (pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


FOUND = "lang string, words int, phrase string, many bigint, doc_id bigint, place bigint"


def _by_text(least: int):
    """Adds up the texts of rows sorted by block; different texts of one fingerprint stay apart. One block is held at a time."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def told(found: dict[tuple[str, str], tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        rows = [(lang, phrase.count(" ") + 1 if phrase else 0, phrase, many, None if doc == NO_DOC else doc, place)
                for (lang, phrase), (many, doc, place) in found.items() if many >= least or not phrase]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, langs = batch.column("block")[row].as_py(), batch.column("langs")[row].as_py()
                if block != now:
                    yield from told(found)
                    now, found = block, {}
                lang, phrases, *numbers = (batch.column(c)[row].as_py() for c in ("lang", "phrases", "times", "docs", "places"))
                times, docs, places = (np.frombuffer(x, np.int64).tolist() for x in numbers)
                for i, phrase, n, doc, place in zip(np.frombuffer(lang, np.int32).tolist(), phrases.decode().split("\n"), times, docs, places, strict=True):
                    key = langs[i], phrase
                    before = found.get(key)
                    found[key] = (n, doc, place) if before is None else (before[0] + n, *min(before[1:], (doc, place)))
        yield from told(found)

    return of


def _told_apart(texts: _Texts, at: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (language, text) among occurrences with fingerprints: (fingerprint, first place, number of occurrences).

    Every occurrence is compared with the first one of its fingerprint; those that differ are gone through again without that one.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left, marks = at, prints
    while len(left):
        order = np.argsort(marks, kind="stable")
        left, marks = left[order], marks[order]
        new = np.concatenate(([True], marks[1:] != marks[:-1]))
        group = np.cumsum(new) - 1
        first = left[new]
        same = texts.equal(left, first[group], n)
        found.append((marks[new], first, np.bincount(group[same], minlength=len(first))))
        left, marks = left[~same], marks[~same]
    if not found:
        return prints, at, at
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def phrase_counts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """How often every phrase of up to `longest` words occurs that occurs `least` times or more: rows (lang, words, phrase, many, doc_id, place).

    Everything is counted within a language; null is `und`, also for a text that names it so. A-Z are lower-cased; texts are cut at `.,;:!?` and line ends, those
    pieces at spaces and tabs; null and empty texts have no words. Repeated rows count again. `doc_id` and `place` (bytes from the text's start) point to one
    of the occurrences. A row of zero words and an empty phrase has the number of all words of a language, zero included. Other
    columns are ignored; an empty table gives an empty one. Memory of a task follows the longest text.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = BLOCKS * partitions

    def frequent(task) -> DataFrame:
        counted = rows.select("text", "lang").mapInArrow(task, COUNTED).repartition(partitions, "block").sortWithinPartitions("block")
        return settle(counted.mapInArrow(_frequent(settings.least), "print bigint"), "prints")

    with batches_under(spark, AT_ONCE):
        bits = bit_map(frequent(_short(blocks)))
        for n in range(3, settings.longest + 1):
            bits = bits | bit_map(frequent(_longer(n, blocks, shared(spark, bits))))
        read = rows.mapInArrow(_read(settings.longest, blocks, shared(spark, bits)), READ).repartition(partitions, "block").sortWithinPartitions("block")
        return settle(read.mapInArrow(_by_text(settings.least), FOUND), "phrases")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) of three columns of counts, exactly; decimals of 38 digits hold the products of counts up to 10**16."""
    top = f"cast(cast({a} as decimal(19,0)) * {a} as decimal(32,0)) * cast(1000000 as decimal(7,0))"
    return F.expr(f"cast(cast({top} as decimal(38,0)) div cast(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)) as decimal(38,0)) as bigint)")


def collocations(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Each language's strongest phrases: rows (lang, rank, phrase, a, l, r, n, score, doc_id, place).

    Candidates are phrases of two words or more. A candidate's score is that of its weakest cut, ties to the earliest. One that lies inside a longer candidate goes if that one
    has `inside` percent of its occurrences or more. Ordered by score and a, falling, then by phrase in byte order; texts, nulls and empty tables as in
    `phrase_counts`.
    """
    settings = settings or Settings()
    counts = phrase_counts(docs, settings)
    words = F.split("phrase", " ")
    candidates = counts.filter("words >= 2").withColumn("w", words)
    joined = F.array_join
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), joined(F.slice("w", F.lit(1), k), " ").alias("head"), joined(F.slice("w", k + 1, F.col("words") - k), " ").alias("tail"))))
    cuts = candidates.select("lang", "phrase", F.col("many").alias("a"), "words", "doc_id", "place", cut.alias("c")).select("*", "c.*").drop("c")
    single = counts.filter("words > 0").select("lang", "phrase", "many")
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("many").alias("l")), ["lang", "head"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("tail"), F.col("many").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", score("a", "l", "r"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "doc_id", "place")).alias("x")).select("lang", "phrase", "x.*")

    # Every shorter run of words inside a candidate, with the candidate's occurrences.
    runs = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: joined(F.slice("w", i, m), " ")))))
    holders = candidates.filter("words > 2").select("lang", "many", runs.alias("phrase")).groupBy("lang", "phrase").agg(F.max("many").alias("longer"))
    kept = weakest.join(holders, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * settings.inside))
    totals = counts.filter("words = 0").select("lang", F.col("many").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc_id", "place")
