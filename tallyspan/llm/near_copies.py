"""Near copies by the exact Jaccard similarity of five-word shingles.

Two texts of m and n shingles with a similarity of 0.8 or more have at least 4 (m + n) / 9 in common. In any order of all shingles their first common one
stands where so many are left in both, that is among the first n - ceil(0.8 n) + 1. Pairs meet at such places; none is missed. The order puts shingles that a sample
shows to be frequent last, which decides how many pairs meet in vain and nothing else. Pairs that meet are first held against a bound: counts of shingles in 256 parts of their
range, of which two texts share the lesser at most. What the bound allows is compared shingle by shingle.

Pairs meet in two rounds: first those whose fingerprints link, as the caller found them, and each text with the one of every shingle's group that has the
least share of rare shingles. Near copies were most likely made from that one, so nearly all of a large group are joined to it. Then those texts of a
shingle's group that are not yet joined meet, each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.llm.common import batches_of, bit_map, bounded, in_map, byte_words, components, settle, shared

SHINGLE = 5
SEED = 42
#: One text in so many is read to find frequent shingles, of which so many are known at most.
SAMPLED = 16
FREQUENT = 400_000
#: Parts of the range of shingles that an outline counts.
OUTLINE = 256
#: Rows with texts that reach Python at once.
ROWS = 500
#: Pairs that are held at once.
PAIRS = 1_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Numbers of the different five-word shingles of a text, rising; a shorter text has one, of all its words."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64).view(np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    x = sum(h[j:j + n] * _FACTORS[j] for j in range(SHINGLE))
    x ^= x >> np.uint64(32)
    x *= _FACTORS[0]
    x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _node(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)).view(np.int64))


def node(text: str) -> Column:
    """Number of a text's words in order: texts with the same words are one node."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_node(byte_words(t)) for t in texts], dtype="int64")

    return of(text)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that a sample of the texts holds more than once, rising by number, with how often it does."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = [w for w in map(byte_words, batch.column("text").to_pylist()) if len(w) >= SHINGLE]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *map(shingles, found)]))], names=["shingle"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counted = sample.mapInArrow(of, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counted.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toPandas().sort_values("shingle")
    return rows.to_numpy(np.int64).reshape(-1, 2).T


#: Columns of a row of a shingle's group.
_MEMBER = ("shingle", "node", "n", "place", "rare")


def _members(docs: DataFrame) -> DataFrame:
    """Rows (shingle, node, n, place, rare) of the shingles that must meet and that several nodes have: the node's number of shingles, the shingle's place in
    their order from 0, and the thousandths of them that the sample does not show to be frequent."""
    model = shared(docs.sparkSession, _frequent(docs))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = model()
        seen: set[int] = set()
        for batch in bounded(batches, "text"):
            out: list[tuple[np.ndarray, int, int, int]] = []
            for words in map(byte_words, batch.column("text").to_pylist()):
                if len(words) < SHINGLE or (own := _node(words)) in seen:
                    continue
                seen.add(own)
                all_ = shingles(words)
                n = rare = len(all_)
                first = n - (4 * n + 4) // 5 + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, all_), len(known) - 1)
                    often = np.where(known[at] == all_, times[at], 0)
                    all_, rare = all_[np.argsort(often, kind="stable")], n - np.count_nonzero(often)
                out.append((all_[:first], own, n, 1000 * rare // n))
            if out:
                sizes = [len(x[0]) for x in out]
                node, n, rare = (pa.array(np.repeat(np.array([x[k] for x in out], np.int64), sizes)) for k in (1, 2, 3))
                places = pa.array(np.concatenate([np.arange(k) for k in sizes]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), node, n, places, rare], names=list(_MEMBER))

    def several(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((len(_MEMBER), 0), np.int64)
        for batch in groups:
            rows = np.concatenate([left, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            # Of the last group only different nodes go on to the next batch.
            done, left = rows[:, :cut], _different(rows[:, cut:])
            yield from _shared_rows(done)
        yield from _shared_rows(left)

    kinds = ", ".join(f"{c} bigint" for c in _MEMBER)
    rows = docs.select("text").mapInArrow(of, kinds)
    return settle(rows.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(several, kinds), "members")


def _different(rows: np.ndarray) -> np.ndarray:
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    return rows[:, new]


def _shared_rows(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = _different(rows)
    same = rows[0, 1:] == rows[0, :-1]
    rows = rows[:, np.concatenate((same, [False]))[:rows.shape[1]] | np.concatenate(([False], same))[:rows.shape[1]]]
    if rows.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=list(_MEMBER))


def _may_meet(n: Column, left: Column, other_n: Column, other_left: Column) -> Column:
    """Whether a common shingle, of so many each and with so many left from it on, can be the first one that two texts with a similarity of 0.8 share."""
    return 4 * (n + other_n) <= 9 * F.least(left, other_left)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of rows (shingle, node, n, left, root) sorted by shingle that have different roots and may meet (see `_may_meet`)."""
    group, left = None, np.zeros((4, 0), np.int64)
    for batch in batches:
        shingle, *rest = (c.to_numpy() for c in batch.columns)
        rows = np.stack(rest)
        cuts = np.nonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))[0].tolist() if len(shingle) else []
        for a, b in zip(cuts, [*cuts[1:], len(shingle)], strict=True):
            if shingle[a] != group:
                group, left = shingle[a], np.zeros((4, 0), np.int64)
            own = rows[:, a:b]
            # Rows of a group meet those before them, a bounded number at a time.
            left = np.concatenate([left, own], axis=1)
            before = left.shape[1] - own.shape[1]
            step = max(1, PAIRS // left.shape[1])
            for i in range(before, left.shape[1], step):
                x, y = left[:, i:i + step, None], left[:, None, :i + step]
                able = (x[3] != y[3]) & (4 * (x[1] + y[1]) <= 9 * np.minimum(x[2], y[2])) & (np.arange(i, i + x.shape[1])[:, None] > np.arange(y.shape[2]))
                p, q = np.nonzero(able)
                if len(p):
                    p, q = left[0, i + p], left[0, q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["a", "b"])


def _outlines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, node, outline) of all texts; the outline has the number of shingles in each of OUTLINE parts of their range."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            words = [byte_words(t) for t in batch.column("text").to_pylist()]
            outlines = [_outline(shingles(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_node(w) for w in words], pa.int64()), pa.array(outlines, pa.binary())],
                                             names=["doc_id", "node", "outline"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(of, "doc_id bigint, node bigint, outline binary")


def _outline(numbers: np.ndarray) -> bytes:
    parts = np.bincount((numbers.view(np.uint64) % np.uint64(OUTLINE)).astype(np.int64), minlength=OUTLINE)
    return parts.astype(np.uint32 if len(numbers) > 60_000 else np.uint16).tobytes()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose outlines allow a similarity of 0.8: two sets share at most the lesser number in each part."""
    for batch in batches:
        kept = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            x, y = (np.frombuffer(z, np.uint32 if len(z) == 4 * OUTLINE else np.uint16).astype(np.int64) for z in (x, y))
            if 9 * int(np.minimum(x, y).sum()) >= 4 * int(x.sum() + y.sum()):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _verified(pairs: DataFrame, docs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose texts have a similarity of 0.8 or more. Only texts of pairs that their outlines allow are moved."""
    spark = docs.sparkSession
    pairs = settle(pairs.distinct(), "pairs")
    both = pairs.join(outlines.select(F.col("node").alias("b"), F.col("outline").alias("y")), "b").join(outlines.select(F.col("node").alias("a"), F.col("outline").alias("x")), "a")
    pairs = settle(both.select("a", "b", "x", "y").mapInArrow(_likely, "a bigint, b bigint"), "likely")
    wanted = settle(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    model = shared(spark, bit_map(wanted))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model()
        for batch in bounded(batches, "text"):
            nodes = np.array([_node(byte_words(t)) for t in batch.column("text").to_pylist()], np.int64)
            kept = pa.array(np.nonzero(in_map(bits, nodes.view(np.uint64)))[0])
            yield pa.RecordBatch.from_arrays([pa.array(nodes).take(kept), batch.column("text").take(kept)], names=["node", "text"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            kept = []
            for i, (a, s, t) in enumerate(zip(batch.column("a").to_pylist(), batch.column("s"), batch.column("t"), strict=True)):
                if last is None or last[0] != a:
                    last = a, shingles(byte_words(s.as_py()))
                if similar(last[1], shingles(byte_words(t.as_py()))):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    with batches_of(spark, ROWS):
        texts = docs.select("text").mapInArrow(chosen, "node bigint, text string").join(wanted, "node", "left_semi")
        texts = settle(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
        found = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
        return settle(found.select("a", "b", "s", "t").mapInArrow(of, "a bigint, b bigint"), "links")


def near_copies(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (doc_id, node, root, component_id), one for every row of `docs`: its group by links of a similarity of 0.8 or more.

    `linked` has pairs of nodes (a, b) to compare first, such as those of near fingerprints; they decide what work is left, never the result.
    `component_id` is the smallest doc_id of the group, null if no member has one. Texts with the same words are one node; null and empty texts are
    one node too. Texts of fewer than five words are alike only when equal. Repeated rows stay repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    with batches_of(spark, ROWS):
        outlined = settle(_outlines(docs), "nodes")
    marked = outlined.select("doc_id", "node")
    members = _members(docs).withColumn("left", F.col("n") - F.col("place"))
    # A text that shares no shingle where it must has no near copy, whatever its fingerprint.
    outlines = settle(outlined.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("outline").alias("outline")), "outlines")
    # One order of nodes for all shingles: texts that share many shingles meet the same text, once.
    pivot = members.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "left"), F.struct("rare", F.xxhash64("node"))).alias("p"))
    star = members.join(pivot, "shingle").filter("node <> p.node").filter(_may_meet(F.col("n"), F.col("left"), F.col("p.n"), F.col("p.left")))
    star = star.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b"))
    found = _verified(linked.unionByName(star), docs, outlines)
    first = settle(components(found), "first")
    members = settle(members.join(first, "node", "left").select("shingle", "node", "n", "left", F.coalesce("root", "node").alias("root")), "members")
    # Where a shingle's texts are joined already, nothing is left to compare.
    open_ = members.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("many")).filter("x <> y and many > 2").select("shingle")
    rest = members.join(open_, "shingle", "left_semi").select("shingle", "node", "n", "left", "root").repartition("shingle").sortWithinPartitions("shingle")
    found = found.unionByName(_verified(rest.mapInArrow(_pairs, "a bigint, b bigint"), docs, outlines))
    roots = settle(components(found), "roots")
    named = marked.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    named = settle(named, "placed")
    least = settle(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return named.join(least, "root").select("doc_id", "node", "root", "component_id")
