"""Near-duplicates by 64-bit similarity fingerprints.

A fingerprint is embedded as its bit counts over 32 segments of two bits. The Manhattan distance of two embeddings never
exceeds the number of differing bits, so it is a lower bound: pairs beyond the limit are passed over before the exact count.
Cells of a grid hold candidates: the segments are dealt into `distance + keep` groups, and as each unit of distance falls into
one group, two linked fingerprints agree on all counts of at least `keep` groups. Every choice of `keep` groups is a grid over
those counts. No pair within the limit is missed.

A count of two bits is stored in unary (00, 01, 11), so an embedding is a 64-bit number too and the Manhattan distance of two
embeddings is the number of bits in which they differ.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.llm import near_copies
from tallyspan.llm.common import batches_of, byte_words, components, settle

SEED = 42
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Shingles whose bits are counted at once.
STEP = 1 << 15
#: Fingerprints of one cell that are compared in one group; a larger cell is dealt into blocks, and every two blocks meet.
BLOCK = 20_000
#: One fingerprint in so many is counted to find large cells before any is dealt.
SAMPLED = 64
#: Cells of up to so many fingerprints are compared side by side.
SMALL = 32


def _bits(hashes: Iterator[bytes], n: int) -> int:
    """Signed number whose bits are those that more than half of n hashes have."""
    counts = np.zeros(64, np.int64)
    while held := b"".join(itertools.islice(hashes, STEP)):
        counts += np.unpackbits(np.frombuffer(held, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of a text: a bit is set where more than half of its shingles' hashes have it."""
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    return _bits((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), n)


def vocabulary_fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of the different words of a text, each once. An edit moves it less than one of shingles."""
    words = set(byte_words(text))
    digest = xxhash.xxh64_digest
    return _bits((digest(w, SEED) for w in words), len(words)) if words else 0


def fingerprint_column(text: Column, shingle: int, vocabulary: bool = False) -> Column:
    """struct(fp, also, words): the fingerprint that finds links, a second one that must be close too or 0, and the number of words.

    Without `vocabulary` the first is that of shingles and there is no second; with it, the first is that of words and the second that of shingles.
    """

    @F.pandas_udf("fp bigint, also bigint, words bigint")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [(vocabulary_fingerprint(t) if vocabulary else fingerprint(t, shingle), fingerprint(t, shingle) if vocabulary else 0, len(byte_words(t))) for t in texts]
        return pd.DataFrame(found, columns=["fp", "also", "words"], dtype="int64")

    return of(text)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, in unary."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _grids(distance: int, keep: int) -> list[int]:
    """For each choice of groups, the mask of the segments that must agree, as a signed long."""
    dealt = np.array_split(np.arange(SEGMENTS), distance + keep)
    masks = [sum(3 << 2 * int(s) for group in chosen for s in group) for chosen in itertools.combinations(dealt, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unary(x: np.ndarray) -> np.ndarray:
    low, high = x & np.uint64(LOW_BITS), (x >> np.uint64(1)) & np.uint64(LOW_BITS)
    return low | high | ((low & high) << np.uint64(1))


#: Columns of a row in a cell: the node, the fingerprint, and the second fingerprint.
_ROW = ("node", "fp", "also")


def _linked(a: np.ndarray, b: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    """Where rows of a and b link: Manhattan distance of the embeddings first, then the differing bits of both fingerprints."""
    near = np.bitwise_count(_unary(a[1]) ^ _unary(b[1])) <= limits[0]
    at = np.nonzero(near)[0]
    left = [np.broadcast_to(x, near.shape)[at] for x in a]
    near[at] = (np.bitwise_count(left[1] ^ b[1][at]) <= limits[0]) & (np.bitwise_count(left[2] ^ b[2][at]) <= limits[1]) & (left[0] != b[0][at])
    return near


def _forest(rows: np.ndarray, limits: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one cell that hold its groups together: each row is compared with those that no group has yet."""
    rest = rows
    while rest.shape[1] > 1:
        front, rest = [rest[:, 0]], rest[:, 1:]
        while front and rest.shape[1]:
            one = front.pop()
            near = _linked(one, rest, limits)
            if near.any():
                new = rest[:, near]
                yield np.full(new.shape[1], one[0]), new[0]
                front.extend(new.T)
                rest = rest[:, ~near]


def _within(cell: np.ndarray, rows: np.ndarray, limits: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by cell."""
    starts = np.nonzero(np.concatenate(([True], cell[1:] != cell[:-1])))[0]
    sizes = np.diff(np.append(starts, len(cell)))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = rows[:, s:s + n]
        yield from _forest(own[:, np.unique(own[0], return_index=True)[1]], limits)
    kept = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    cell, rows = cell[kept], rows[:, kept]
    for d in range(1, SMALL):
        at = np.nonzero(cell[d:] == cell[:-d])[0]
        if not len(at):
            break
        a, b = rows[:, at], rows[:, at + d]
        near = _linked(a, b, limits)
        yield a[0][near], b[0][near]


def _links(limits: tuple[int, int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            cell, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
            pairs = list(_within(cell, rows, limits)) if len(cell) else []
            if pairs:
                a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
                both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            rows = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _ROW])
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut or held and held[-1][0][-1] != cell[0]:
                held.append((cell[:cut], rows[:, :cut]))
                yield from out()
                held = []
            held.append((cell[cut:], rows[:, cut:]))
        if held:
            yield from out()

    return of


def links(fingerprints: DataFrame, distance: int = 4, keep: int = 3, also_distance: int = 64) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints `fp` differ in at most `distance` bits, and `also` in at most `also_distance`.

    `fingerprints` has one row for each (node, fp, also).

    Within a cell of at most 32 fingerprints every link is returned. Within a larger one, links are returned until all that
    hang together do, so that the result stays in proportion to the fingerprints; the connected groups are those of all links.
    A cell that a sample shows to be larger than BLOCK is dealt into blocks and every pair of blocks becomes a group, which
    changes where pairs meet, not which.
    """
    u = embedding(F.col("fp"))
    cells = F.array(*[F.xxhash64(F.lit(i), u.bitwiseAND(F.lit(mask))) for i, mask in enumerate(_grids(distance, keep))])
    dealt = fingerprints.select(*_ROW, F.explode(cells).alias("cell"))
    large = (
        fingerprints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).select(F.explode(cells).alias("cell"))
        .groupBy("cell").agg(F.ceil(F.count("*") * SAMPLED / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    )
    large = settle(large, "cells")
    if not large.isEmpty():
        dealt = dealt.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks")
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own), F.greatest(j, own))))
        dealt = dealt.select(*_ROW, "cell", "blocks", other.alias("pair")).select(
            *_ROW, F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", "pair")).alias("cell"))
    sorted_cells = dealt.select("cell", *_ROW).repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(_links((distance, also_distance)), "a bigint, b bigint").distinct()


@dataclass(frozen=True)
class Settings:
    """`shingle`: words of a shingle. `distance`: bits in which linked fingerprints may differ. `keep`: groups of segments that a grid fixes.

    With `vocabulary`, links are found by the fingerprint of a text's different words, and that of its shingles may differ in `also_distance` bits. Texts of
    fewer than `least_words` words link to texts of equal fingerprints only: few shingles leave few bits set, and texts that share
    nothing come close by chance.
    """

    shingle: int = 4
    distance: int = 4
    keep: int = 3
    vocabulary: bool = False
    also_distance: int = 64
    least_words: int = 0


def _node(fp: Column, also: Column, settings: Settings) -> Column:
    return F.xxhash64(fp, also) if settings.vocabulary else fp


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Each document's fingerprint and component: rows (doc_id, fp, node, root, component_id), one for every row of `docs`.

    `component_id` is the smallest doc_id among documents reached through links, `root` the component's smallest node. Texts of
    equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint zero and link like any
    other; texts shorter than a shingle count as one shingle. Repeated rows stay repeated. Rows without doc_id get the component
    of their node, null if no member has an id. Other columns are ignored. An empty table gives an empty table.
    """
    settings = settings or Settings()
    marked = docs.select("doc_id", fingerprint_column(F.col("text"), settings.shingle, settings.vocabulary).alias("__found"))
    marked = marked.select("doc_id", "__found.*").withColumn("node", _node(F.col("fp"), F.col("also"), settings))
    marked = settle(marked, "fingerprints")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("words").alias("words"), F.min("fp").alias("fp"), F.min("also").alias("also"))
    nodes = settle(nodes, "nodes")
    linked = links(nodes.filter(F.col("words") >= settings.least_words), settings.distance, settings.keep, settings.also_distance)
    roots = components(linked)
    placed = settle(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "placed")
    # Settled, so that the join deals both sides out anew and adaptive execution can split a component of very many fingerprints.
    least = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = placed.join(least, "root").select("node", "root", "component_id")
    return marked.join(named, "node").select("doc_id", "fp", "node", "root", "component_id")


def similar_texts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Each document's group by an exact similarity of 0.8 or more on five-word shingles: rows (doc_id, node, root, component_id), one for every row of `docs`.

    Links between the fingerprints of different texts are found as in `near_duplicates` and then compared exactly; as a fingerprint may differ in more bits at
    that similarity, `near_copies` finds the rest by common shingles.
    """
    settings = settings or Settings(shingle=near_copies.SHINGLE)
    with batches_of(docs.sparkSession, near_copies.ROWS):
        marked = docs.select(near_copies.node("text").alias("node"), fingerprint_column(F.col("text"), settings.shingle, settings.vocabulary).alias("__found"))
        nodes = marked.groupBy("node").agg(F.first("__found").alias("__found")).select("node", "__found.fp", "__found.also")
        nodes = settle(nodes, "fingerprints")
    linked = links(nodes, settings.distance, settings.keep, settings.also_distance)
    return near_copies.near_copies(docs, linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def keep_one(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs` without near-copies: of each component the document with the smallest doc_id stays.

    Without settings, components are those of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, as in `similar_texts`; with
    settings, those of fingerprints.

    Of rows with the same doc_id that one stays whose text sorts first. A component without any doc_id keeps the row whose text
    sorts first; elsewhere rows without doc_id go. All columns are kept, whatever their names.
    """
    columns = docs.columns
    groups = settle(near_duplicates(docs, settings) if settings else similar_texts(docs), "groups")
    chosen = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(*columns)
    repeated = settle(chosen.filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi")
        first = Window.partitionBy("doc_id").orderBy("text", *[c for c in columns if c != "text"])
        once = once.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(once)
    unnamed = groups.filter("doc_id is null and component_id is null").select(F.col("node").alias("__node"), F.col("root").alias("__root")).distinct()
    unnamed = settle(unnamed, "unnamed")
    if not unnamed.isEmpty():
        found = docs.filter("doc_id is null")
        if settings:
            found = found.withColumn("__found", fingerprint_column(F.col("text"), settings.shingle, settings.vocabulary))
            found = found.withColumn("__node", _node(F.col("__found.fp"), F.col("__found.also"), settings))
        else:
            found = found.withColumn("__node", near_copies.node("text"))
        rows = found.join(unnamed, "__node")
        first = Window.partitionBy("__root").orderBy("text", *[c for c in columns if c != "text"])
        kept = kept.unionByName(rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*columns))
    return kept
