"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspan.session import settle
from tallyspan.sources.tables import table

__all__ = ["bounded", "byte_words", "components", "fold_ascii", "settle", "shared", "space_words", "table"]

#: Characters that separate words wherever a rule says "white space": space and the five ASCII controls around the line feed.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Bytes of text that one step of a Python task works on at once.
STEP_BYTES = 4_000_000


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: Column) -> Column:
    """Number of runs of characters that are not white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("bigint")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z lower-cased; `bytes.split` cuts at exactly the six characters of SPACE_CLASS."""
    return text.encode().lower().split() if text else []


def bounded(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `step` bytes of text, so that memory follows the longest text and not the batch."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > step:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bits of a map of numbers: 16 MB, whatever the size of the input.
MAP_BITS = 27
#: Rows of a map that are collected: each is a block of it.
MAP_BLOCKS = 256


def in_map(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers (unsigned, 64 evenly spread bits) have their bit set: all that the map was made of, and few others by chance."""
    place = numbers >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_map(numbers: DataFrame) -> np.ndarray:
    """A map with a bit for every number of a column of longs; each task sets the bits of some blocks, so at most MAP_BLOCKS rows of fixed size are collected."""
    size = 1 << (MAP_BITS - 3)
    each = size // MAP_BLOCKS
    name, top_bits, bits_in_map = numbers.columns[0], MAP_BLOCKS.bit_length() - 1, MAP_BITS

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(name).to_numpy().view(np.uint64) >> np.uint64(64 - bits_in_map)
            where = (place >> np.uint64(3)).astype(np.int64)
            for b in np.unique(where // each).tolist():
                own = where // each == b
                np.bitwise_or.at(blocks.setdefault(b, np.zeros(each, np.uint8)), where[own] % each, np.left_shift(1, place[own] & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])

    block = F.shiftrightunsigned(name, 64 - top_bits)
    bits = np.zeros(size, np.uint8)
    # One job for the map, which never exceeds 16 MB; fetching it task by task would be a job for each partition.
    for row in numbers.repartition(block).mapInArrow(of, "block int, bits binary").collect():
        bits[row["block"] * each:(row["block"] + 1) * each] |= np.frombuffer(row["bits"], np.uint8)
    return bits


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is settled inside reaches Python so many rows at a time, where each row carries whole texts; the setting before comes back afterwards."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextmanager
def batches_under(spark: SparkSession, size: int) -> Iterator[None]:
    """What is settled inside reaches Python about so many bytes at a time, but one row at least, where a row carries a block; the setting before comes back afterwards."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives tasks a broadcast value. Classes of this folder travel by value, so executors need no copy of it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b) of longs: rows (node, root), root being the smallest node reached.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then every
    node joins its smaller neighbours to the smallest. The number of rounds grows with the logarithm of the longest chain.
    Each round is a grouped minimum, which combines before its shuffle, and one join, whose large keys adaptive execution
    splits; its rows are written to the shared folder, so a lost executor costs one round. Loops (a = a) and repeated rows
    change nothing; nodes without an edge do not appear; an empty table gives an empty table.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        joined = larger.join(least, "a")
        edges = settle(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return table(spark, folder, name, *columns)
