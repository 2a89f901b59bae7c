"""Content signatures that do not depend on row order or on the number of partitions.

Every row is hashed, the first 240 bits of the hash are cut into twelve 20-bit lanes, and the lanes are summed as whole
numbers, which holds for trillions of rows. Sums combine on the map side, so no group is ever collected or sorted,
whatever its size. The signature is the hash of the row count and the twelve sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 4
WORD_DIGITS = 15
LANE_BITS = 20


def row_text(*columns: Column) -> Column:
    """One text per row; every value carries its length, so neighbouring values cannot run together."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts)


def row_hash(*columns: Column) -> Column:
    return F.sha2(row_text(*columns), 256)


def content_signature(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """One signature for the whole table, or one per key."""
    keys = keys or []
    hashed = df.select(*keys, row_hash(*[F.col(c) for c in columns]).alias("_h"))
    words = hashed.select(*keys, *[
        F.conv(F.substring("_h", 1 + i * WORD_DIGITS, WORD_DIGITS), 16, 10).cast("bigint").alias(f"_w{i}") for i in range(WORDS)
    ])
    mask = (1 << LANE_BITS) - 1
    lanes = [
        F.sum(F.shiftright(f"_w{i}", shift * LANE_BITS).bitwiseAND(F.lit(mask).cast("bigint"))).alias(f"_l{i}{shift}")
        for i in range(WORDS) for shift in range(3)
    ]
    sums = words.groupBy(*keys).agg(F.count("*").alias("n_rows"), *lanes)
    parts = [F.col("n_rows").cast("string")] + [
        F.coalesce(f"_l{i}{shift}", F.lit(0)).cast("string") for i in range(WORDS) for shift in range(3)
    ]
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws("/", *parts), 256).alias("content_signature"))
