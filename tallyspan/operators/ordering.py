"""Positions in a total order, for tables and groups of any size.

A window without partitions, or over one very large group, would put its rows into a single task. Here the rows are
written in sorted order, range by range, and read back: a row's position is its place in its file plus the rows of the
files before it. Only one number per file is accumulated, and the written table survives the loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.session import new_folder

_FILE = r"part-(\d+)-.*-c(\d+)"


def positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """1-based position of every row in the given order. The sort reads its input twice, so a costly one is settled before."""
    spark = df.sparkSession
    folder = new_folder(spark, "ordered")
    df.orderBy(*order).write.parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder).select(
        "*", F.regexp_extract("_metadata.file_name", _FILE, 1).cast("bigint").alias("_part"),
        F.regexp_extract("_metadata.file_name", _FILE, 2).cast("bigint").alias("_piece"), F.col("_metadata.row_index").alias("_row"),
    )
    earlier = Window.orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part", "_piece").agg(F.count("*").alias("_n")).select(
        "_part", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return rows.join(offsets, ["_part", "_piece"]).select(*df.columns, (F.col("_before") + F.col("_row") + 1).cast("bigint").alias(name))


def positions_in_group(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based position of every row within its group; a group may span many tasks."""
    placed = positions(df, [*keys, *order], "_global")
    first = placed.groupBy(*keys).agg(F.min("_global").alias("_first"))
    return placed.join(first, keys).select(*df.columns, (F.col("_global") - F.col("_first") + 1).alias(name))
