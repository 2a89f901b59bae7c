"""File sources. Everything is read as text first; types are decided by the checks and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.functions.text import strict_integer
from tallyspan.operators.intake import canonical_columns, missing_columns


def read_text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited table with a header row, every column as text under its header name."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False)


def read_monthly_csv(spark: SparkSession, path: str, columns: list[str], text_columns: tuple[str, ...] = ("k",)) -> DataFrame:
    """A monthly table; every column but the text ones must hold whole numbers and is null where it does not."""
    rows = canonical_columns(read_text_csv(spark, path))
    lacking = missing_columns(rows, columns)
    if lacking:
        raise ValueError("the table lacks " + ", ".join(lacking))
    return rows.select(*[F.col(c) if c in text_columns else strict_integer(F.col(c)).alias(c) for c in columns])


def read_raw_cells(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Headerless text as cells. The first cell identifies the row; nothing is turned into a null."""
    parts = F.split("value", f"[{sep}]", -1)
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("row_key"), F.posexplode(parts).alias("col_pos", "value"))
    return lines.select("row_key", F.col("col_pos").cast("bigint").alias("col_pos"), "value")
