"""Summaries for display. Zeros that a pivot shows for empty cells are display only and never go back into a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspan.functions.calendar import declared_year


def latest(df: DataFrame, period: str, value: str) -> DataFrame:
    """Newest row of every key, by an aggregate that keeps one row per key before the shuffle."""
    return df.groupBy("k").agg(F.max(F.struct(period, value)).alias("_r")).select("k", f"_r.{period}", f"_r.{value}")


def summary_cards(cells: DataFrame) -> DataFrame:
    """Total, share of all and peak year of every key, and the key with the largest total."""
    yearly = cells.groupBy("k", "year").agg(F.sum("y").alias("t"))
    best_year = F.max(F.struct(F.col("t"), (-F.col("year")).alias("_y")))
    per_key = yearly.groupBy("k").agg(F.sum("t").alias("total"), best_year.alias("_p"))
    whole = per_key.agg(F.sum("total")).scalar()
    top = per_key.agg(F.min_by("k", F.struct((-F.col("total")).alias("t"), F.col("k").alias("n")))).scalar()
    return per_key.withColumn("_all", whole).withColumn("_top", top).select(
        "k", "total", (F.col("total") / F.col("_all")).alias("share"), (-F.col("_p._y")).alias("peak_year"), (F.col("k") == F.col("_top")).alias("is_top")
    )


def seasonal_pivot(cells: DataFrame, years: list[int]) -> DataFrame:
    """Month by year table of each key. The years are given, so no extra pass looks for them; a row of another year is an error."""
    wide = cells.withColumn("year", declared_year(F.col("year"), years)).groupBy("k", "month").pivot("year", years).agg(F.sum("y"))
    return wide.select("k", "month", *[F.coalesce(F.col(str(y)), F.lit(0)).cast("bigint").alias(f"y{y}") for y in years])
