"""Ranking of series by projected total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyspan.functions.numeric import is_finite
from tallyspan.operators.ordering import positions
from tallyspan.session import settle


def projected_total(paths: DataFrame) -> DataFrame:
    return paths.groupBy("k").agg(F.round(F.sum("hybrid"), 6).alias("projected_total"), F.count("hybrid").alias("n_periods"))


def rank_totals(totals: DataFrame) -> DataFrame:
    """Unique ranks, larger totals first and equal ones by key, without one task seeing all series.

    The totals are settled first, since a sort reads its input twice and the forecasts behind them are the larger work.
    """
    known = settle(totals.filter(F.col("projected_total").isNotNull()), "totals")
    return positions(known, [F.desc("projected_total"), F.asc("k")], "rank")


def top_n(totals: DataFrame, n: int) -> DataFrame:
    """The first n of the ranking, published only when at least n series are ranked."""
    enough = totals.filter(F.col("projected_total").isNotNull()).agg(F.count("*")).scalar()
    best = totals.filter(F.col("projected_total").isNotNull()).orderBy(F.desc("projected_total"), "k").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("projected_total"), "k")).cast("bigint")
    return best.withColumn("_all", enough).filter(F.col("_all") >= n).select(
        place.alias("rank"), "k", "projected_total", F.lit("available").alias("status")
    )


def calendar_check(paths: DataFrame, horizon: int) -> DataFrame:
    """Per series: `horizon` consecutive periods, and the same ones as every other series."""
    per_key = paths.groupBy("k").agg(
        F.count("m").alias("n"), F.countDistinct("m").alias("d"), F.min("m").alias("first_m"), F.max("m").alias("last_m")
    )
    common = per_key.agg(F.struct(F.min("first_m").alias("lo"), F.max("first_m").alias("hi"))).scalar()
    return per_key.withColumn("_c", common).select(
        "k", F.col("n").alias("n_periods"),
        ((F.col("n") == horizon) & (F.col("d") == horizon) & (F.col("last_m") - F.col("first_m") == horizon - 1)).alias("consecutive"),
        (F.col("_c.lo") == F.col("_c.hi")).alias("same_calendar"),
    )


def context_check(runs: DataFrame) -> DataFrame:
    """One row: are all runs of a ranking comparable and their values valid."""
    return runs.agg(
        F.countDistinct("k").alias("n_series"),
        F.countDistinct("signature").alias("n_signatures"),
        F.countDistinct("group_id").alias("n_groups"),
        F.countDistinct("configuration").alias("n_configurations"),
        (F.count("*") == F.countDistinct("k", "m")).alias("no_repeats"),
        F.bool_and(is_finite(F.col("value")) & (F.col("value") >= 0)).alias("valid_values"),
    ).withColumn(
        "comparable",
        (F.col("n_signatures") == 1) & (F.col("n_groups") == 1) & (F.col("n_configurations") == 1)
        & F.col("no_repeats") & F.col("valid_values"),
    )


def named(ranking: DataFrame, names: DataFrame) -> DataFrame:
    """Attach descriptions; a key without one stays."""
    return ranking.join(names, "k", "left")
