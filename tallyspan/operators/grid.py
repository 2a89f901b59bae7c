"""Full calendars. A grid row without a source row keeps a null count; nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions import calendar as cal


def span(df: DataFrame, column: str = "m") -> Column:
    """First and last period of the whole table, as a one-row subquery."""
    return df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()


def dense_grid(df: DataFrame, key: str = "k", period: str = "m", own_span: bool = False) -> DataFrame:
    """Every key with every period, of the table's span or of the key's own span.

    The periods come from exploding a sequence on each key row, so no join between keys and periods is needed.
    """
    if own_span:
        keys = df.groupBy(key).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    else:
        keys = (
            df.select(key).distinct().withColumn("_s", span(df, period))
            .select(key, F.col("_s.lo").alias("_lo"), F.col("_s.hi").alias("_hi"))
        )
    cells = keys.select(key, F.explode(F.sequence("_lo", "_hi")).alias(period))
    return cells.join(df, [key, period], "left")


def study_grid(reported: DataFrame, first_year: int, last_year: int, unavailable: tuple[int, ...]) -> DataFrame:
    """Every key in every month of the study, with a status that says why a count is absent."""
    lo, hi = first_year * 12, last_year * 12 + 11
    cells = reported.select("k").distinct().select("k", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("m"))
    cells = cells.withColumn("m", F.col("m").cast("bigint"))
    year = cal.index_year(F.col("m"))
    presence = reported.filter(F.col("y").isNotNull()).groupBy("k", "year").agg(F.lit(True).alias("present"))
    return (
        cells.join(reported.select("k", "m", "y"), ["k", "m"], "left")
        .withColumn("year", year)
        .join(presence, ["k", "year"], "left")
        .select(
            "k", "m", "year", cal.index_month(F.col("m")).alias("month"), "y",
            F.when(F.col("y") == 0, "observed_zero")
            .when(F.col("y").isNotNull(), "observed")
            .when(F.col("year").isin(list(unavailable)), "report_unavailable")
            .otherwise("outside_annual_top").alias("status"),
            F.coalesce(F.col("present"), F.lit(False)).alias("present"),
            (~F.col("year").isin(list(unavailable))).alias("year_available"),
        )
    )


def weekly_grid(df: DataFrame) -> DataFrame:
    """Each key from its first row to its last complete row, year by year under the reporting calendar.

    The last year stops at the last complete week and the others at week 52 or 53. Only complete rows bring a count.
    """
    position = F.struct(F.col("year").alias("year"), F.col("week").alias("week"))
    complete = F.lower(F.coalesce("reporting_status", F.lit("unknown"))) == "complete"
    spans = df.groupBy("k").agg(F.min(position).alias("s"), F.max(F.when(complete, position)).alias("e"))
    spans = spans.filter(F.col("e").isNotNull())
    years = spans.select("k", "s", "e", F.explode(F.sequence("s.year", "e.year")).alias("year"))
    top = F.when(F.col("year") == F.col("e.year"), F.col("e.week")).otherwise(cal.year_length(F.col("year")))
    low = F.when(F.col("year") == F.col("s.year"), F.col("s.week")).otherwise(F.lit(1))
    weeks = (
        years.withColumn("_lo", low.cast("bigint")).withColumn("_hi", top.cast("bigint"))
        .filter(F.col("_lo") <= F.col("_hi"))
        .select("k", "year", F.explode(F.sequence("_lo", "_hi")).alias("week"))
    )
    return weeks.join(df.filter(complete).select("k", "year", "week", "y"), ["k", "year", "week"], "left")


def zero_filled(df: DataFrame, gate: DataFrame) -> DataFrame:
    """Holes become zero only for keys the coverage gate passed; the others are not returned."""
    passed = gate.filter(F.col("reason") == "ok").select("k")
    grid = dense_grid(df, own_span=True).join(passed, "k", "left_semi")
    return grid.select("k", "m", F.coalesce("y", F.lit(0).cast("bigint")).alias("y"))
