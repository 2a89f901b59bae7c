"""Series derived from the given tables.

A series table has a key `k`, a whole-number period `m` and a nullable count `y`. Every builder aggregates to
(key, period) first, so whatever follows works on rows whose number per key is bounded by the calendar.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspan.config import SCOPE, StudyScope
from tallyspan.functions import calendar as cal
from tallyspan.operators.grid import dense_grid
from tallyspan.session import settle
from tallyspan.sources.tables import table

__all__ = ["brand_monthly", "orders_monthly", "reported_brands", "settle", "user_daily", "weekly_reports"]


def _with_index(df: DataFrame) -> DataFrame:
    return df.withColumn("m", cal.month_index(F.col("year"), F.col("month")))


def within_months(df: DataFrame, column: str, months: tuple[int, int] | None) -> DataFrame:
    """Rows of a range of month indexes, as a plain comparison on the time column so that it reaches the scan."""
    if months is None:
        return df
    first, after = (datetime.datetime(m // 12, m % 12 + 1, 1) for m in (months[0], months[1] + 1))
    return df.filter((F.col(column) >= F.lit(first).cast("timestamp_ntz")) & (F.col(column) < F.lit(after).cast("timestamp_ntz")))


def orders_monthly(spark: SparkSession, folder: str, *extra_keys: str) -> DataFrame:
    """Orders per priority and month; extra order columns may widen the key."""
    orders = table(spark, folder, "orders", "o_orderpriority", "o_orderdate", *extra_keys)
    key = F.concat_ws("/", F.col("o_orderpriority"), *[F.col(c) for c in extra_keys])
    return _with_index(
        orders.groupBy(
            key.alias("k"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.month("o_orderdate").cast("bigint").alias("month"),
        ).agg(F.count("*").alias("y"))
    )


def brand_monthly(spark: SparkSession, folder: str, months: tuple[int, int] | None = None) -> DataFrame:
    """Shipped quantity per brand and month. Line items meet the parts first: the sum by brand then combines before its shuffle."""
    lines = within_months(table(spark, folder, "lineitem", "l_partkey", "l_shipdate", "l_quantity"), "l_shipdate", months)
    parts = table(spark, folder, "part", "p_partkey", "p_brand")
    return _with_index(
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(
            F.col("p_brand").alias("k"),
            F.year("l_shipdate").cast("bigint").alias("year"),
            F.month("l_shipdate").cast("bigint").alias("month"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("y"))
    )


def user_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Errors per user and day on a full grid: a day without any event is missing, one without errors is zero."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type")
    seen = events.groupBy(
        F.col("user_id").alias("k"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint").alias("m")
    ).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("y"))
    return dense_grid(settle(seen)).withColumn("observed", F.col("y").isNotNull())


def reported_brands(spark: SparkSession, folder: str, scope: StudyScope = SCOPE) -> DataFrame:
    """What a yearly top-n report would contain: the n largest keys of every reported year, month by month.

    The rank filter becomes a group limit before the shuffle, so each task sends at most n keys per year.
    """
    months = (scope.first_year * 12, scope.last_year * 12 + 11)
    cells = settle(brand_monthly(spark, folder, months).filter(F.col("year").isin(list(scope.available_years))))
    yearly = cells.groupBy("year", "k").agg(F.sum("y").alias("total"))
    order = Window.partitionBy("year").orderBy(F.desc("total"), "k")
    kept = yearly.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= scope.annual_limit)
    return settle(cells.join(kept, ["year", "k"], "left_semi").select("k", "year", "month", "m", "y"))


def weekly_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Finished orders per nation and source week (days 1-7 of the year are week 1, and so on to week 53).

    A week whose orders are all still pending is blank; a week without a finished order is zero; a week without orders
    is absent. Orders meet the customers first, so that the counts by nation combine before their shuffle.
    """
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    located = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return (
        orders.join(located, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("n_name").alias("k"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            (F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1).cast("bigint").alias("week"),
        )
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"),
            F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("pending"),
            F.min(F.to_date("o_orderdate")).alias("first_date"),
            F.min("o_orderkey").alias("source_row"),
        )
        .select(
            "k", "year", "week",
            F.when(F.col("pending") < F.col("n"), F.col("done")).alias("y"),
            F.when(F.col("n") % 7 == 0, F.lit(None).cast("string"))
            .when(F.col("n") % 5 == 0, F.lit("Incomplete"))
            .otherwise(F.lit("complete")).alias("reporting_status"),
            F.when(F.col("n") % 2 == 0, F.col("first_date")).alias("week_start_date"),
            "source_row",
        )
    )
