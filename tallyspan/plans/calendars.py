"""Queries of the calendar family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import MODEL, SCOPE
from tallyspan.functions import calendar as cal
from tallyspan.functions.text import date_text
from tallyspan.operators import coverage, grid
from tallyspan.plans.registry import query
from tallyspan.sources import series
from tallyspan.sources.tables import table


def _order_years(spark, folder):
    return table(spark, folder, "orders", "o_orderdate").select(
        F.year("o_orderdate").cast("bigint").alias("year")
    ).distinct()


@query("mmwr_week1")
def mmwr_week1(spark, folder):
    return _order_years(spark, folder).select(
        "year", date_text(cal.first_week_start(F.col("year"))).alias("week1_start")
    )


@query("mmwr_week_start")
def mmwr_week_start(spark, folder):
    return series.weekly_reports(spark, folder).select(
        "k", "year", "week", date_text(cal.week_start(F.col("year"), F.col("week"))).alias("week_start")
    )


@query("mmwr_year_length")
def mmwr_year_length(spark, folder):
    return _order_years(spark, folder).select("year", cal.year_length(F.col("year")).alias("weeks"))


@query("iso_week_to_month")
def iso_week_to_month(spark, folder):
    m = cal.iso_week_month_index(F.col("year"), F.col("week"))
    return series.weekly_reports(spark, folder).select(
        "k", "year", "week", cal.index_year(m).alias("month_year"), cal.index_month(m).alias("month")
    )


@query("reporting_period")
def reporting_period(spark, folder):
    day = F.coalesce("week_start_date", cal.week_start(F.col("year"), F.col("week")))
    return series.weekly_reports(spark, folder).select(
        "k", "year", "week",
        cal.week_label(F.col("year"), F.col("week")).alias("period_week"),
        F.date_format(day, "yyyy-MM").alias("period_month"),
        F.format_string("%04dQ%d", F.year(day), F.quarter(day)).alias("period_quarter"),
    )


@query("forecast_calendar")
def forecast_calendar(spark, folder):
    return coverage.forecast_calendar(series.settle(series.orders_monthly(spark, folder)), MODEL.horizon).select(
        "k", "h", "m", cal.month_label(F.col("m")).alias("month_label")
    )


@query("month_names")
def month_names(spark, folder):
    return series.orders_monthly(spark, folder).select("k", "m", cal.month_name(F.col("m")).alias("month_name"))


@query("display_times")
def display_times(spark, folder):
    """Event times for readers at +8 hours; events of the first user come without a time."""
    events = table(spark, folder, "events", "event_id", "user_id", "ts")
    return events.select("event_id", cal.display_time(F.when(F.col("user_id") > 1, F.col("ts"))).alias("shown"))


@query("week_advance")
def week_advance(spark, folder):
    return coverage.advance_weeks(series.settle(series.weekly_reports(spark, folder)), 300)


@query("dense_grid")
def dense_grid(spark, folder):
    return grid.study_grid(
        series.reported_brands(spark, folder), SCOPE.first_year, SCOPE.last_year, SCOPE.unavailable_years
    )


@query("weekly_grid")
def weekly_grid(spark, folder):
    return grid.weekly_grid(series.settle(series.weekly_reports(spark, folder)))


@query("zero_fill_gated")
def zero_fill_gated(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder, "o_orderstatus"))
    return grid.zero_filled(monthly, coverage.coverage_gate(monthly, minimum=60))
