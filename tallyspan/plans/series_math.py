"""Queries on lags, differences, decomposition and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.operators import forecast, lags
from tallyspan.operators.grid import dense_grid
from tallyspan.plans.forecasts import rounded
from tallyspan.plans.registry import query
from tallyspan.sources import series


@query("calendar_lags")
def calendar_lags(spark, folder):
    return lags.calendar_lags(series.user_daily(spark, folder).select("k", "m", "y"), 12)


@query("seasonal_pairs")
def seasonal_pairs(spark, folder):
    return lags.seasonal_pairs(series.user_daily(spark, folder).select("k", "m", "y"), 7)


@query("differences")
def differences(spark, folder):
    return lags.differences(series.brand_monthly(spark, folder).select("k", "m", "y"))


@query("decompose")
def decompose(spark, folder):
    result = lags.decompose(series.brand_monthly(spark, folder).select("k", "m", "y"))
    return result.select("k", "m", "y", *[F.round(c, 8).alias(c) for c in ("trend", "seasonal", "remainder")])


@query("acf")
def acf(spark, folder):
    cells = series.settle(series.brand_monthly(spark, folder).select("k", "m", "y"))
    differenced = lags.differences(cells)
    known = differenced.filter(F.col("d_both").isNotNull()).select("k", "m", F.col("d_both").alias("y"))
    correlations = lags.autocorrelations(known, list(range(1, 13)))
    plain = lags.lag_correlation(cells, 12).select("k", F.col("r").alias("lag12_correlation"))
    return rounded(correlations.select("k", "n", "lag", "r").join(plain, "k"), "r", "lag12_correlation")


@query("ljung_box_q")
def ljung_box_q(spark, folder):
    fitted = forecast.trend_season(forecast.future_frame(series.settle(series.brand_monthly(spark, folder)), 1)).filter("train")
    return rounded(lags.ljung_box(fitted.select("k", "m", F.col("residual").alias("y")), [6, 12, 24]), "q")


@query("df_statistic")
def df_statistic(spark, folder):
    return rounded(lags.unit_root_screen(series.brand_monthly(spark, folder).select("k", "m", "y")), "t_statistic")


@query("zero_runs")
def zero_runs(spark, folder):
    return lags.zero_runs(series.user_daily(spark, folder).select("k", "m", "y"))


@query("yearly_totals")
def yearly_totals(spark, folder):
    return series.brand_monthly(spark, folder).groupBy("k", "year").agg(F.sum("y").alias("total"))


@query("series_arrays")
def series_arrays(spark, folder):
    """Each series packed into index and value arrays and unpacked again; rows per key are bounded by the calendar."""
    grid = dense_grid(series.settle(series.brand_monthly(spark, folder).select("k", "m", "y")))
    packed = grid.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("m", "y"))).alias("cells")).select(
        "k", F.col("cells.m").alias("index"), F.col("cells.y").alias("values")
    )
    return packed.select("k", F.explode(F.arrays_zip("index", "values")).alias("c")).select(
        "k", F.col("c.index").alias("m"), F.col("c.values").alias("y")
    )
