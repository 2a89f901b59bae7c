"""Queries on fitted models. The tests check what has no SQL form on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import MODEL
from tallyspan.functions.numeric import combine, floor_zero, is_finite, r6
from tallyspan.operators import forecast, learned, metrics, series_trees
from tallyspan.plans.registry import query
from tallyspan.sources import series


@query("residual_gbt")
def residual_gbt(spark, folder):
    """Boosted-tree corrections over the horizon, combined with the base as the linear ones are.

    Returned is what holds whatever the trees say: the keys, the base, that every value is finite, and that no correction passes its bound.
    """
    monthly = series.settle(series.orders_monthly(spark, folder))
    frame = forecast.future_frame(monthly, MODEL.horizon)
    end = monthly.agg(F.max("m")).first()[0]
    model, fitted = learned.fit_residual_trees(frame)
    corrections = learned.tree_corrections(model, fitted, end)
    base = fitted.filter(F.col("h").isNotNull()).select("k", "m", "base")
    hybrid = combine(F.col("base"), F.col("correction"), MODEL.correction_clip, MODEL.correction_weight)
    paths = corrections.join(base, ["k", "m"]).select("k", "m", "h", "base", "correction", hybrid.alias("hybrid"))
    moved = F.abs(F.col("hybrid") - floor_zero(F.col("base"))) <= MODEL.correction_clip * MODEL.correction_weight + 1e-9
    return paths.select("k", "m", "h", r6(F.col("base")).alias("base"), (is_finite(F.col("correction")) & is_finite(F.col("hybrid"))).alias("finite"), moved.alias("bounded"))


@query("residual_trees")
def residual_trees(spark, folder):
    """An ensemble of 1,000 trees for every series, its corrections over the horizon and the combined path."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    fitted = forecast.residual_rows(forecast.trend_season(forecast.future_frame(monthly, MODEL.horizon), MODEL.season), MODEL)
    fitted = series.settle(fitted.select("k", "m", "h", "base", "residual", "usable"))
    corrections = series_trees.tree_corrections(fitted, monthly.agg(F.max("m")).first()[0])
    base = fitted.filter(F.col("h").isNotNull()).select("k", "m", "base")
    hybrid = combine(F.col("base"), F.col("correction"), MODEL.correction_clip, MODEL.correction_weight)
    return corrections.join(base, ["k", "m"]).select("k", "m", "h", "n_rows", r6(F.col("base")).alias("base"), r6(F.col("correction")).alias("correction"), r6(hybrid).alias("hybrid"))


@query("base_fourier")
def base_fourier(spark, folder):
    """Hold-out error of the line with Fourier pairs for every brand."""
    paths = learned.fourier_base(forecast.backtest_frame(series.settle(series.brand_monthly(spark, folder))))
    rows = paths.filter("h is not null").select("k", F.col("y").cast("double").alias("actual"), floor_zero(F.col("base")).alias("predicted"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), metrics.mae().alias("mae"), metrics.wape().alias("wape"))
