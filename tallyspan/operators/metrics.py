"""Scores of forecast paths.

Most functions take long rows: key columns, `h` (place in the path), `actual` and `predicted`. Null actuals are never
scored and never count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.numeric import floor_zero, is_close, is_finite, percent_of
from tallyspan.operators.lags import seasonal_pairs

# Limits of the shape heuristics.
SURGE_RATIO = 2.0
SURGE_EXCESS = 10.0
SURGE_TIMING = 4
SURGE_SHARE = 0.5
SMOOTH_RATIO = 0.5
MAPE_FLOOR = 10.0
RMSE_RTOL = 1e-6
RMSE_ATOL = 1e-8
METRIC_FIELDS = (
    "mae", "rmse", "mape", "mape_n", "mape_median_actual", "mape_p10_actual", "n", "test_positions_total",
    "observations_scored", "missing_actuals_excluded", "mape_valid_observations", "zero_actuals_excluded_from_mape",
)


def long_paths(paths: DataFrame, models: list[str], actual: str = "y", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, period and model; further key columns are carried along."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("predicted")) for m in models]))
    return paths.select("k", *carried, "m", "h", F.col(actual).cast("double").alias("actual"), values.alias("v")).select(
        "k", *carried, "m", "h", "actual", F.col("v.model").alias("model"), F.col("v.predicted").alias("predicted")
    )


def error() -> Column:
    return F.when(F.col("actual").isNotNull(), F.col("actual") - F.col("predicted"))


def mae() -> Column:
    return F.avg(F.abs(error()))


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mape() -> Column:
    return F.avg(F.when(F.col("actual") != 0, F.abs(error()) / F.abs(F.col("actual")))) * 100


def wape() -> Column:
    total = F.sum(F.when(F.col("predicted").isNotNull(), F.abs(F.col("actual"))))
    return percent_of(F.sum(F.abs(error())), total)


def mase_scale(train: DataFrame, season: int = 12) -> DataFrame:
    """Mean absolute seasonal difference over calendar-true training pairs; null without pairs or when it is zero."""
    pairs = seasonal_pairs(train, season).groupBy("k").agg(
        F.avg(F.abs(F.col("y") - F.col("previous"))).alias("scale"), F.count("*").alias("n_pairs")
    )
    return train.select("k").distinct().join(pairs, "k", "left").select(
        "k", F.coalesce("n_pairs", F.lit(0).cast("bigint")).alias("n_pairs"), F.when(F.col("scale") > 0, F.col("scale")).alias("scale")
    )


def mase_scale_fallback(df: DataFrame, season: int = 12) -> DataFrame:
    """Positional variant: seasonal differences by row order, then ordinary ones, then one."""
    order = Window.partitionBy("k").orderBy("m")
    framed = df.filter(F.col("y").isNotNull()).select(
        "k", F.abs(F.col("y") - F.lag("y", season).over(order)).alias("ds"), F.abs(F.col("y") - F.lag("y", 1).over(order)).alias("d1")
    )
    sums = framed.groupBy("k").agg(F.avg("ds").alias("a"), F.avg("d1").alias("b"))
    return sums.select("k", F.coalesce(
        F.when(F.col("a") > 0, F.col("a")), F.when(F.col("b") > 0, F.col("b")), F.lit(1.0)
    ).alias("scale"))


def forecast_metrics(rows: DataFrame, scale: DataFrame) -> DataFrame:
    scored = rows.groupBy("k", "model").agg(F.count(error()).alias("n"), mae().alias("mae"), rmse().alias("rmse"))
    return scored.join(scale.select("k", "scale"), "k", "left").select(
        "k", "model", "n", "mae", "rmse", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")).alias("mase")
    )


def mape_profile(rows: DataFrame, *keys: str) -> DataFrame:
    nonzero = F.when((F.col("actual") != 0) & F.col("predicted").isNotNull(), F.col("actual"))
    return rows.groupBy(*keys).agg(
        mape().alias("mape"), F.count(nonzero).alias("mape_n"), F.median(nonzero).alias("mape_median_actual"),
        F.percentile(nonzero, F.lit(0.1)).alias("mape_p10_actual"), F.count(error()).alias("n"),
    )


def mape_scale_risk(profile: DataFrame, floor: float = MAPE_FLOOR) -> DataFrame:
    """Note for keys whose typical or seasonal-low actuals are too small for a percentage."""
    worst = profile.groupBy("k").agg(
        F.bool_and(F.col("mape").isNotNull()).alias("ok"),
        F.max("mape_median_actual").alias("median"), F.max("mape_p10_actual").alias("p10"),
    )
    note = F.when(~F.col("ok"), F.lit("none")).when(
        (F.col("median") >= floor) & (F.col("p10") >= floor / 2), F.lit("none")
    ).when(F.col("p10") < floor / 2, F.lit("low_tail")).otherwise(F.lit("low_median"))
    return worst.select("k", "median", "p10", note.alias("risk"))


def score_coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """What was scored and what was left out, with predictions floored at zero."""
    floored = rows.withColumn("predicted", floor_zero(F.col("predicted")))
    return floored.groupBy(*keys).agg(
        F.count("*").alias("test_positions_total"),
        F.count("actual").alias("observations_scored"),
        F.count(F.when(F.col("actual").isNull(), 1)).alias("missing_actuals_excluded"),
        F.count(F.when(F.col("actual") == 0, 1)).alias("zero_actuals_excluded_from_mape"),
        mae().alias("mae"), rmse().alias("rmse"),
    )


def horizon_metrics(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """Scores of every prefix of the path."""
    prefix = F.explode(F.filter(F.array(*[F.lit(h).cast("bigint") for h in horizons]), lambda n: n >= F.col("h")))
    return rows.select("*", prefix.alias("horizon")).groupBy("k", "model", "horizon").agg(
        F.count(error()).alias("n"), mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape")
    )


def selection_score() -> Column:
    """WAPE, or MAE where all actuals are zero."""
    return F.coalesce(wape(), mae())


def error_band(calibration: DataFrame, future: DataFrame) -> DataFrame:
    """Largest absolute calibration error around each future value, floored at zero."""
    radius = calibration.groupBy("k").agg(F.max(F.abs(error())).alias("radius"), F.count(error()).alias("n_errors"))
    return future.join(radius, "k").select(
        "k", "m", "h", "value", "radius", "n_errors",
        floor_zero(F.col("value") - F.col("radius")).alias("lower"), (F.col("value") + F.col("radius")).alias("upper"),
    )


def aligned_pairs(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Full outer alignment on key and period; a side that is absent is named instead of dropped."""
    return actual.select("k", "m", "actual").join(predicted.select("k", "m", "predicted"), ["k", "m"], "full_outer").select(
        "k", "m", "actual", "predicted",
        F.when(F.col("actual").isNull(), "actual_missing").when(F.col("predicted").isNull(), "prediction_missing").otherwise("aligned").alias("alignment"),
    )


def stratum_metrics(rows: DataFrame, threshold: Column, horizons: list[int]) -> DataFrame:
    """Scores of each horizon prefix, apart for actuals below the threshold and the others."""
    prefix = F.explode(F.filter(F.array(*[F.lit(h).cast("bigint") for h in horizons]), lambda n: n >= F.col("h")))
    part = F.when(F.col("actual") < threshold, "below").otherwise("at_or_above")
    return rows.filter(F.col("actual").isNotNull()).select("*", prefix.alias("horizon"), part.alias("stratum")).groupBy(
        "k", "model", "horizon", "stratum"
    ).agg(F.count(error()).alias("n"), mae().alias("mae"), mape().alias("mape"))


def rank_correlation(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation per key, ties share their mean rank. Rows per key are the candidates of one search."""
    def mean_rank(column: str) -> Column:
        ties = F.count("*").over(Window.partitionBy("k", column))
        return F.rank().over(Window.partitionBy("k").orderBy(column)) + (ties - 1) / 2

    return scores.withColumn("_a", mean_rank(a)).withColumn("_b", mean_rank(b)).groupBy("k").agg(
        F.corr("_a", "_b").alias("rho"), F.count("*").alias("n")
    )


def gain_sensitivity(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Which model is chosen when the hybrid must gain at least a threshold in MAE."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return scores.select("k", (F.col("base_mae") - F.col("hybrid_mae")).alias("gain"), steps.alias("threshold")).select(
        "k", "threshold", "gain", F.when(F.col("gain") > F.col("threshold"), "hybrid").otherwise("base").alias("choice")
    )


def seed_median(runs: DataFrame, *keys: str) -> DataFrame:
    """Median scores over seeds, only where every seed succeeded."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"), F.bool_and("ok").alias("all_ok"), F.median("mae").alias("_mae"), F.median("rmse").alias("_rmse")
    ).select(*keys, "n_seeds", "all_ok", F.when(F.col("all_ok"), F.col("_mae")).alias("mae"), F.when(F.col("all_ok"), F.col("_rmse")).alias("rmse"))


def tolerant_winner(scores: DataFrame, name: str = "candidate") -> DataFrame:
    """Smallest RMSE within tolerance, then MAE, then MAPE, then name."""
    best = F.min("rmse").over(Window.partitionBy("k"))
    order = [F.asc("mae"), F.asc(F.coalesce("mape", F.lit(float("inf")))), F.asc(name)]
    tied = scores.withColumn("_b", best).filter(is_close(F.col("rmse"), F.col("_b"), RMSE_RTOL, RMSE_ATOL))
    return tied.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("_r = 1").drop("_b", "_r")


def shortlist(scores: DataFrame, criterion: str, n: int, name: str = "candidate") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.asc(criterion), F.asc(name)))
    return scores.withColumn("place", place.cast("bigint")).filter(F.col("place") <= n)


def model_verdict(wide: DataFrame) -> DataFrame:
    """Plain verdict from the signs of the differences in RMSE and MAE (challenger minus base)."""
    a, b = F.signum(F.col("rmse_difference")), F.signum(F.col("mae_difference"))
    return wide.withColumn(
        "verdict",
        F.when((a == 0) & (b == 0), "similar").when((a <= 0) & (b <= 0), "better").when((a >= 0) & (b >= 0), "worse").otherwise("mixed"),
    )


def peak_error(rows: DataFrame) -> DataFrame:
    """Place and size of the highest value on observed positions, earliest on ties, actual against predicted."""
    seen = rows.filter(F.col("actual").isNotNull())
    return seen.groupBy("k", "model").agg(
        F.min_by("h", F.struct((-F.col("actual")).alias("v"), F.col("h").alias("p"))).alias("actual_peak_h"),
        F.max("actual").alias("actual_peak"),
        F.min_by("h", F.struct((-F.col("predicted")).alias("v"), F.col("h").alias("p"))).alias("predicted_peak_h"),
        F.max("predicted").alias("predicted_peak"),
    ).withColumn("timing_error", F.col("predicted_peak_h") - F.col("actual_peak_h")).withColumn(
        "size_error", F.col("predicted_peak") - F.col("actual_peak")
    )


def direction_agreement(rows: DataFrame) -> DataFrame:
    """Share of equal directions over neighbouring observed positions; pairs never bridge a missing one."""
    order = Window.partitionBy("k", "model").orderBy("h")
    adjacent = F.col("h") - F.lag("h").over(order) == 1
    change = F.when(adjacent, F.col("actual") - F.lag("actual").over(order))
    guess = F.when(adjacent, F.col("predicted") - F.lag("predicted").over(order))
    framed = rows.filter(F.col("actual").isNotNull()).select("k", "model", change.alias("c"), guess.alias("g"))
    sums = framed.groupBy("k", "model").agg(
        F.count("c").alias("pairs"),
        F.avg(F.when(F.col("c").isNotNull(), (F.signum("c") == F.signum("g")).cast("double"))).alias("agreement"),
        F.stddev_pop("c").alias("sd_c"), F.stddev_pop("g").alias("sd_g"),
    )
    ratio = F.when(F.col("sd_c") > 0, F.col("sd_g") / F.col("sd_c"))
    return sums.select(
        "k", "model", "pairs", "agreement", ratio.alias("difference_sd_ratio"),
        F.coalesce(ratio < SMOOTH_RATIO, F.lit(False)).alias("smoother"),
    )


def surge_flags(rows: DataFrame) -> DataFrame:
    """Clear surge in the actuals, and whether a model missed its place or its size."""
    middle = rows.groupBy("k", "model").agg(F.median("actual").alias("median"))
    joined = peak_error(rows).join(middle, ["k", "model"])
    surge = (F.col("actual_peak") >= SURGE_RATIO * F.col("median")) & (F.col("actual_peak") - F.col("median") >= SURGE_EXCESS)
    missed = (F.abs("timing_error") > SURGE_TIMING) | (F.abs("size_error") > SURGE_SHARE * F.col("actual_peak"))
    return joined.select("k", "model", "median", surge.alias("surge"), (surge & missed).alias("missed_surge"))


def path_shape(paths: DataFrame) -> DataFrame:
    """First-to-last change, monotone flags and peak of every path."""
    order = Window.partitionBy("k").orderBy("h")
    stepped = paths.withColumn("_d", F.col("value") - F.lag("value").over(order))
    return stepped.groupBy("k").agg(
        (F.max_by("value", "h") - F.min_by("value", "h")).alias("change"),
        F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("nondecreasing"),
        F.coalesce(F.bool_and(F.col("_d") <= 0), F.lit(True)).alias("nonincreasing"),
        F.min_by("h", F.struct((-F.col("value")).alias("v"), F.col("h").alias("p"))).alias("peak_h"),
        F.max("value").alias("peak"),
    )


def outlook_vs_baseline(paths: DataFrame, latest: DataFrame) -> DataFrame:
    """Each projected value against the latest observed one; no percentage over a zero baseline."""
    change = F.col("value") - F.col("baseline")
    return paths.join(latest.select("k", F.col("y").cast("double").alias("baseline")), "k").select(
        "k", "h", "value", "baseline", change.alias("change"),
        percent_of(change, F.col("baseline")).alias("percent"),
        F.when(change > 0, "above").when(change < 0, "below").otherwise("at").alias("position"),
    )


def outlook_blocks(outlook: DataFrame, size: int = 4) -> DataFrame:
    return outlook.groupBy("k", (F.floor((F.col("h") - 1) / size) + 1).cast("bigint").alias("block")).agg(
        F.min("h").alias("first_h"), F.max("h").alias("last_h"), F.sum("value").alias("total"),
        F.count(F.when(F.col("position") == "above", 1)).alias("n_above"),
    )


def interval_validity(bands: DataFrame) -> DataFrame:
    """Per key: every interval is finite and holds its value."""
    good = is_finite(F.col("lower")) & is_finite(F.col("upper")) & (F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper"))
    return bands.groupBy("k").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))


def metric_whitelist(named_values: DataFrame, fields: tuple[str, ...] = METRIC_FIELDS) -> DataFrame:
    """Keep the supported entries of a metric map."""
    return named_values.withColumn("metrics", F.map_filter("metrics", lambda name, _: name.isin(list(fields))))
