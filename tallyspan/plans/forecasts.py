"""Queries of the forecasting, metric and ranking families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import MODEL
from tallyspan.functions.numeric import floor_zero, r6
from tallyspan.operators import coverage, forecast, lags, metrics, ranking
from tallyspan.plans.registry import query
from tallyspan.sources import series
from tallyspan.sources.tables import table

HORIZONS = [3, 6, 12]
#: Periods a series needs, without a hole, to be forecast in a batch.
BATCH_HISTORY = 60


def rounded(df, *columns):
    """Six decimals for float results."""
    return df.select(*[r6(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def backtest_paths(monthly):
    return forecast.run_workflow(forecast.backtest_frame(monthly))


def future_paths(monthly):
    return forecast.run_workflow(forecast.future_frame(monthly, MODEL.horizon))


def backtest_rows(monthly):
    return metrics.long_paths(backtest_paths(monthly).filter(F.col("y").isNotNull()), ["base", "hybrid"])


def train_rows(monthly):
    return forecast.backtest_frame(monthly).filter("train").select("k", "m", "y")


def user_frame(daily):
    """Errors per user and day: the last seven days are the targets, also where no day was observed."""
    end = daily.agg(F.max("m")).scalar()
    framed = daily.withColumn("_e", end)
    return framed.select(
        "k", "m", "y", (F.col("m") <= F.col("_e") - 7).alias("train"),
        F.when(F.col("m") > F.col("_e") - 7, F.col("m") - F.col("_e") + 7).alias("h"),
    )


def user_rows(daily):
    """User targets predicted by the mean of the training days."""
    frame = user_frame(daily)
    mean = frame.filter("train").groupBy("k").agg(F.avg("y").alias("predicted"))
    return frame.filter(F.col("h").isNotNull()).join(mean, "k").select(
        "k", "m", "h", F.col("y").cast("double").alias("actual"), "predicted", F.lit("mean").alias("model")
    )


# ---- forecasting --------------------------------------------------------------------------------------------------

@query("base_forecast")
def base_forecast(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    fitted = forecast.trend_season(forecast.backtest_frame(monthly))
    return rounded(fitted.select("k", "m", "h", "train", "trend", "seasonal", "base"), "trend", "seasonal", "base")


@query("residuals")
def residuals(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    fitted = forecast.trend_season(forecast.backtest_frame(monthly))
    return rounded(fitted.filter("train").select("k", "m", "y", "base", "residual"), "base", "residual")


@query("residual_rows")
def residual_rows(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    marked = forecast.residual_rows(forecast.trend_season(user_frame(daily), 7))
    usable = marked.filter("usable").select("k", "m", "residual")
    counted = usable.groupBy("k").agg(F.count("*").alias("n_rows"))
    return rounded(usable.join(counted, "k").withColumn("enough", F.col("n_rows") >= MODEL.min_residual_rows), "residual")


@query("complete_lag_rows")
def complete_lag_rows(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    fitted = forecast.trend_season(user_frame(daily), 7)
    return rounded(forecast.complete_lag_rows(fitted, 4).select("k", "m", "residual"), "residual")


@query("positional_lags")
def positional_lags(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    seen = daily.filter("observed").select("k", "m", "y")
    return lags.positional_lags(seen, 3)


@query("residual_ar1")
def residual_ar1(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    frame = forecast.backtest_frame(monthly)
    full = forecast.linear_correction(forecast.residual_rows(forecast.trend_season(frame)))
    one = full.groupBy("k").agg(
        F.max("phi").alias("phi"), F.max("n_residual_rows").alias("n_residual_rows"), F.max("last_residual").alias("last_residual")
    )
    return rounded(one, "phi", "last_residual")


@query("recursive_correction")
def recursive_correction(spark, folder):
    """The fold over the horizon with a three-lag rule, started from each key's last residuals."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    frame = forecast.future_frame(monthly, MODEL.horizon)
    fitted = forecast.trend_season(frame).filter(F.col("residual").isNotNull())
    end = fitted.agg(F.max("m")).scalar()
    recent = fitted.withColumn("_e", end).filter(F.col("m") > F.col("_e") - 3).withColumn("_slot", F.col("m") - F.col("_e") + 2)
    slots = [F.max(F.when(F.col("_slot") == i, F.col("residual"))).alias(f"r{i}") for i in range(3)]
    state = fitted.select("k").distinct().join(recent.groupBy("k").agg(*slots), "k", "left")
    path = forecast.recursive_path(F.array("r0", "r1", "r2"), [0.5, 0.25, 0.125], MODEL.horizon)
    exploded = state.select("k", F.posexplode(path).alias("pos", "correction"))
    return rounded(exploded.select("k", (F.col("pos") + 1).cast("bigint").alias("h"), "correction"), "correction")


@query("hybrid_combine")
def hybrid_combine(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(
        backtest_paths(monthly).select("k", "m", "h", "base", "correction", "hybrid"), "base", "correction", "hybrid"
    )


@query("hybrid_combine_raw")
def hybrid_combine_raw(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(backtest_paths(monthly).select("k", "m", "h", "hybrid_raw"), "hybrid_raw")


@query("component_check")
def component_check(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.component_check(future_paths(monthly), MODEL.horizon)


@query("backtest")
def backtest(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    rows = backtest_rows(monthly)
    scores = metrics.forecast_metrics(rows, metrics.mase_scale(train_rows(monthly), MODEL.season))
    wide = scores.groupBy("k").pivot("model", ["base", "hybrid"]).agg(
        F.first("n").alias("n"), F.first("mae").alias("mae"), F.first("rmse").alias("rmse"), F.first("mase").alias("mase")
    )
    return rounded(
        wide.select(
            "k", F.col("base_n").alias("n"), "base_mae", "base_rmse", "base_mase", "hybrid_mae", "hybrid_rmse", "hybrid_mase",
            (F.col("base_mae") - F.col("hybrid_mae")).alias("mae_improvement"),
            F.when(F.col("hybrid_mae").isNotNull(), "completed").otherwise("unavailable").alias("status"),
        ),
        "base_mae", "base_rmse", "base_mase", "hybrid_mae", "hybrid_rmse", "hybrid_mase", "mae_improvement",
    )


def fold_rows(monthly):
    """Rolling folds with the base model and the seasonal-naive benchmark, all folds of all keys in one plan."""
    folds = forecast.rolling_folds(monthly, 3, 12)
    groups = ["k", "fold"]
    start = folds.filter("train").groupBy(*groups).agg(F.max("m").alias("_end"))
    framed = folds.join(start, groups).withColumn("h", F.when(~F.col("train"), F.col("m") - F.col("_end")))
    base = forecast.trend_season(framed, groups=groups).filter(F.col("h").isNotNull()).select("k", "fold", "m", "h", "y", "base")
    naive = forecast.seasonal_naive(framed, groups=groups).select("k", "fold", "m", "naive")
    wide = base.join(naive, ["k", "fold", "m"], "left").withColumn("base", floor_zero(F.col("base")))
    return metrics.long_paths(wide, ["base", "naive"], carried=("fold",))


@query("rolling_backtest")
def rolling_backtest(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(fold_rows(monthly).groupBy("k", "model", "fold").agg(
        F.count(metrics.error()).alias("n"), metrics.mae().alias("mae"), metrics.rmse().alias("rmse")
    ), "mae", "rmse")


@query("pooled_fold_metrics")
def pooled_fold_metrics(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(fold_rows(monthly).groupBy("k", "model").agg(
        F.count(metrics.error()).alias("n"), metrics.mae().alias("mae"), metrics.rmse().alias("rmse"),
        metrics.mape().alias("mape"), metrics.wape().alias("wape"),
    ), "mae", "rmse", "mape", "wape")


@query("forecast_batch")
def forecast_batch(spark, folder):
    """Ready series forecast in one plan, each with its own outcome; the others are listed as excluded, with the reason."""
    monthly = series.settle(series.orders_monthly(spark, folder, "o_orderstatus"))
    gate = series.settle(coverage.coverage_gate(monthly, BATCH_HISTORY).select("k", "reason"))
    ready = series.settle(monthly.join(gate.filter("reason = 'ok'"), "k", "left_semi"))
    outcome = future_paths(ready).groupBy("k").agg(
        F.first("status").alias("status"), F.count("hybrid").alias("n_values"), F.first("n_train").alias("n_train"),
        F.sum("hybrid").alias("projected_total"),
    )
    batch = gate.join(outcome, "k", "left").select(
        "k", F.coalesce("status", F.lit("excluded")).alias("status"), F.when(F.col("reason") != "ok", F.col("reason")).alias("reason"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), "n_train", "projected_total",
    )
    return rounded(batch.withColumn("group_id", F.lit("batch-" + MODEL.signature[:16])), "projected_total")


@query("run_status")
def run_status(spark, folder):
    """Outcomes over many thin series, where several of the states occur."""
    daily = series.settle(series.user_daily(spark, folder))
    paths = forecast.corrected_forecast(user_frame(daily))
    return paths.groupBy("k").agg(
        F.first("status").alias("status"), F.first("n_train").alias("n_train"), F.first("n_residual_rows").alias("n_residual_rows")
    )


@query("short_span_flag")
def short_span_flag(spark, folder):
    return forecast.short_span(series.orders_monthly(spark, folder, "o_orderstatus"), 42)


@query("abstain_choice")
def abstain_choice(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(forecast.abstain_choice(forecast.corrected_forecast(user_frame(daily))), "value")


@query("terminal_gaps")
def terminal_gaps(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return forecast.terminal_gaps(daily.select("k", "m", "y"), 12)


@query("recent_mean")
def recent_mean(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(forecast.recent_mean(user_frame(daily)), "recent_mean")


@query("production_refit")
def production_refit(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(future_paths(monthly).select("k", "m", "h", "base", "correction", "hybrid", "status"), "base", "correction", "hybrid")


@query("seasonal_naive")
def seasonal_naive(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.seasonal_naive(forecast.backtest_frame(monthly))


@query("seasonal_average")
def seasonal_average(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    rows = forecast.seasonal_average(forecast.backtest_frame(monthly), [1997])
    scored = rows.select("k", F.col("y").cast("double").alias("actual"), F.col("average").alias("predicted"))
    return rounded(scored.groupBy("k").agg(metrics.mae().alias("mae"), metrics.wape().alias("wape")), "mae", "wape")


# ---- splits -------------------------------------------------------------------------------------------------------

@query("holdout_split")
def holdout_split(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.holdout_split(monthly, MODEL.min_observations)


@query("three_way_split")
def three_way_split(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.three_way_split(monthly, 12, 12)


@query("rolling_folds")
def rolling_folds(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.rolling_folds(monthly, 3, 12)


@query("split_override")
def split_override(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.split_override(monthly.select("k", "m", "year", "y"), {"2-HIGH": 1998, "5-LOW": 1999})


@query("window_variants")
def window_variants(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return forecast.window_variants(monthly, [24, 36, 48], [0, 12], 12)


# ---- metrics ------------------------------------------------------------------------------------------------------

@query("forecast_metrics")
def forecast_metrics(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    scores = metrics.forecast_metrics(backtest_rows(monthly), metrics.mase_scale(train_rows(monthly), MODEL.season))
    return rounded(scores, "mae", "rmse", "mase")


@query("mase_scale")
def mase_scale(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.mase_scale(train_rows(monthly), MODEL.season), "scale")


@query("mase_scale_fallback")
def mase_scale_fallback(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(metrics.mase_scale_fallback(daily.select("k", "m", "y"), 7), "scale")


@query("mape_profile")
def mape_profile(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(metrics.mape_profile(user_rows(daily), "k"), "mape", "mape_median_actual", "mape_p10_actual")


@query("wape")
def wape(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(user_rows(daily).groupBy("k").agg(metrics.wape().alias("wape")), "wape")


@query("score_coverage")
def score_coverage(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(metrics.score_coverage(user_rows(daily), "k"), "mae", "rmse")


@query("horizon_metrics")
def horizon_metrics(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.horizon_metrics(backtest_rows(monthly), HORIZONS), "mae", "rmse", "mape")


@query("mape_scale_risk")
def mape_scale_risk(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.mape_scale_risk(metrics.mape_profile(backtest_rows(monthly), "k", "model")), "median", "p10")


@query("selection_score")
def selection_score(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return rounded(user_rows(daily).groupBy("k").agg(metrics.selection_score().alias("score")), "score")


@query("error_band")
def error_band(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(bands(monthly), "value", "radius", "lower", "upper")


def bands(monthly):
    calibration = backtest_rows(monthly).filter("model = 'hybrid'")
    future = future_paths(monthly).select("k", "m", "h", F.col("hybrid").alias("value"))
    return metrics.error_band(calibration, future)


@query("interval_validity")
def interval_validity(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return metrics.interval_validity(bands(monthly))


@query("aligned_pairs")
def aligned_pairs(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    actual = monthly.select("k", "m", F.col("y").alias("actual"))
    predicted = backtest_paths(monthly).select("k", "m", F.col("hybrid").alias("predicted"))
    return rounded(metrics.aligned_pairs(actual, predicted), "predicted")


@query("holdout_comparison")
def holdout_comparison(spark, folder):
    """History before the hold-out and, on it, the observed value beside every model."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    history = train_rows(monthly).select(
        "k", "m", F.col("y").cast("double").alias("observed"), F.lit(None).cast("double").alias("base"),
        F.lit(None).cast("double").alias("hybrid"), F.lit("history").alias("part"),
    )
    tested = backtest_rows(monthly).groupBy("k", "m").pivot("model", ["base", "hybrid"]).agg(F.first("predicted"))
    actual = backtest_paths(monthly).select("k", "m", F.col("y").cast("double").alias("observed"))
    joined = actual.join(tested, ["k", "m"]).select("k", "m", "observed", "base", "hybrid", F.lit("holdout").alias("part"))
    return rounded(history.unionByName(joined), "base", "hybrid")


@query("component_table")
def component_table(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    columns = ["k", "h", "base", "correction", "hybrid"]
    tested = backtest_paths(monthly).select(*columns, F.lit("holdout").alias("block"))
    ahead = future_paths(monthly).select(*columns, F.lit("future").alias("block"))
    return rounded(tested.unionByName(ahead), "base", "correction", "hybrid")


@query("common_index")
def common_index(spark, folder):
    """Fitted values of two fits, compared on the periods both cover."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    a = forecast.trend_season(forecast.backtest_frame(monthly)).filter("train").select("k", "m", F.col("base").alias("a"))
    b = forecast.trend_season(forecast.future_frame(monthly, 1)).filter("train").select("k", "m", F.col("base").alias("b"))
    return rounded(a.join(b, ["k", "m"]).groupBy("k").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_gap")
    ), "mean_gap")


@query("stratum_metrics")
def stratum_metrics(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    rows = backtest_rows(monthly)
    middle = train_rows(monthly).groupBy("k").agg(F.median("y").alias("middle"))
    return rounded(metrics.stratum_metrics(rows.join(middle, "k"), F.col("middle"), HORIZONS), "mae", "mape")


@query("gain_sensitivity")
def gain_sensitivity(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    scores = backtest_rows(monthly).groupBy("k").pivot("model", ["base", "hybrid"]).agg(metrics.mae())
    wide = scores.select("k", F.col("base").alias("base_mae"), F.col("hybrid").alias("hybrid_mae"))
    return rounded(metrics.gain_sensitivity(rounded(wide, "base_mae", "hybrid_mae"), [0.0, 0.5, 1.0, 2.0]), "gain")


@query("model_verdict")
def model_verdict(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    scores = backtest_rows(monthly).groupBy("k").pivot("model", ["base", "hybrid"]).agg(
        metrics.mae().alias("mae"), metrics.rmse().alias("rmse")
    )
    differences = scores.select(
        "k", r6(F.col("hybrid_rmse") - F.col("base_rmse")).alias("rmse_difference"), r6(F.col("hybrid_mae") - F.col("base_mae")).alias("mae_difference")
    )
    return metrics.model_verdict(differences)


def _rounded_rows(monthly):
    return rounded(backtest_rows(monthly), "predicted")


@query("peak_error")
def peak_error(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.peak_error(_rounded_rows(monthly)), "predicted_peak", "size_error")


@query("direction_agreement")
def direction_agreement(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.direction_agreement(_rounded_rows(monthly)), "agreement", "difference_sd_ratio")


@query("surge_flags")
def surge_flags(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    return metrics.surge_flags(rounded(user_rows(daily), "predicted"))


@query("path_shape")
def path_shape(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    paths = future_paths(monthly).select("k", "h", r6(F.col("hybrid")).alias("value"))
    return rounded(metrics.path_shape(paths), "change", "peak")


def _outlook(monthly):
    paths = future_paths(monthly).select("k", "h", r6(F.col("hybrid")).alias("value"))
    latest = monthly.groupBy("k").agg(F.max_by("y", "m").alias("y"))
    return metrics.outlook_vs_baseline(paths, latest)


@query("outlook_vs_baseline")
def outlook_vs_baseline(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(_outlook(monthly), "change", "percent")


@query("outlook_blocks")
def outlook_blocks(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return rounded(metrics.outlook_blocks(_outlook(monthly)), "total")


@query("horizon_slice")
def horizon_slice(spark, folder):
    """The stored path cut to each offered length."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    offered = F.explode(F.filter(F.array(*[F.lit(n).cast("bigint") for n in HORIZONS]), lambda n: n >= F.col("h")))
    return rounded(future_paths(monthly).select("k", "h", "hybrid", offered.alias("horizon")), "hybrid")


@query("metric_whitelist")
def metric_whitelist(spark, folder):
    daily = series.settle(series.user_daily(spark, folder))
    scores = user_rows(daily).groupBy("k").agg(
        metrics.mae().alias("mae"), metrics.rmse().alias("rmse"), metrics.wape().alias("wape"), metrics.mape().alias("mape")
    )
    names = ["mae", "rmse", "wape", "mape"]
    packed = scores.select("k", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("metrics"))
    kept = metrics.metric_whitelist(packed).select("k", F.explode("metrics").alias("metric", "value"))
    return rounded(kept, "value")


# ---- ranking ------------------------------------------------------------------------------------------------------

@query("projected_total")
def projected_total(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return ranking.projected_total(future_paths(monthly))


@query("projected_rank")
def projected_rank(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return ranking.rank_totals(ranking.projected_total(future_paths(monthly)))


@query("projected_rank_with_error")
def projected_rank_with_error(spark, folder):
    """Flagship: series ranked by projected total, each with the hold-out errors of both models and the benchmark."""
    monthly = series.settle(series.orders_monthly(spark, folder))
    ranked = ranking.rank_totals(ranking.projected_total(future_paths(monthly)))
    naive = forecast.seasonal_naive(forecast.backtest_frame(monthly))
    benchmark = naive.select("k", F.col("y").cast("double").alias("actual"), F.col("naive").alias("predicted")).groupBy("k").agg(
        metrics.mae().alias("naive_mae")
    )
    scores = backtest_rows(monthly).groupBy("k").pivot("model", ["base", "hybrid"]).agg(metrics.mae())
    return rounded(
        ranked.join(scores, "k", "left").join(benchmark, "k", "left").select(
            "rank", "k", "projected_total", F.col("base").alias("base_mae"), F.col("hybrid").alias("hybrid_mae"), "naive_mae"
        ),
        "base_mae", "hybrid_mae", "naive_mae",
    )


@query("top_five")
def top_five(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return ranking.top_n(ranking.projected_total(future_paths(monthly)), 5)


@query("ranking_calendar_check")
def ranking_calendar_check(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return ranking.calendar_check(future_paths(monthly), MODEL.horizon)


@query("ranking_context_check")
def ranking_context_check(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    runs = future_paths(monthly).select(
        "k", "m", F.col("hybrid").alias("value"), F.lit("s").alias("signature"), F.lit("g").alias("group_id"),
        F.lit(MODEL.signature).alias("configuration"),
    )
    return ranking.context_check(runs)


@query("ranking_named")
def ranking_named(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    ranked = ranking.rank_totals(ranking.projected_total(future_paths(monthly)))
    orders = table(spark, folder, "orders", "o_orderpriority")
    names = orders.groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.first(F.initcap(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))).alias("description")
    )
    return ranking.named(ranked, names)


@query("candidate_grid")
def candidate_grid(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    return candidates(monthly.select("k").distinct())


def candidates(keys):
    """Every key with every model setting of the search."""
    settings = F.explode(F.array(*[
        F.struct(F.lit(f"{kind}-{season}").alias("candidate"), F.lit(kind).alias("kind"), F.lit(season).cast("bigint").alias("season"))
        for kind in ("level", "trend") for season in (1, 3, 6, 12)
    ]))
    return keys.select("k", settings.alias("c")).select("k", "c.candidate", "c.kind", "c.season")
