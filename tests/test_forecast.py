import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.config import ModelSettings
from tallyspan.operators import forecast, lags, learned, metrics, ordering, ranking, search

S = "k string, m long, y long"


def test_lags_follow_the_calendar_across_a_hole(spark, rows):
    df = spark.createDataFrame([("a", 2019 * 12 + 11, 3), ("a", 2021 * 12, 4), ("a", 2021 * 12 + 1, 5)], S)
    found = {r.m: r for r in lags.calendar_lags(df, 12).collect()}
    assert all(found[2021 * 12][f"lag{i}"] is None for i in range(1, 13))
    assert found[2021 * 12 + 1].lag1 == 4
    positional = {r.m: r for r in lags.positional_lags(df, 1).collect()}
    assert positional[2021 * 12].row_lag1 == 3


def test_zero_run_is_reported_at_the_third_zero_once(spark, rows):
    values = [0, 0, 0, 0, 5, 0, 0, None, 0, 0, 0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], S)
    assert rows(lags.zero_runs(df)) == [("a", 2), ("a", 10)]


def test_decomposition_recovers_its_parts(spark):
    season = [math.sin(2 * math.pi * i / 12) * 10 for i in range(12)]
    df = spark.createDataFrame([("a", i, 2.0 * i + season[i % 12]) for i in range(48)], "k string, m long, y double")
    found = {r.m: r for r in lags.decompose(df).collect()}
    assert found[0].trend is None and found[47].trend is None
    assert found[20].trend == pytest.approx(40.0)
    assert found[20].seasonal == pytest.approx(season[20 % 12])
    assert lags.decompose(df.filter("m < 23")).count() == 0


def test_portmanteau_needs_a_gapless_and_long_series(spark):
    values = np.sin(np.arange(40) * 1.7)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("gap", i, float(i % 3)) for i in range(41) if i != 7], "k string, m long, y double")
    found = {(r.k, r.lag): r.q for r in lags.ljung_box(df, [4, 30]).collect()}
    c = values - values.mean()
    r = [(c[j:] * c[:-j]).sum() / (c * c).sum() for j in range(1, 5)]
    expected = 40 * 42 * sum(x * x / (40 - j) for j, x in enumerate(r, 1))
    assert found[("a", 4)] == pytest.approx(expected)
    assert found[("a", 30)] is None and found[("gap", 4)] is None


def series(spark, n=60, seed=1, key="a"):
    rng = np.random.default_rng(seed)
    data = [(key, 2000 * 12 + i, int(50 + i + 10 * math.sin(i * math.pi / 6) + rng.integers(-4, 5))) for i in range(n)]
    return spark.createDataFrame(data, S)


def test_base_model_equals_a_plain_computation(spark):
    df = series(spark, 54)
    frame = forecast.backtest_frame(df, "last_complete_year")
    found = {r.m: r for r in forecast.trend_season(frame).collect()}
    train = [(r.m, r.y) for r in frame.collect() if r.train]
    t, y = np.array([a for a, _ in train], float), np.array([b for _, b in train], float)
    slope, start = np.polyfit(t - t[0], y, 1)
    rest = y - (start + slope * (t - t[0]))
    for m in (2003 * 12 + 3, 2000 * 12 + 5):
        seasonal = rest[t % 12 == m % 12].mean()
        assert found[m].base == pytest.approx(start + slope * (m - t[0]) + seasonal)
    assert found[2003 * 12 + 3].residual is None


def test_fit_never_reads_test_counts(spark):
    df = series(spark)
    changed = df.withColumn("y", F.when(F.col("m") >= 2004 * 12, F.col("y") * 100).otherwise(F.col("y")))
    paths = lambda d: {r.m: (r.base, r.correction, r.hybrid) for r in forecast.corrected_forecast(forecast.backtest_frame(d)).collect()}
    assert paths(df) == paths(changed)
    scale = lambda d: metrics.mase_scale(forecast.backtest_frame(d).filter("train")).first().scale
    assert scale(df) == scale(changed)


def test_trailing_gap_is_bridged_by_predictions(spark):
    df = series(spark, 60).unionByName(series(spark, 57, 2, "late"))
    paths = forecast.corrected_forecast(forecast.future_frame(df, 12))
    found = {(r.k, r.h): r for r in paths.collect()}
    assert len(found) == 24 and found[("late", 1)].m == found[("a", 1)].m == 2005 * 12
    full = forecast.linear_correction(forecast.residual_rows(forecast.trend_season(forecast.future_frame(df, 12))))
    late = full.filter("k = 'late'").agg(F.max("phi"), F.max("last_residual")).first()
    assert found[("late", 1)].correction == pytest.approx(late[1] * late[0] ** 4)


def test_recursion_equals_a_loop(spark):
    weights, history = [0.5, -0.2, 0.1], [1.0, None, 3.0]
    df = spark.createDataFrame([(history,)], "h array<double>")
    found = df.select(forecast.recursive_path(F.col("h"), weights, 5)).first()[0]
    state = list(history)
    for _ in range(5):
        state.append(sum((state[-i] or 0.0) * w for i, w in enumerate(weights, 1)))
    assert found == pytest.approx(state[3:])


def test_short_and_thin_series_fail_on_their_own(spark, rows):
    df = series(spark).unionByName(spark.createDataFrame([("thin", 2004 * 12 + i, 1) for i in range(5)], S))
    paths = forecast.corrected_forecast(forecast.future_frame(df, 12))
    assert rows(paths.select("k", "status").distinct()) == [("a", "completed"), ("thin", "failed")]
    assert paths.filter("k = 'thin' and hybrid is not null").count() == 0
    chosen = forecast.abstain_choice(paths)
    assert rows(chosen.select("k", "chosen").distinct()) == [("a", "hybrid"), ("thin", "base")]


def test_component_check_and_workflow_contract(spark):
    paths = spark.createDataFrame([("a", 1.0, 1.0), ("a", float("nan"), 1.0), ("b", 1.0, 1.0)], "k string, base double, correction double")
    found = {r.k: r.status for r in forecast.component_check(paths, 2).collect()}
    assert found == {"a": "base_not_finite", "b": "wrong_length"}
    with pytest.raises(ValueError, match="lacks"):
        forecast.run_workflow(paths, lambda frame, settings: frame)


def test_naive_repeats_a_short_history(spark, rows):
    df = spark.createDataFrame([("a", 2004 * 12 + 9 + i, i + 1) for i in range(3)], S)
    found = forecast.seasonal_naive(forecast.future_frame(df, 5))
    assert rows(found, "h", "naive") == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 1.0), (5, 2.0)]


def test_scale_is_undefined_on_constant_seasons(spark):
    df = spark.createDataFrame([("a", i, i % 12) for i in range(36)], S)
    row = metrics.mase_scale(df).first()
    assert (row.n_pairs, row.scale) == (24, None)
    assert metrics.mase_scale_fallback(df).first().scale == pytest.approx(np.mean(np.abs(np.diff([i % 12 for i in range(36)]))))


def scored(spark, data):
    return spark.createDataFrame([("a", h, h, a, "x", p) for h, a, p in data], "k string, m long, h long, actual double, model string, predicted double")


def test_zero_and_missing_actuals(spark):
    df = scored(spark, [(1, 0.0, 1.0), (2, None, 5.0), (3, 4.0, 2.0)])
    row = metrics.score_coverage(df, "k").first()
    assert (row.test_positions_total, row.observations_scored, row.missing_actuals_excluded, row.zero_actuals_excluded_from_mape) == (3, 2, 1, 1)
    assert row.mae == pytest.approx(1.5)
    profile = metrics.mape_profile(df, "k").first()
    assert (profile.mape, profile.mape_n, profile.n) == (pytest.approx(50.0), 1, 2)
    zeros = scored(spark, [(1, 0.0, 1.0), (2, 0.0, 3.0)])
    assert zeros.agg(metrics.wape()).first()[0] is None
    assert zeros.agg(metrics.selection_score()).first()[0] == pytest.approx(2.0)


def test_peaks_take_the_earliest_tie_and_directions_never_bridge_a_gap(spark):
    df = scored(spark, [(1, 5.0, 1.0), (2, 5.0, 2.0), (3, None, 9.0), (4, 1.0, 9.0), (5, 2.0, 8.0)])
    peak = metrics.peak_error(df).first()
    assert (peak.actual_peak_h, peak.predicted_peak_h, peak.timing_error) == (1, 4, 3)
    row = metrics.direction_agreement(df).first()
    assert row.pairs == 2 and row.agreement == pytest.approx(0.0)


def test_ranking(spark, rows):
    totals = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0), ("x", None)], "k string, projected_total double")
    assert rows(ranking.rank_totals(totals), "rank", "k") == [(1, "c"), (2, "a"), (3, "b")]
    assert ranking.top_n(totals, 5).count() == 0
    assert rows(ranking.top_n(totals, 2), "rank", "k") == [(1, "c"), (2, "a")]


def test_positions_over_many_files_and_one_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id % 3 > 0, 0, id) AS g", "id").repartition(7)
    placed = ordering.positions_in_group(df, ["g"], ["id"]).filter("g = 0").orderBy("id").collect()
    assert [r.position for r in placed] == list(range(1, len(placed) + 1))


def test_mixed_contexts_are_not_comparable(spark):
    runs = spark.createDataFrame([("a", 1, 1.0, "s", "g", "c"), ("b", 1, 2.0, "s", "g", "other")],
                                 "k string, m long, value double, signature string, group_id string, configuration string")
    assert not ranking.context_check(runs).first().comparable
    assert ranking.context_check(runs.filter("k = 'a'")).first().comparable


def test_winner_within_tolerance_prefers_lower_mae(spark):
    scores = spark.createDataFrame([("a", "p", 1.0, 0.9, None), ("a", "q", 1.0 + 1e-9, 0.8, 1.0), ("a", "r", 2.0, 0.1, 1.0)],
                                   "k string, candidate string, rmse double, mae double, mape double")
    assert metrics.tolerant_winner(scores).first().candidate == "q"


def test_search_ignores_test_counts_and_lock_sees_changes(spark, rows):
    from tallyspan.functions.hashing import content_signature
    from tallyspan.plans.forecasts import candidates

    df = series(spark)
    grid = candidates(df.select("k").distinct())
    pick = lambda d: search.candidate_search(forecast.three_way_split(d, 12, 12), grid, 5)
    changed = df.withColumn("y", F.when(F.col("m") >= 2004 * 12, F.col("y") * 100).otherwise(F.col("y")))
    assert rows(pick(df)) == rows(pick(changed))
    mark = lambda d: content_signature(forecast.three_way_split(d, 12, 12).filter("split <> 'test'"), ["m", "y"], ["k"])
    locks = search.lock(pick(df), mark(df))
    assert search.verify_lock(locks, mark(changed)).first().lock_status == "valid"
    revised = df.withColumn("y", F.when(F.col("m") == 2001 * 12, F.col("y") + 1).otherwise(F.col("y")))
    assert search.verify_lock(locks, mark(revised)).first().lock_status == "data_changed"
    assert search.verify_lock(locks.withColumn("candidate", F.lit("z")), mark(df)).first().lock_status == "lock_altered"


def test_fourier_base_equals_least_squares(spark):
    df = series(spark, 54)
    frame = forecast.backtest_frame(df)
    found = {r.m: r.base for r in learned.fourier_base(frame, pairs=2).collect()}
    data = [(r.m, r.y) for r in frame.collect() if r.train]
    m, y = np.array([a for a, _ in data], float), np.array([b for _, b in data], float)
    design = lambda x: np.column_stack([np.ones_like(x), (x - m.min()) / 12] + [f(x * 2 * math.pi * i / 12) for i in (1, 2) for f in (np.sin, np.cos)])
    weights = np.linalg.lstsq(design(m), y, rcond=None)[0]
    expected = design(np.array([2003.0 * 12 + 4])) @ weights
    assert found[2003 * 12 + 4] == pytest.approx(expected[0], rel=1e-4)


def test_trees_give_a_full_finite_path_for_every_series(spark):
    df = series(spark, 60).unionByName(series(spark, 58, 2, "late"))
    settings = ModelSettings(tree_count=3, tree_depth=2)
    model, fitted = learned.fit_residual_trees(forecast.future_frame(df, 12), settings)
    found = learned.tree_corrections(model, fitted, 2004 * 12 + 11, settings).collect()
    assert sorted((r.k, r.h) for r in found) == [(k, h) for k in ("a", "late") for h in range(1, 13)]
    assert all(math.isfinite(r.correction) for r in found)
