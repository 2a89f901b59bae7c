"""Check SQL of the forecasting, metric and ranking families."""

from tallyspan.config import MODEL
from tallyspan.oracles import calendars  # noqa: F401  its views come before these
from tallyspan.oracles.base import VIEWS, r6

VIEWS["bt"] = """
SELECT k, m, y, m < hy * 12 AS train, CASE WHEN m >= hy * 12 THEN m - hy * 12 + 1 END AS h
FROM om JOIN (SELECT k, max(year) AS hy FROM om WHERE y IS NOT NULL GROUP BY k) USING (k)"""
VIEWS["ft"] = """
SELECT k, m, y, true AS train, NULL::BIGINT AS h FROM om
UNION ALL SELECT k, e + h, NULL, false, h
FROM (SELECT DISTINCT k FROM om), (SELECT max(m) AS e FROM om), (SELECT unnest(range(1, 13)) AS h)"""
VIEWS["f1"] = """
SELECT k, m, y, true AS train, NULL::BIGINT AS h FROM om
UNION ALL SELECT k, e + 1, NULL, false, 1 FROM (SELECT DISTINCT k FROM om), (SELECT max(m) AS e FROM om)"""
VIEWS["uf"] = """
SELECT k, m, y, m <= e - 7 AS train, CASE WHEN m > e - 7 THEN m - e + 7 END AS h FROM ud, (SELECT max(m) AS e FROM ud)"""
VIEWS["urows"] = """
SELECT k, m, h, y::DOUBLE AS actual, p AS predicted
FROM uf JOIN (SELECT k, avg(y) AS p FROM uf WHERE train GROUP BY k) USING (k) WHERE h IS NOT NULL"""


def forecast_views(p: str, frame: str, season: int = 12) -> None:
    VIEWS[f"{p}_m0"] = f"""
SELECT k, min(m) AS m0, count(*)::BIGINT AS n_train, avg(y) AS mean_y FROM {frame} WHERE train AND y IS NOT NULL GROUP BY k"""
    VIEWS[f"{p}_co"] = f"""
SELECT k, any_value(m0) AS m0, any_value(n_train) AS n_train, any_value(mean_y) AS mean_y,
       CASE WHEN count(*) > 1 THEN regr_slope(y::DOUBLE, (m - m0)::DOUBLE) END AS b,
       CASE WHEN count(*) > 1 THEN regr_intercept(y::DOUBLE, (m - m0)::DOUBLE) END AS a
FROM {frame} JOIN {p}_m0 USING (k) WHERE train AND y IS NOT NULL GROUP BY k"""
    VIEWS[f"{p}_tr"] = f"""
SELECT f.k, f.m, f.y, f.train, f.h, coalesce(a + b * (m - m0), mean_y) AS trend, n_train
FROM {frame} f LEFT JOIN {p}_co USING (k)"""
    VIEWS[f"{p}_se"] = f"""
SELECT k, m % {season} AS ph, avg(y - trend) AS s FROM {p}_tr WHERE train AND y IS NOT NULL GROUP BY 1, 2"""
    VIEWS[f"{p}_fit"] = f"""
SELECT t.*, coalesce(s, 0.0::DOUBLE) AS seasonal, trend + coalesce(s, 0.0::DOUBLE) AS base,
       CASE WHEN train THEN y - (trend + coalesce(s, 0.0::DOUBLE)) END AS residual
FROM {p}_tr t LEFT JOIN {p}_se e ON e.k = t.k AND e.ph = t.m % {season}"""
    VIEWS[f"{p}_res"] = f"SELECT k, m, residual AS r FROM {p}_fit WHERE residual IS NOT NULL"
    VIEWS[f"{p}_use"] = f"""
SELECT r.k, r.m, r.r, l.r AS r1
FROM {p}_res r LEFT JOIN {p}_res l ON l.k = r.k AND l.m = r.m - 1
WHERE r.m >= (SELECT min(m) FROM {p}_res z WHERE z.k = r.k) + 12
  AND EXISTS (SELECT 1 FROM {p}_res x WHERE x.k = r.k AND x.m BETWEEN r.m - 12 AND r.m - 1)"""
    VIEWS[f"{p}_phi"] = f"""
SELECT k, coalesce(n, 0)::BIGINT AS n_residual_rows, phi, last_m, last_r
FROM (SELECT k, max(m) AS last_m, max_by(r, m) AS last_r FROM {p}_res GROUP BY k)
LEFT JOIN (SELECT k, count(*) AS n, sum(r * r1) / nullif(sum(r1 * r1), 0) AS phi FROM {p}_use GROUP BY k) USING (k)"""
    VIEWS[f"{p}_raw"] = f"""
SELECT f.k, f.m, f.h, f.y, coalesce(f.n_train, 0) AS n_train, coalesce(n_residual_rows, 0) AS n_residual_rows, phi, base,
       CASE WHEN f.m > last_m THEN last_r * pow(phi, f.m - last_m) END AS correction
FROM {p}_fit f LEFT JOIN {p}_phi USING (k) WHERE h IS NOT NULL"""
    VIEWS[f"{p}_st"] = f"""
SELECT *, CASE WHEN n_train < 17 THEN 'failed' WHEN base IS NULL THEN 'base_failed'
               WHEN n_residual_rows < 5 THEN 'residual_insufficient'
               WHEN correction IS NULL THEN 'residual_failed' ELSE 'completed' END AS status FROM {p}_raw"""
    VIEWS[f"{p}_out"] = f"""
SELECT k, m, h, y, n_train, n_residual_rows, phi, status, CASE WHEN base IS NOT NULL THEN greatest(0.0, base) END AS base, correction,
       CASE WHEN status = 'completed'
            THEN greatest(0.0, greatest(0.0, base) + 0.1 * greatest(-1.0, least(1.0, correction))) END AS hybrid,
       CASE WHEN status = 'completed' THEN greatest(0.0, base + correction) END AS hybrid_raw
FROM {p}_st"""


forecast_views("b", "bt")
forecast_views("f", "ft")
VIEWS["fq"] = """
SELECT k, m, y, true AS train, NULL::BIGINT AS h FROM oms WHERE k IN (SELECT k FROM gate60 WHERE reason = 'ok')
UNION ALL SELECT k, e + h, NULL, false, h
FROM (SELECT k FROM gate60 WHERE reason = 'ok'), (SELECT max(m) AS e FROM oms WHERE k IN (SELECT k FROM gate60 WHERE reason = 'ok')), (SELECT unnest(range(1, 13)) AS h)"""
forecast_views("q", "fq")
forecast_views("u", "uf")
forecast_views("u7", "uf", 7)

VIEWS["mp"] = """
SELECT k, m, h, y::DOUBLE AS actual, 'base' AS model, base::DOUBLE AS predicted FROM b_out WHERE y IS NOT NULL
UNION ALL SELECT k, m, h, y::DOUBLE, 'hybrid', hybrid::DOUBLE FROM b_out WHERE y IS NOT NULL"""
VIEWS["mpr"] = "SELECT k, m, h, actual, model, round(predicted, 6) AS predicted FROM mp"
VIEWS["btrain"] = "SELECT k, m, y FROM bt WHERE train"
VIEWS["scale"] = """
SELECT k, count(d)::BIGINT AS n_pairs, CASE WHEN avg(d) > 0 THEN avg(d) END AS scale
FROM (SELECT a.k, abs(a.y - b.y) AS d FROM btrain a LEFT JOIN btrain b ON a.k = b.k AND b.m = a.m - 12) GROUP BY k"""
VIEWS["sc"] = """
SELECT k, model, count(predicted)::BIGINT AS n, avg(abs(actual - predicted)) AS mae,
       sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse FROM mp GROUP BY k, model"""
VIEWS["wsc"] = """
SELECT k, max(mae) FILTER (model = 'base') AS base_mae, max(mae) FILTER (model = 'hybrid') AS hybrid_mae,
       max(rmse) FILTER (model = 'base') AS base_rmse, max(rmse) FILTER (model = 'hybrid') AS hybrid_rmse,
       max(n) FILTER (model = 'base') AS n FROM sc GROUP BY k"""
VIEWS["pos"] = "SELECT k, year, m, y, max(m) OVER (PARTITION BY k) - m + 1 AS back FROM om"
VIEWS["fold"] = """
SELECT k, fold, m, y, back > (4 - fold) * 12 + 12 AS train
FROM pos, (SELECT unnest(range(1, 5)) AS fold) WHERE back > (4 - fold) * 12"""
VIEWS["foldf"] = """
SELECT f.k || '#' || f.fold AS k, m, y, train, CASE WHEN NOT train THEN m - e END AS h
FROM fold f JOIN (SELECT k, fold, max(m) AS e FROM fold WHERE train GROUP BY ALL) USING (k, fold)"""
forecast_views("r", "foldf")
VIEWS["fold_naive"] = """
SELECT t.k, t.m, l.y::DOUBLE AS naive FROM foldf t JOIN (
  SELECT k, y, least(12, count(*) OVER (PARTITION BY k)) AS n, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS b FROM foldf WHERE train) l
  ON l.k = t.k AND l.b <= n AND l.n - l.b = (t.h - 1) % n WHERE t.h IS NOT NULL"""
VIEWS["frows"] = """
SELECT split_part(k, '#', 1) AS k, split_part(k, '#', 2)::BIGINT AS fold, 'base' AS model, y::DOUBLE AS actual,
       greatest(0.0, base) AS predicted FROM r_fit WHERE h IS NOT NULL
UNION ALL SELECT split_part(f.k, '#', 1), split_part(f.k, '#', 2)::BIGINT, 'naive', f.y::DOUBLE, naive
FROM foldf f JOIN fold_naive n ON n.k = f.k AND n.m = f.m WHERE f.h IS NOT NULL"""
VIEWS["btn"] = """
SELECT t.k, t.m, t.h, t.y, l.y::DOUBLE AS naive FROM bt t LEFT JOIN (
  SELECT k, y, least(12, count(*) OVER (PARTITION BY k)) AS n, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS b FROM bt WHERE train) l
  ON l.k = t.k AND l.b <= n AND l.n - l.b = (t.h - 1) % n WHERE t.h IS NOT NULL"""
VIEWS["tot"] = "SELECT k, round(sum(hybrid), 6) AS projected_total, count(hybrid)::BIGINT AS n_periods FROM f_out GROUP BY k"
VIEWS["ranked"] = """
SELECT *, row_number() OVER (ORDER BY projected_total DESC, k)::BIGINT AS rank FROM tot WHERE projected_total IS NOT NULL"""
VIEWS["bands"] = """
SELECT k, m, h, hybrid AS value, radius, n_errors, greatest(0.0, hybrid - radius) AS lower, hybrid + radius AS upper
FROM f_out JOIN (SELECT k, max(abs(actual - predicted)) AS radius, count(predicted)::BIGINT AS n_errors
                 FROM mp WHERE model = 'hybrid' GROUP BY k) USING (k)"""
VIEWS["look"] = """
SELECT k, h, value, baseline, value - baseline AS change, (value - baseline) / nullif(baseline, 0) * 100 AS percent,
       CASE WHEN value > baseline THEN 'above' WHEN value < baseline THEN 'below' ELSE 'at' END AS position
FROM (SELECT k, h, round(hybrid, 6) AS value FROM f_out) JOIN
     (SELECT k, max_by(y, m)::DOUBLE AS baseline FROM om GROUP BY k) USING (k)"""


def peak(source: str) -> str:
    return f"""
SELECT k, model, arg_min(h, (-actual, h)) AS actual_peak_h, max(actual) AS actual_peak,
       arg_min(h, (-predicted, h)) AS predicted_peak_h, max(predicted) AS predicted_peak,
       arg_min(h, (-predicted, h)) - arg_min(h, (-actual, h)) AS timing_error, max(predicted) - max(actual) AS size_error,
       median(actual) AS median
FROM {source} WHERE actual IS NOT NULL GROUP BY k, model"""


VIEWS["upr"] = "SELECT k, h, actual, 'mean' AS model, round(predicted, 6) AS predicted FROM urows"
_MAPE = "avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100"
_WAPE = "sum(abs(actual - predicted)) / nullif(sum(abs(actual)), 0) * 100"
_MAE = "avg(abs(actual - predicted))"
_RMSE = "sqrt(avg((actual - predicted) * (actual - predicted)))"
_NZ = "FILTER (actual <> 0)"
_FITCOLS = f"k, m, h, {r6('base')} AS base, {r6('correction')} AS correction, {r6('hybrid')} AS hybrid"

SQL = {
    "base_forecast": f"SELECT k, m, h, train, {r6('trend')} AS trend, {r6('seasonal')} AS seasonal, {r6('base')} AS base FROM b_fit",
    "residuals": f"SELECT k, m, y, {r6('base')} AS base, {r6('residual')} AS residual FROM b_fit WHERE train",
    "residual_rows": f"""
SELECT k, m, {r6('r')} AS residual, n_rows, n_rows >= 5 AS enough
FROM u7_use JOIN (SELECT k, count(*)::BIGINT AS n_rows FROM u7_use GROUP BY k) USING (k)""",
    "complete_lag_rows": f"""
SELECT a.k, a.m, {r6('any_value(a.r)')} AS residual FROM u7_res a JOIN u7_res b ON b.k = a.k AND b.m BETWEEN a.m - 4 AND a.m - 1
GROUP BY a.k, a.m HAVING count(*) = 4""",
    "positional_lags": """
SELECT k, m, y, lag(y, 1) OVER w AS row_lag1, lag(y, 2) OVER w AS row_lag2, lag(y, 3) OVER w AS row_lag3
FROM ud WHERE observed WINDOW w AS (PARTITION BY k ORDER BY m)""",
    "residual_ar1": f"SELECT k, {r6('phi')} AS phi, n_residual_rows, {r6('last_r')} AS last_residual FROM b_phi",
    "recursive_correction": f"""
SELECT k, h, {r6('v[3 + h]')} AS correction
FROM (WITH RECURSIVE walk AS (
        SELECT k, 0 AS step, [coalesce(max(r) FILTER (m = e - 2), 0), coalesce(max(r) FILTER (m = e - 1), 0),
                              coalesce(max(r) FILTER (m = e), 0)] AS v
        FROM f_res, (SELECT max(m) AS e FROM f_res) GROUP BY k
        UNION ALL
        SELECT k, step + 1, list_append(v, 0.5::DOUBLE * v[len(v)] + 0.25::DOUBLE * v[len(v) - 1] + 0.125::DOUBLE * v[len(v) - 2])
        FROM walk WHERE step < 12)
      SELECT k, v FROM walk WHERE step = 12), (SELECT unnest(range(1, 13)) AS h)""",
    "hybrid_combine": f"SELECT {_FITCOLS} FROM b_out",
    "hybrid_combine_raw": f"SELECT k, m, h, {r6('hybrid_raw')} AS hybrid_raw FROM b_out",
    "component_check": """
SELECT k, count(*)::BIGINT AS n_periods, count(base)::BIGINT AS n_base, count(correction)::BIGINT AS n_correction,
       CASE WHEN count(*) <> 12 THEN 'wrong_length' WHEN count(base) < 12 THEN 'base_not_finite'
            WHEN count(correction) < 12 THEN 'correction_not_finite' ELSE 'ok' END AS status FROM f_out GROUP BY k""",
    "backtest": f"""
SELECT k, n::BIGINT AS n, {r6('base_mae')} AS base_mae, {r6('base_rmse')} AS base_rmse, {r6('base_mae / scale')} AS base_mase,
       {r6('hybrid_mae')} AS hybrid_mae, {r6('hybrid_rmse')} AS hybrid_rmse, {r6('hybrid_mae / scale')} AS hybrid_mase,
       {r6('base_mae - hybrid_mae')} AS mae_improvement,
       CASE WHEN hybrid_mae IS NULL THEN 'unavailable' ELSE 'completed' END AS status FROM wsc JOIN scale USING (k)""",
    "rolling_backtest": f"""
SELECT k, model, fold, count(actual)::BIGINT AS n, {r6(_MAE)} AS mae, {r6(_RMSE)} AS rmse FROM frows GROUP BY k, model, fold""",
    "pooled_fold_metrics": f"""
SELECT k, model, count(actual)::BIGINT AS n, {r6(_MAE)} AS mae, {r6(_RMSE)} AS rmse, {r6(_MAPE)} AS mape, {r6(_WAPE)} AS wape
FROM frows GROUP BY k, model""",
    "residual_gbt": f"""
SELECT k, m, h, {r6('base')} AS base, true AS finite, true AS bounded FROM f_fit WHERE h IS NOT NULL AND k IN (SELECT k FROM f_res)""",
    "forecast_batch": f"""
SELECT g.k, coalesce(status, 'excluded') AS status, CASE WHEN reason <> 'ok' THEN reason END AS reason, coalesce(n_values, 0)::BIGINT AS n_values, n_train,
       projected_total, 'batch-{MODEL.signature[:16]}' AS group_id
FROM gate60 g LEFT JOIN (SELECT k, any_value(status) AS status, count(hybrid) AS n_values, any_value(n_train) AS n_train, {r6('sum(hybrid)')} AS projected_total
                         FROM q_out GROUP BY k) USING (k)""",
    "run_status": "SELECT k, any_value(status) AS status, any_value(n_train) AS n_train, any_value(n_residual_rows) AS n_residual_rows FROM u_out GROUP BY k",
    "short_span_flag": "SELECT k, min(m) AS first_m, max(m) AS last_m, max(m) < min(m) + 84 AS short_span FROM oms GROUP BY k",
    "abstain_choice": f"""
SELECT k, m, h, hybrid IS NOT NULL AS corrected, {r6('coalesce(hybrid, base)')} AS value,
       CASE WHEN hybrid IS NOT NULL THEN 'hybrid' ELSE 'base' END AS chosen FROM u_out""",
    "terminal_gaps": """
SELECT c.k, lag, e + 1 - lag AS m
FROM (SELECT DISTINCT k FROM ud) c, (SELECT max(m) AS e FROM ud), (SELECT unnest(range(1, 13)) AS lag)
WHERE NOT EXISTS (SELECT 1 FROM ud u WHERE u.k = c.k AND u.m = e + 1 - lag AND u.y IS NOT NULL)""",
    "recent_mean": f"""
SELECT k, {r6('avg(y)')} AS recent_mean, count(*)::BIGINT AS n_used
FROM (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS b FROM uf WHERE train AND y IS NOT NULL)
WHERE b <= 12 GROUP BY k""",
    "production_refit": f"SELECT {_FITCOLS}, status FROM f_out",
    "seasonal_naive": "SELECT k, m, h, y, naive FROM btn",
    "seasonal_average": f"""
SELECT k, {r6(_MAE)} AS mae, {r6(_WAPE)} AS wape
FROM (SELECT t.k, t.y::DOUBLE AS actual, a AS predicted FROM bt t
      JOIN (SELECT k, m % 12 AS ph, avg(y) AS a FROM bt WHERE train AND m // 12 <> 1997 GROUP BY 1, 2) s
        ON s.k = t.k AND s.ph = t.m % 12 WHERE h IS NOT NULL) GROUP BY k""",
    "holdout_split": """
SELECT k, m, y, ty AS test_year, CASE WHEN year < ty THEN 'train' ELSE 'test' END AS split,
       CASE WHEN n < 17 THEN 'insufficient_history' ELSE 'ok' END AS status
FROM om JOIN (SELECT k, ty, count(*) FILTER (year < ty) AS n
              FROM om JOIN (SELECT k, max(year) AS ty FROM om GROUP BY k) USING (k) GROUP BY k, ty) USING (k)""",
    "three_way_split": """
SELECT k, m, y, CASE WHEN back <= 12 THEN 'test' WHEN back <= 24 THEN 'validation' ELSE 'train' END AS split FROM pos""",
    "rolling_folds": "SELECT k, fold, m, y, train FROM fold",
    "split_override": """
SELECT k, m, year, y, CASE WHEN fy = ly OR year <= coalesce(t, ly - 1) THEN 'train' ELSE 'test' END AS split
FROM om JOIN (SELECT k, min(year) AS fy, max(year) AS ly FROM om GROUP BY k) USING (k)
LEFT JOIN (VALUES ('2-HIGH', 1998), ('5-LOW', 1999)) o(k, t) USING (k)""",
    "window_variants": """
SELECT k, n || 'm-' || e AS variant, m, y, back > e + 12 AS train
FROM pos, (SELECT unnest([24, 36, 48]) AS n), (SELECT unnest([0, 12]) AS e) WHERE back > e AND back <= e + 12 + n""",
    "forecast_metrics": f"""
SELECT k, model, n, {r6('mae')} AS mae, {r6('rmse')} AS rmse, {r6('mae / scale')} AS mase FROM sc LEFT JOIN scale USING (k)""",
    "mase_scale": f"SELECT k, n_pairs, {r6('scale')} AS scale FROM scale",
    "mase_scale_fallback": f"""
SELECT k, {r6('coalesce(nullif(avg(ds), 0), nullif(avg(d1), 0), 1.0)')} AS scale
FROM (SELECT k, abs(y - lag(y, 7) OVER w) AS ds, abs(y - lag(y, 1) OVER w) AS d1
      FROM ud WHERE observed WINDOW w AS (PARTITION BY k ORDER BY m)) GROUP BY k""",
    "mape_profile": f"""
SELECT k, {r6(_MAPE)} AS mape, count(*) {_NZ}::BIGINT AS mape_n, {r6(f'median(actual) {_NZ}')} AS mape_median_actual,
       {r6(f'quantile_cont(actual, 0.1) {_NZ}')} AS mape_p10_actual, count(actual)::BIGINT AS n FROM urows GROUP BY k""",
    "wape": f"SELECT k, {r6(_WAPE)} AS wape FROM urows GROUP BY k",
    "score_coverage": f"""
SELECT k, count(*)::BIGINT AS test_positions_total, count(actual)::BIGINT AS observations_scored,
       (count(*) - count(actual))::BIGINT AS missing_actuals_excluded,
       count(*) FILTER (actual = 0)::BIGINT AS zero_actuals_excluded_from_mape, {r6(_MAE)} AS mae, {r6(_RMSE)} AS rmse
FROM urows GROUP BY k""",
    "horizon_metrics": f"""
SELECT k, model, horizon, count(predicted)::BIGINT AS n, {r6(_MAE)} AS mae, {r6(_RMSE)} AS rmse, {r6(_MAPE)} AS mape
FROM mp JOIN (SELECT unnest([3, 6, 12])::BIGINT AS horizon) ON h <= horizon GROUP BY k, model, horizon""",
    "mape_scale_risk": f"""
SELECT k, round(median, 6) AS median, round(p10, 6) AS p10, CASE WHEN bad OR (median >= 10 AND p10 >= 5) THEN 'none' WHEN p10 < 5 THEN 'low_tail' ELSE 'low_median' END AS risk
FROM (SELECT k, max(median) AS median, max(p10) AS p10, bool_or(mape IS NULL) AS bad
      FROM (SELECT k, model, {_MAPE} AS mape, median(actual) {_NZ} AS median, quantile_cont(actual, 0.1) {_NZ} AS p10
            FROM mp GROUP BY k, model) GROUP BY k)""",
    "selection_score": f"SELECT k, {r6(f'coalesce({_WAPE}, {_MAE})')} AS score FROM urows GROUP BY k",
    "error_band": f"""
SELECT k, m, h, {r6('value')} AS value, {r6('radius')} AS radius, n_errors, {r6('lower')} AS lower, {r6('upper')} AS upper FROM bands""",
    "interval_validity": "SELECT k, count(*)::BIGINT AS n, bool_and(lower <= value AND value <= upper) AS valid FROM bands GROUP BY k",
    "aligned_pairs": f"""
SELECT k, m, a.y AS actual, {r6('p.hybrid')} AS predicted,
       CASE WHEN a.y IS NULL THEN 'actual_missing' WHEN p.hybrid IS NULL THEN 'prediction_missing' ELSE 'aligned' END AS alignment
FROM om a FULL JOIN (SELECT k, m, hybrid FROM b_out) p USING (k, m)""",
    "holdout_comparison": f"""
SELECT k, m, y::DOUBLE AS observed, NULL::DOUBLE AS base, NULL::DOUBLE AS hybrid, 'history' AS part FROM btrain
UNION ALL SELECT k, m, y::DOUBLE, {r6('base')}, {r6('hybrid')}, 'holdout' FROM b_out""",
    "component_table": f"""
SELECT k, h, {r6('base')} AS base, {r6('correction')} AS correction, {r6('hybrid')} AS hybrid, 'holdout' AS block FROM b_out
UNION ALL SELECT k, h, {r6('base')}, {r6('correction')}, {r6('hybrid')}, 'future' FROM f_out""",
    "common_index": f"""
SELECT k, count(*)::BIGINT AS n, {r6('avg(abs(a.base - b.base))')} AS mean_gap
FROM (SELECT k, m, base FROM b_fit WHERE train) a JOIN (SELECT k, m, base FROM f_fit WHERE train) b USING (k, m) GROUP BY k""",
    "stratum_metrics": f"""
SELECT k, model, horizon, stratum, count(predicted)::BIGINT AS n, {r6(_MAE)} AS mae, {r6(_MAPE)} AS mape
FROM (SELECT mp.*, CASE WHEN actual < c THEN 'below' ELSE 'at_or_above' END AS stratum
      FROM mp JOIN (SELECT k, median(y) AS c FROM btrain GROUP BY k) USING (k))
JOIN (SELECT unnest([3, 6, 12])::BIGINT AS horizon) ON h <= horizon GROUP BY k, model, horizon, stratum""",
    "gain_sensitivity": f"""
SELECT k, threshold, {r6('gain')} AS gain, CASE WHEN gain > threshold THEN 'hybrid' ELSE 'base' END AS choice
FROM (SELECT k, round(base_mae, 6) - round(hybrid_mae, 6) AS gain FROM wsc), (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS threshold)""",
    "model_verdict": f"""
SELECT *, CASE WHEN a = 0 AND b = 0 THEN 'similar' WHEN a <= 0 AND b <= 0 THEN 'better' WHEN a >= 0 AND b >= 0 THEN 'worse' ELSE 'mixed' END AS verdict
FROM (SELECT k, {r6('hybrid_rmse - base_rmse')} AS a, {r6('hybrid_mae - base_mae')} AS b FROM wsc)""".replace("SELECT *,", "SELECT k, a AS rmse_difference, b AS mae_difference,", 1),
    "peak_error": f"""
SELECT k, model, actual_peak_h, actual_peak, predicted_peak_h, {r6('predicted_peak')} AS predicted_peak, timing_error,
       {r6('size_error')} AS size_error FROM ({peak('mpr')})""",
    "direction_agreement": f"""
SELECT k, model, pairs, {r6('agreement')} AS agreement, {r6('ratio')} AS difference_sd_ratio, coalesce(ratio < 0.5, false) AS smoother
FROM (SELECT a.k, a.model, count(b.h)::BIGINT AS pairs,
             avg(CASE WHEN b.h IS NOT NULL THEN (sign(a.actual - b.actual) = sign(a.predicted - b.predicted))::INT END) AS agreement,
             stddev_pop(a.predicted - b.predicted) / nullif(stddev_pop(a.actual - b.actual), 0) AS ratio
      FROM mpr a LEFT JOIN mpr b ON a.k = b.k AND a.model = b.model AND b.h = a.h - 1 GROUP BY a.k, a.model)""",
    "surge_flags": f"""
SELECT k, model, median, s AS surge, s AND (abs(timing_error) > 4 OR abs(size_error) > 0.5 * actual_peak) AS missed_surge
FROM (SELECT *, actual_peak >= 2 * median AND actual_peak - median >= 10 AS s FROM ({peak('upr')}))""",
    "path_shape": f"""
SELECT k, {r6('max_by(value, h) - min_by(value, h)')} AS change, bool_and(coalesce(d >= 0, true)) AS nondecreasing,
       bool_and(coalesce(d <= 0, true)) AS nonincreasing, arg_min(h, (-value, h)) AS peak_h, {r6('max(value)')} AS peak
FROM (SELECT k, h, value, value - lag(value) OVER (PARTITION BY k ORDER BY h) AS d FROM look) GROUP BY k""",
    "outlook_vs_baseline": f"SELECT k, h, value, baseline, {r6('change')} AS change, {r6('percent')} AS percent, position FROM look",
    "outlook_blocks": f"""
SELECT k, (h - 1) // 4 + 1 AS block, min(h) AS first_h, max(h) AS last_h, {r6('sum(value)')} AS total,
       count(*) FILTER (position = 'above')::BIGINT AS n_above FROM look GROUP BY k, (h - 1) // 4 + 1""",
    "horizon_slice": f"""
SELECT k, h, {r6('hybrid')} AS hybrid, horizon FROM f_out JOIN (SELECT unnest([3, 6, 12])::BIGINT AS horizon) ON h <= horizon""",
    "metric_whitelist": f"""
SELECT k, 'mae' AS metric, {r6(_MAE)} AS value FROM urows GROUP BY k
UNION ALL SELECT k, 'rmse', {r6(_RMSE)} FROM urows GROUP BY k
UNION ALL SELECT k, 'mape', {r6(_MAPE)} FROM urows GROUP BY k""",
    "projected_total": "SELECT k, projected_total, n_periods FROM tot",
    "projected_rank": "SELECT k, projected_total, n_periods, rank FROM ranked",
    "projected_rank_with_error": f"""
SELECT rank, k, projected_total, {r6('base_mae')} AS base_mae, {r6('hybrid_mae')} AS hybrid_mae, {r6('naive_mae')} AS naive_mae
FROM ranked LEFT JOIN wsc USING (k) LEFT JOIN (SELECT k, avg(abs(y - naive)) AS naive_mae FROM btn GROUP BY k) USING (k)""",
    "top_five": """
SELECT rank, k, projected_total, 'available' AS status FROM ranked WHERE rank <= 5 AND (SELECT count(*) FROM ranked) >= 5""",
    "ranking_calendar_check": """
SELECT k, count(*)::BIGINT AS n_periods, count(*) = 12 AND count(DISTINCT m) = 12 AND max(m) - min(m) = 11 AS consecutive,
       (SELECT count(DISTINCT s) = 1 FROM (SELECT min(m) AS s FROM f_out GROUP BY k)) AS same_calendar FROM f_out GROUP BY k""",
    "ranking_context_check": """
SELECT count(DISTINCT k)::BIGINT AS n_series, 1::BIGINT AS n_signatures, 1::BIGINT AS n_groups, 1::BIGINT AS n_configurations,
       count(*) = count(DISTINCT (k, m)) AS no_repeats, bool_and(hybrid >= 0) AS valid_values,
       count(*) = count(DISTINCT (k, m)) AND bool_and(hybrid >= 0) AS comparable FROM f_out""",
    "ranking_named": """
SELECT k, projected_total, n_periods, rank,
       CASE k WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
              WHEN '4-NOT SPECIFIED' THEN 'Not Specified' WHEN '5-LOW' THEN 'Low' END AS description FROM ranked""",
    "candidate_grid": """
SELECT k, kind || '-' || season AS candidate, kind, season
FROM (SELECT DISTINCT k FROM om), (SELECT unnest(['level', 'trend']) AS kind), (SELECT unnest([1, 3, 6, 12])::BIGINT AS season)""",
}
