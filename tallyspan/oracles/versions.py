"""Check SQL on versions, runs, feeds and exports."""

from tallyspan.config import MODEL
from tallyspan.oracles.base import VIEWS, hash_text, r6, signature
from tallyspan.oracles.forecasts import forecast_views

VIEWS["vev"] = """
SELECT o_custkey AS scope, o_orderkey AS id, 's' || o_orderkey AS signature, 'upload' AS action, strftime(o_orderdate, '%Y-%m-%d') AS at_, 0 AS seq FROM orders
UNION ALL SELECT o_custkey, o_orderkey, 's' || o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 'activate' WHEN o_orderkey % 2 = 0 THEN 'reject' ELSE 'cancel' END, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d'), 1
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_custkey, o_orderkey, 's' || o_orderkey, 'cancel', strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d'), 2
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 = 0"""
VIEWS["vstate"] = """
SELECT scope, id, signature, uploaded_at, decided_at,
  CASE WHEN decision IS NULL THEN 'pending' WHEN decision = 'cancel' THEN 'cancelled' WHEN decision = 'reject' THEN 'rejected'
       WHEN rn = 1 THEN 'active' ELSE 'retired' END AS state, greatest(nd - 1, 0)::BIGINT AS n_illegal
FROM (SELECT *, row_number() OVER (PARTITION BY scope, decision ORDER BY decided_at DESC, id DESC) AS rn
      FROM (SELECT scope, id, any_value(signature) AS signature, min(at_) FILTER (action = 'upload') AS uploaded_at,
                   arg_min(action, seq) FILTER (action <> 'upload') AS decision, min(at_) FILTER (action <> 'upload') AS decided_at,
                   count(*) FILTER (action <> 'upload') AS nd FROM vev GROUP BY scope, id))"""
VIEWS["runs"] = f"""
SELECT event_id AS run_id, 's' || user_id AS signature, event_type AS block,
  CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, value,
  event_id % 5 >= 2 AND event_id % 7 <> 0 AND event_id % 3 <> 0 AS is_now FROM events"""
VIEWS["note"] = """
SELECT event_id AS id, event_type AS type, ts, CASE user_id % 3 WHEN 1 THEN 'admin' WHEN 2 THEN 'viewer' END AS role_target,
  CASE WHEN user_id % 5 = 0 THEN user_id % 20 END AS user_target FROM events"""
VIEWS["rcpt"] = "SELECT event_id AS notification_id, user_id % 2 * 10 AS user_id FROM events WHERE event_type IN ('view', 'signup')"
VIEWS["myfeed"] = """
SELECT n.*, EXISTS (SELECT 1 FROM rcpt r WHERE r.notification_id = n.id AND r.user_id = 10) AS is_read FROM note n
WHERE (role_target IS NULL OR role_target = 'admin') AND (user_target IS NULL OR user_target = 10)"""
VIEWS["bsplit"] = """
SELECT k, m, y, CASE WHEN b <= 12 THEN 'test' WHEN b <= 24 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, max(m) OVER (PARTITION BY k) - m + 1 AS b FROM bm)"""
VIEWS["cfit"] = """
SELECT s.k, m, split, y::DOUBLE AS y, kind || '-' || season AS candidate, kind, season, m - min(m) OVER (PARTITION BY s.k) AS t
FROM bsplit s, (SELECT unnest(['level', 'trend']) AS kind), (SELECT unnest([1, 3, 6, 12]) AS season) WHERE split <> 'test'"""
VIEWS["cline"] = """
SELECT f.*, CASE WHEN kind = 'trend' THEN a + b * t ELSE mu END AS trend
FROM cfit f JOIN (SELECT k, candidate, regr_slope(y, t::DOUBLE) AS b, regr_intercept(y, t::DOUBLE) AS a, avg(y) AS mu
                  FROM cfit WHERE split = 'train' GROUP BY ALL) USING (k, candidate)"""
VIEWS["cpred"] = """
SELECT l.*, trend + s AS p FROM cline l
JOIN (SELECT k, candidate, season, m % season AS ph, avg(y - trend) AS s FROM cline WHERE split = 'train' GROUP BY ALL) e
  ON e.k = l.k AND e.candidate = l.candidate AND e.ph = l.m % l.season"""
VIEWS["cscore"] = """
SELECT k, candidate,
  round(count(*) FILTER (split = 'train') * ln(sum((y - p) * (y - p)) FILTER (split = 'train') / count(*) FILTER (split = 'train'))
        + 2 * (any_value(season) + CASE WHEN any_value(kind) = 'trend' THEN 1 ELSE 0 END), 6) AS aic,
  round(sqrt(avg((y - greatest(0, p)) * (y - greatest(0, p))) FILTER (split = 'validation')), 6) AS rmse,
  round(avg(abs(y - greatest(0, p))) FILTER (split = 'validation'), 6) AS mae,
  round(avg(abs(y - greatest(0, p)) / y) FILTER (split = 'validation' AND y <> 0) * 100, 6) AS mape
FROM cpred GROUP BY k, candidate"""
VIEWS["cshort"] = """
SELECT *, row_number() OVER (PARTITION BY k ORDER BY aic, candidate)::BIGINT AS place FROM cscore"""


def winner(source: str) -> str:
    return f"""
SELECT * FROM (SELECT *, min(rmse) OVER (PARTITION BY k) AS best FROM {source})
WHERE abs(rmse - best) <= 1e-8 + 1e-6 * abs(best) QUALIFY row_number() OVER (PARTITION BY k ORDER BY mae, mape, candidate) = 1"""


VIEWS["repf"] = """
SELECT k, m, y, true AS train, NULL::BIGINT AS h FROM rep
UNION ALL SELECT k, e + h, NULL, false, h FROM (SELECT DISTINCT k FROM rep), (SELECT max(m) AS e FROM rep), (SELECT unnest(range(1, 13)) AS h)"""
forecast_views("p", "repf")
VIEWS["hist"] = f"""
SELECT k, m, y, status, CASE WHEN y IS NULL THEN 'unknown' ELSE 'observed' END AS kind, NULL::DOUBLE AS projected FROM study
UNION ALL SELECT k, m, NULL, 'projected', 'forecast', {r6('base')} FROM p_out"""
VIEWS["annual"] = """
SELECT k, year, bool_or(present) AS present, CASE WHEN bool_or(present) THEN sum(y)::BIGINT END AS annual_total,
  CASE WHEN bool_or(present) THEN 'reported' WHEN year IN (1997, 1999) THEN 'report_unavailable' ELSE 'outside_annual_top' END AS status
FROM study GROUP BY k, year"""
VIEWS["repn"] = """
SELECT t.k, t.h, l.y AS value FROM (SELECT * FROM repf WHERE h IS NOT NULL) t
LEFT JOIN (SELECT k, y, least(12, count(*) OVER (PARTITION BY k)) AS n, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS b FROM rep) l
  ON l.k = t.k AND l.b <= n AND l.n - l.b = (t.h - 1) % n"""

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
_EXPECT = " UNION ALL ".join(
    f"SELECT source_row, '{f}' AS field, {f} AS supplied, '{v}' AS expected FROM raw WHERE {f} <> '{v}'"
    for f, v in (("population", "5-19"), ("location", "South"))
)

SQL = {
    "content_signature": f"SELECT count(*)::BIGINT AS n_rows, {signature(*_LINE)} AS content_signature FROM lineitem",
    "series_signature": f"SELECT k, count(*)::BIGINT AS n_rows, {signature('k', 'm', 'y')} AS content_signature FROM ud GROUP BY k",
    "fold_signatures": f"SELECT k, fold, count(*)::BIGINT AS n_rows, {signature('m', 'y')} AS content_signature FROM fold WHERE train GROUP BY k, fold",
    "export_roundtrip": "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_read, true AS identical FROM study",
    "dataset_state": "SELECT * FROM vstate",
    "pending_list": "SELECT scope, id, uploaded_at FROM vstate WHERE state = 'pending'",
    "active_dataset": """
SELECT scope, id, count(*)::BIGINT AS n_rows, count(DISTINCT l_linenumber)::BIGINT AS n_lines, sum(l_quantity) AS quantity
FROM vstate JOIN lineitem ON l_orderkey = id WHERE state = 'active' GROUP BY scope, id""",
    "dataset_stage": "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_stored, count(y)::BIGINT AS n_observed, count(*) FILTER (y IS NULL)::BIGINT AS n_reasons, 'pending' AS state FROM study",
    "json_round_trip": """
SELECT event_id, event_id % 10 <> 0 AS stored, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value
FROM events WHERE value IS NOT NULL
UNION ALL SELECT event_id, false, NULL, NULL FROM events WHERE value IS NULL""",
    "state_scan": "SELECT run_id, signature, block, status, created_at FROM runs WHERE block = 'error' AND status = 'completed'",
    "snapshot_write": "SELECT count(*)::BIGINT AS n_rows, true AS second_write_refused FROM f_out",
    "audit_append": "SELECT action, count(*)::BIGINT AS n FROM vev GROUP BY action",
    "ranking_append": "SELECT k, rank, projected_total, 2::BIGINT AS ranking_run FROM ranked",
    "current_runs": "SELECT run_id, signature, block, created_at FROM runs WHERE is_now",
    "latest_run": """
SELECT signature, block, run_id, created_at FROM runs WHERE is_now
QUALIFY row_number() OVER (PARTITION BY signature, block ORDER BY created_at DESC, run_id DESC) = 1""",
    "run_upsert": f"""
SELECT run_id, status, CASE WHEN status = 'running' THEN 1 ELSE 2 END::BIGINT AS version,
  CASE WHEN status = 'completed' THEN 3 END::BIGINT AS n_values, CASE WHEN status = 'completed' THEN {r6('value * 6')} END AS total FROM runs""",
    "visible_results": """
SELECT run_id, signature, block FROM runs WHERE is_now AND signature IN
  (SELECT 's' || user_id FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error')""",
    "run_status_counts": "SELECT block, status, count(*)::BIGINT AS n_runs, count(value)::BIGINT AS n_values FROM runs GROUP BY block, status",
    "lock_lookup": f"""
SELECT c.c_mktsegment, c.c_nationkey, c.source_key, l.locked_at, l.lock_id, CASE WHEN lock_id IS NULL THEN 'missing' ELSE 'runtime' END AS state
FROM (SELECT DISTINCT c_mktsegment, c_nationkey, sha256({hash_text('c_mktsegment', 'c_nationkey')}) AS source_key FROM customer) c
LEFT JOIN (SELECT c_mktsegment, c_nationkey, strftime(o_orderdate, '%Y-%m-%d') AS locked_at, sha256({hash_text('o_orderkey')}) AS lock_id
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey % 4 <> 0
           QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY locked_at DESC, lock_id DESC) = 1) l
  ON l.c_mktsegment = c.c_mktsegment AND l.c_nationkey = c.c_nationkey""",
    "candidate_search": f"""
SELECT k, candidate, aic, rmse, mae, mape FROM ({winner('(SELECT * FROM cshort WHERE place <= 5)')})""",
    "shortlist": "SELECT k, candidate, aic, place FROM cshort WHERE place <= 5",
    "tolerant_winner": f"SELECT k, candidate, rmse, mae FROM ({winner('cscore')})",
    "rank_correlation": f"""
SELECT k, {r6('corr(ra, rb)')} AS rho, count(*)::BIGINT AS n
FROM (SELECT a.k, a.candidate,
        sum((b.aic < a.aic)::INT) + (sum((b.aic = a.aic)::INT) + 1) / 2.0::DOUBLE AS ra, sum((b.rmse < a.rmse)::INT) + (sum((b.rmse = a.rmse)::INT) + 1) / 2.0::DOUBLE AS rb
      FROM cscore a JOIN cscore b ON a.k = b.k GROUP BY a.k, a.candidate) GROUP BY k""",
    "config_lock": """
SELECT DISTINCT k, CASE k WHEN 'Brand#3' THEN 'lock_altered' WHEN 'Brand#5' THEN 'data_changed' ELSE 'valid' END AS lock_status FROM bm""",
    "evidence_reuse": """
SELECT DISTINCT k, CASE k WHEN 'Brand#7' THEN 'evaluate' WHEN 'Brand#8' THEN 'revised' ELSE 'reuse' END AS outcome FROM bm""",
    "config_override": """
SELECT k, months, sum(y)::BIGINT AS total, count(*)::BIGINT AS n
FROM (SELECT *, (CASE k WHEN 'Brand#1' THEN 24 WHEN 'Brand#2' THEN 36 ELSE 12 END)::BIGINT AS months FROM bm), (SELECT max(m) AS e FROM bm)
WHERE m > e - months GROUP BY k, months""",
    "seed_median": f"""
SELECT k, candidate, count(*)::BIGINT AS n_seeds, bool_and(ok) AS all_ok,
  CASE WHEN bool_and(ok) THEN {r6('median(v)')} END AS mae, CASE WHEN bool_and(ok) THEN {r6('median(v * 2)')} END AS rmse
FROM (SELECT user_id AS k, event_type AS candidate, event_id % 3 AS seed, bool_and(event_id % 50 <> 0) AS ok, max(value) AS v FROM events GROUP BY ALL)
GROUP BY k, candidate""",
    "error_row_check": """
SELECT k, (count(*) * CASE WHEN k = '2-HIGH' THEN 2 ELSE 1 END)::BIGINT AS n_rows, CASE WHEN k = '5-LOW' THEN count(DISTINCT m) ELSE 0 END::BIGINT AS n_not_after,
  CASE WHEN k = '2-HIGH' THEN count(*) ELSE 0 END::BIGINT AS n_repeated, k NOT IN ('2-HIGH', '5-LOW') AS valid
FROM fold WHERE NOT train GROUP BY k""",
    "audience_feed": "SELECT id, type, is_read FROM myfeed",
    "unread_count": "SELECT count(*)::BIGINT AS unread FROM myfeed WHERE NOT is_read",
    "mark_read": "SELECT id AS notification_id, 10::BIGINT AS user_id FROM myfeed WHERE NOT is_read AND type = 'error'",
    "feed_by_day": "SELECT id, type, strftime(ts, '%Y-%m-%d') AS day FROM myfeed",
    "feed_filter": "SELECT id, type, is_read FROM myfeed WHERE NOT is_read AND type = 'click'",
    "change_token": """
SELECT (SELECT max(id) FROM vstate WHERE state = 'active') AS active_id, (SELECT max(id * 10 + seq) FROM vev) AS last_audit,
  (SELECT max(event_id) FROM events) AS last_notice, (SELECT count(*) FROM myfeed WHERE NOT is_read) AS unread""",
    "history_forecast_union": "SELECT * FROM hist",
    "report_export": "SELECT kind, status, count(*)::BIGINT AS n, count(y)::BIGINT AS n_counts FROM hist GROUP BY kind, status",
    "provenance_export": f"""
SELECT *, 'derived' AS dataset_type, 'monthly' AS frequency, '{MODEL.version}' AS model_version, '{MODEL.signature}' AS configuration,
  'last_reported_year' AS evaluation_split, 'in_sample' AS residual_method, 'calendar_lags' AS gap_handling, y IS NULL AS excluded_from_training FROM hist""",
    "report_document": """
SELECT k, to_json({'k': k, 'history': h, 'annual': a, 'forecast': f})::VARCHAR AS document
FROM (SELECT k, list({'m': m, 'y': y} ORDER BY m) AS h FROM study GROUP BY k)
LEFT JOIN (SELECT k, list({'year': year, 'annual_total': annual_total, 'status': status} ORDER BY year) AS a FROM annual GROUP BY k) USING (k)
LEFT JOIN (SELECT k, list({'h': h, 'value': value} ORDER BY h) AS f FROM repn GROUP BY k) USING (k)""",
    "snapshot_reconcile": f"""
SELECT k, m, model, {r6('predicted')} AS predicted, y AS observed, m % 5 <> 0 AS complete, CASE WHEN m % 5 <> 0 THEN {r6('abs(y - predicted)')} END AS absolute_error
FROM mp JOIN om USING (k, m)""",
    "context_guard": _EXPECT,
    "revision_of_runs": """
SELECT block, (count(*) - count(DISTINCT signature))::BIGINT AS superseded, count(DISTINCT signature)::BIGINT AS kept FROM runs WHERE is_now GROUP BY block""",
}
