"""Check SQL on coverage, duplicates, readiness, summaries and reviews."""

from tallyspan.oracles.base import VIEWS, r6, year_length, whole

_APPROVED = "(" + ", ".join(f"'NATION_{i}'" for i in range(20)) + ")"
_COMPLETE = "lower(coalesce(reporting_status, 'unknown')) = 'complete'"

VIEWS["rcount"] = """
SELECT k, count(DISTINCT year) FILTER (y IS NOT NULL)::BIGINT AS year_count, count(y)::BIGINT AS month_count FROM study GROUP BY k"""
VIEWS["wgap"] = f"""
SELECT k, year, week FROM (
  SELECT k, year, unnest(range(CASE WHEN year = s // 100 THEN s % 100 ELSE 1 END,
                               (CASE WHEN year = e // 100 THEN e % 100 ELSE {year_length('year')} END) + 1)) AS week
  FROM (SELECT k, s, e, unnest(range(s // 100, e // 100 + 1)) AS year FROM (SELECT k, min(year * 100 + week) AS s, max(year * 100 + week) AS e FROM wk GROUP BY k)))
WHERE (k, year, week) NOT IN (SELECT (k, year, week) FROM wk)"""
VIEWS["elig"] = f"""
SELECT k, n_complete, reasons = '' AS eligible, reasons FROM (
SELECT k, n_complete, array_to_string(list_filter([
  CASE WHEN k NOT IN {_APPROVED} THEN 'scope_not_approved' END, CASE WHEN n_complete < 156 THEN 'insufficient_complete_history' END,
  CASE WHEN n_blank > 0 OR coalesce(n_gap, 0) > 0 THEN 'gaps_need_approval' END, CASE WHEN n53 > 0 THEN 'week53_needs_approval' END,
  CASE WHEN nc > 0 THEN 'week53_conflict' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM (SELECT k, count(*) FILTER ({_COMPLETE} AND y IS NOT NULL)::BIGINT AS n_complete, count(*) FILTER (y IS NULL) AS n_blank,
             count(*) FILTER (week = 53) AS n53, count(*) FILTER (week = 53 AND {year_length('year')} = 52) AS nc FROM wk GROUP BY k)
LEFT JOIN (SELECT k, count(*) AS n_gap FROM wgap GROUP BY k) USING (k))"""
VIEWS["finding"] = """
SELECT 'blank_observations' AS "check", k, year, week FROM wk WHERE y IS NULL
UNION ALL SELECT 'zero_weeks', k, year, week FROM wk WHERE y = 0 UNION ALL SELECT 'week53', k, year, week FROM wk WHERE week = 53
UNION ALL SELECT 'missing_weeks', k, year, week FROM wgap"""
_FOLD = r"lower(trim(regexp_replace(label_text, '\s+', ' ', 'g')))"
_DECIDE = """n > 0 AND n >= 17 AS eligible, CASE WHEN n >= 17 THEN 'ready' ELSE 'not_ready' END AS readiness_status,
  CASE WHEN n = 0 THEN 'no reported observations' ELSE 'reported months: ' || n || '; minimum 17' END AS reason"""
_SETS = "coalesce(string_agg(DISTINCT {f}, '{s}' ORDER BY {f}), '')"

SQL = {
    "observed_only": "SELECT k, m, y, status FROM study WHERE y IS NOT NULL",
    "annual_presence_limit": "SELECT year, count(DISTINCT k)::BIGINT AS n_keys, count(DISTINCT k) > 5 AS over_limit FROM bm GROUP BY year",
    "annual_completeness": "SELECT k, year, count(*)::BIGINT AS n_months, count(*) = 12 AS complete FROM study WHERE y IS NOT NULL GROUP BY k, year",
    "readiness": """
SELECT k, year_count, month_count,
  coalesce((SELECT string_agg(y::VARCHAR, ',' ORDER BY y) FROM (SELECT unnest([1995, 1996, 1998, 2000, 2001]) AS y) a
            WHERE NOT EXISTS (SELECT 1 FROM study s WHERE s.k = r.k AND s.year = a.y AND s.y IS NOT NULL)), '') AS missing_years,
  coalesce((SELECT string_agg(printf('%04d-%02d', s.year, s.month), ',' ORDER BY m) FROM study s WHERE s.k = r.k AND s.y IS NULL AND s.year_available), '') AS missing_months
FROM rcount r""",
    "readiness_decision": f"SELECT k, n AS month_count, {_DECIDE} FROM (SELECT k, month_count AS n FROM rcount)",
    "candidate_universe": f"""
SELECT k, n AS month_count, {_DECIDE}
FROM (SELECT c.k, coalesce(month_count, 0) AS n FROM (SELECT DISTINCT p_brand AS k FROM part UNION ALL SELECT 'NONE') c LEFT JOIN rcount r ON r.k = c.k)""",
    "annual_history": "SELECT k, year, present, annual_total, status FROM annual",
    "status_bands": "SELECT DISTINCT k, year, status, year || '-01-01' AS band_start, year || '-12-31' AS band_end FROM study",
    "latest_observation": "SELECT k, max(m) AS m, max_by(y, m) AS y FROM ud WHERE observed GROUP BY k",
    "latest_complete_week": """
SELECT k, year, week, y FROM wk WHERE lower(reporting_status) = 'complete' AND y IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY k ORDER BY year DESC, week DESC) = 1""",
    "series_summary": """
SELECT k, year_count, month_count, month_count >= 17 AS eligible, printf('%04d-%02d', m // 12, m % 12 + 1) AS latest_month, y AS latest_count
FROM rcount JOIN (SELECT k, max(m) AS m, max_by(y, m) AS y FROM study WHERE y IS NOT NULL GROUP BY k) USING (k)""",
    "coverage_gate": """
SELECT k, count(*)::BIGINT AS n_rows, count(DISTINCT m)::BIGINT AS n_periods, (max(m) - min(m) + 1)::BIGINT AS span,
  CASE WHEN count(DISTINCT m) < max(m) - min(m) + 1 THEN 'missing_period' WHEN count(*) < 80 THEN 'insufficient_history' ELSE 'ok' END AS reason
FROM oms GROUP BY k""",
    "missing_periods": """
SELECT u.k, u.m FROM ud u JOIN (SELECT k, min(m) AS lo, max(m) AS hi FROM ud WHERE observed GROUP BY k) s ON s.k = u.k
WHERE NOT observed AND u.m BETWEEN lo AND hi""",
    "missing_weeks": "SELECT k, year, week FROM wgap",
    "quality_report": f"""
SELECT 'observations' AS "check", count(*)::BIGINT AS findings FROM wk
UNION ALL SELECT 'duplicates', 0 UNION ALL SELECT 'blank_observations', count(*) FILTER (y IS NULL) FROM wk
UNION ALL SELECT 'zero_weeks', count(*) FILTER (y = 0) FROM wk UNION ALL SELECT 'week53', count(*) FILTER (week = 53) FROM wk
UNION ALL SELECT 'week53_conflicts', count(*) FILTER (week = 53 AND {year_length('year')} = 52) FROM wk
UNION ALL SELECT 'excluded_from_training', count(*) FILTER (NOT ({_COMPLETE})) FROM wk UNION ALL SELECT 'missing_weeks', count(*) FROM wgap""",
    "eligibility_reasons": "SELECT * FROM elig",
    "workflow_route": """
SELECT k, reasons, CASE WHEN eligible THEN 'research' WHEN reasons LIKE '%insufficient_complete_history%' OR reasons LIKE '%week53_conflict%' THEN 'refused'
  ELSE 'provisional' END AS route FROM elig""",
    "duplicate_keys": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem QUALIFY copies > 1""",
    "duplicate_sources": """
SELECT l_orderkey, l_linenumber, l_suppkey, n_rows, n_sources FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_sources FROM (
    SELECT l_orderkey, l_linenumber, l_suppkey, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL)) WHERE n_sources > 1""",
    "description_conflicts": f"""
SELECT code_text, count(DISTINCT {_FOLD})::BIGINT AS n_descriptions, count(DISTINCT {_FOLD}) > 1 AS conflict FROM raw GROUP BY code_text""",
    "single_context_guard": """
SELECT source, np AS n_population, nl AS n_location, concat_ws(',', CASE WHEN np > 1 THEN 'population' END, CASE WHEN nl > 1 THEN 'location' END) AS mixed,
  np <= 1 AND nl <= 1 AS single_context
FROM (SELECT source, count(DISTINCT coalesce(lower(population), 'unknown'))::BIGINT AS np, count(DISTINCT coalesce(lower(location), 'unknown'))::BIGINT AS nl
      FROM raw GROUP BY source)""",
    "provenance_label": f"""
SELECT source, 'population: ' || coalesce(nullif({_SETS.format(f='population', s=', ')}, ''), 'unknown') || '; location: '
  || coalesce(nullif({_SETS.format(f='location', s=', ')}, ''), 'unknown') AS label FROM raw GROUP BY source""",
    "series_catalog": f"""
SELECT source, count(*)::BIGINT AS n_rows, min({whole('year_text')}) AS first_year, max({whole('year_text')}) AS last_year,
  {_SETS.format(f='population', s=',')} AS populations, {_SETS.format(f='location', s=',')} AS locations FROM raw GROUP BY source""",
    "source_mix": """
SELECT count(DISTINCT user_id) FILTER (user_id % 7 <> 0)::BIGINT AS n_real, count(DISTINCT user_id) FILTER (user_id % 7 = 0)::BIGINT AS n_synthetic,
  CASE WHEN bool_or(user_id % 7 = 0) AND bool_or(user_id % 7 <> 0) THEN 'mixed' WHEN bool_or(user_id % 7 <> 0) THEN 'real' ELSE 'synthetic' END AS label FROM events""",
    "blank_groups": f"""
SELECT k, week, CASE WHEN week <> 53 THEN 'plain' WHEN {year_length('year')} = 53 THEN 'week53_exists' ELSE 'week53_absent' END AS kind,
  count(*)::BIGINT AS n_cells, min(year) AS first_year, max(year) AS last_year FROM wk WHERE y IS NULL GROUP BY ALL""",
    "findings_capped": """
SELECT "check", k, year, week, place, total FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY k, year, week) AS place,
  count(*) OVER (PARTITION BY "check") AS total FROM finding) WHERE place <= 50""",
    "cell_compare": """
SELECT k, m, y AS y_a, CASE WHEN month = 8 THEN NULL WHEN month = 3 THEN y + 1 ELSE y END AS y_b, month NOT IN (3, 8) AS match FROM om""",
    "annual_reconciliation": """
SELECT k, year, summed_total, n_cells, blank_cells, zero_cells, printed_total,
  CASE WHEN printed_total IS NULL THEN 'no_printed_total' WHEN printed_total = summed_total THEN 'match' ELSE 'difference' END AS status
FROM (SELECT k, year, sum(y)::BIGINT AS summed_total, count(*)::BIGINT AS n_cells, count(*) FILTER (y IS NULL)::BIGINT AS blank_cells,
             count(*) FILTER (y = 0)::BIGINT AS zero_cells FROM study GROUP BY k, year)
LEFT JOIN (SELECT k, year, (sum(y) + CASE WHEN (year + length(k)) % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS printed_total FROM rep GROUP BY k, year) USING (k, year)""",
    "summary_cards": f"""
SELECT k, sum(t)::BIGINT AS total, {r6('sum(t) / (SELECT sum(y) FROM bm)')} AS share, arg_max(year, (t, -year)) AS peak_year,
  k = (SELECT k FROM bm GROUP BY k ORDER BY sum(y) DESC, k LIMIT 1) AS is_top
FROM (SELECT k, year, sum(y) AS t FROM bm GROUP BY k, year) GROUP BY k""",
    "seasonal_pivot": "SELECT k, month, " + ", ".join(f"coalesce(sum(y) FILTER (year = {y}), 0)::BIGINT AS y{y}" for y in range(1995, 2002)) + " FROM om GROUP BY k, month",
    "scope_subset": """
SELECT source, bool_and(upper(trim(label_text)) IN ('', 'URGENT', 'HIGH', 'MEDIUM', 'LOW')) AS inside FROM raw GROUP BY source""",
    "warning_refresh": """
SELECT source, array_to_string(list_filter([CASE WHEN n_rows % 2 = 0 THEN 'kept' ELSE 'note' END, CASE WHEN bad_year > 0 THEN 'year' END,
  CASE WHEN bad_month > 0 THEN 'month' END, CASE WHEN bad_count > 0 THEN 'count' END], lambda x: x IS NOT NULL), ',') AS warnings FROM conv""",
}
