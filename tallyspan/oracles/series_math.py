"""Check SQL for lags, differences, decomposition and diagnostics."""

from tallyspan.oracles.base import VIEWS, r6
from tallyspan.oracles.forecasts import forecast_views

VIEWS["bmf"] = """
SELECT k, m, y, true AS train, NULL::BIGINT AS h FROM bm
UNION ALL SELECT k, e + 1, NULL, false, 1 FROM (SELECT DISTINCT k FROM bm), (SELECT max(m) AS e FROM bm)"""
forecast_views("g", "bmf")
VIEWS["bd"] = """
SELECT a.k, a.m, a.y, a.y - b.y AS d_season FROM bm a LEFT JOIN bm b ON b.k = a.k AND b.m = a.m - 12"""
VIEWS["bdd"] = """
SELECT a.k, a.m, a.y, a.d_season, a.d_season - b.d_season AS d_both FROM bd a LEFT JOIN bd b ON b.k = a.k AND b.m = a.m - 1"""
VIEWS["cen"] = """
SELECT k, m, d_both - avg(d_both) OVER (PARTITION BY k) AS c FROM bdd WHERE d_both IS NOT NULL"""
VIEWS["rcen"] = "SELECT k, m, r - avg(r) OVER (PARTITION BY k) AS c FROM g_res"
VIEWS["dec_t"] = """
SELECT a.k, a.m, a.y, (SELECT CASE WHEN count(b.y) = 13 THEN
       (avg(b.y) FILTER (b.m < a.m + 6) + avg(b.y) FILTER (b.m > a.m - 6)) / 2 END
  FROM bm b WHERE b.k = a.k AND b.m BETWEEN a.m - 6 AND a.m + 6) AS trend
FROM bm a WHERE a.k IN (SELECT k FROM bm GROUP BY k HAVING count(*) >= 24)"""
VIEWS["dec_s"] = """
SELECT k, ph, s - avg(s) OVER (PARTITION BY k) AS seasonal
FROM (SELECT k, m % 12 AS ph, avg(y - trend) AS s FROM dec_t GROUP BY k, m % 12)"""


def acf(source: str, lags: int) -> str:
    return f"""
SELECT k, n, span, lag, r FROM (
  SELECT z.k, n, span, lag, coalesce((SELECT sum(a.c * b.c) FROM {source} a JOIN {source} b ON b.k = a.k AND b.m = a.m - lag
                                      WHERE a.k = z.k), 0) / ss AS r
  FROM (SELECT k, count(*)::BIGINT AS n, max(m) - min(m) + 1 AS span, sum(c * c) AS ss FROM {source} GROUP BY k) z,
       (SELECT unnest(range(1, {lags + 1})) AS lag))"""


SQL = {
    "calendar_lags": "SELECT k, m, y, " + ", ".join(f"(SELECT y FROM ud x WHERE x.k = u.k AND x.m = u.m - {n}) AS lag{n}" for n in range(1, 13)) + " FROM ud u",
    "seasonal_pairs": """
SELECT a.k, a.m, a.y, b.y AS previous FROM ud a JOIN ud b ON b.k = a.k AND b.m = a.m - 7 WHERE a.y IS NOT NULL AND b.y IS NOT NULL""",
    "differences": "SELECT k, m, y, d_season, d_both FROM bdd",
    "decompose": f"""
SELECT t.k, m, y, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(y - trend - seasonal, 8) AS remainder
FROM dec_t t JOIN dec_s s ON s.k = t.k AND s.ph = t.m % 12""",
    "acf": f"""
SELECT a.k, n, lag, {r6('r')} AS r, {r6('c12')} AS lag12_correlation FROM ({acf('cen', 12)}) a
JOIN (SELECT x.k, corr(x.y::DOUBLE, z.y::DOUBLE) AS c12 FROM bm x JOIN bm z ON z.k = x.k AND z.m = x.m - 12 GROUP BY x.k) USING (k)""",
    "ljung_box_q": f"""
SELECT k, n, lim AS lag, CASE WHEN n >= 2 * lim AND n = span THEN {r6('sum(n * (n + 2) * r * r / (n - lag))')} END AS q
FROM ({acf('rcen', 24)}) JOIN (SELECT unnest([6, 12, 24])::BIGINT AS lim) ON lag <= lim GROUP BY k, n, span, lim""",
    "df_statistic": f"""
SELECT k, n, CASE WHEN n >= 8 AND n = span AND w > 0 THEN
       {r6('slope / sqrt((syy - slope * slope * sxx) / (pairs - 2) / sxx)')} END AS t_statistic
FROM (SELECT k, count(*)::BIGINT AS n, max(m) - min(m) + 1 AS span, max(y) - min(y) AS w FROM bm GROUP BY k)
JOIN (SELECT a.k, count(*) AS pairs, regr_slope((a.y - b.y)::DOUBLE, b.y::DOUBLE) AS slope,
             regr_sxx((a.y - b.y)::DOUBLE, b.y::DOUBLE) AS sxx, regr_syy((a.y - b.y)::DOUBLE, b.y::DOUBLE) AS syy
      FROM bm a JOIN bm b ON b.k = a.k AND b.m = a.m - 1 GROUP BY a.k) USING (k)""",
    "zero_runs": """
SELECT a.k, a.m FROM ud a JOIN ud b ON b.k = a.k AND b.m = a.m - 1 AND b.y = 0 JOIN ud c ON c.k = a.k AND c.m = a.m - 2 AND c.y = 0
LEFT JOIN ud d ON d.k = a.k AND d.m = a.m - 3 WHERE a.y = 0 AND d.y IS DISTINCT FROM 0""",
    "yearly_totals": "SELECT k, year, sum(y)::BIGINT AS total FROM bm GROUP BY k, year",
    "series_arrays": """
SELECT g.k, g.m, b.y FROM (SELECT k, unnest(range((SELECT min(m) FROM bm), (SELECT max(m) FROM bm) + 1)) AS m
                           FROM (SELECT DISTINCT k FROM bm)) g LEFT JOIN bm b USING (k, m)""",
}
