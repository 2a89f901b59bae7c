"""Check SQL of the calendar family."""

from tallyspan.oracles.base import VIEWS, iso_month, week1, week_start, year_length

VIEWS["gate60"] = """
SELECT k, count(*)::BIGINT AS n_rows, count(DISTINCT m)::BIGINT AS n_periods, (max(m) - min(m) + 1)::BIGINT AS span,
       CASE WHEN count(*) > count(DISTINCT m) THEN 'duplicate_period'
            WHEN count(DISTINCT m) < max(m) - min(m) + 1 THEN 'missing_period'
            WHEN count(DISTINCT m) < 60 THEN 'insufficient_history' ELSE 'ok' END AS reason
FROM oms GROUP BY k"""

_D = f"coalesce(week_start_date, {week_start('year', 'week')})"
_YEARS = "(SELECT DISTINCT year(o_orderdate)::BIGINT AS year FROM orders)"
_T = f"({week_start('y0', 'w0')} + (7 * h)::INT)"
_L = f"(SELECT max(y) FROM unnest(range(y0, y0 + 8)) AS r(y) WHERE {week1('y')} <= {_T})"

SQL = {
    "mmwr_week1": f"SELECT year, strftime({week1('year')}, '%Y-%m-%d') AS week1_start FROM {_YEARS}",
    "mmwr_week_start": f"SELECT k, year, week, strftime({week_start('year', 'week')}, '%Y-%m-%d') AS week_start FROM wk",
    "mmwr_year_length": f"SELECT year, {year_length('year')} AS weeks FROM {_YEARS}",
    "iso_week_to_month": f"""
SELECT k, year, week, mi // 12 AS month_year, mi % 12 + 1 AS month
FROM (SELECT *, {iso_month('year', 'week')} AS mi FROM wk)""",
    "reporting_period": f"""
SELECT k, year, week, printf('%04d-W%02d', year, week) AS period_week, strftime({_D}, '%Y-%m') AS period_month,
       printf('%04dQ%d', year({_D}), quarter({_D})) AS period_quarter FROM wk""",
    "forecast_calendar": """
SELECT k, h, e + h AS m, printf('%04d-%02d', (e + h) // 12, (e + h) % 12 + 1) AS month_label
FROM (SELECT DISTINCT k FROM om), (SELECT max(m) AS e FROM om), (SELECT unnest(range(1, 13)) AS h)""",
    "month_names": "SELECT k, m, monthname(make_date((m // 12)::INT, (m % 12 + 1)::INT, 1)) AS month_name FROM om",
    "display_times": """
SELECT event_id, CASE WHEN user_id > 1 THEN strftime(ts + INTERVAL 8 HOUR, '%d %b %Y, %I:%M %p PHT') ELSE 'Not available' END AS shown FROM events""",
    "week_advance": f"""
SELECT k, h, year, week,
       CASE WHEN year IS NOT NULL THEN printf('%04d-W%02d', year, week) ELSE '+' || h END AS label
FROM (SELECT k, h, CASE WHEN landed <= known + 1 THEN landed END AS year,
             CASE WHEN landed <= known + 1 THEN ((t - {week1('landed')}) // 7 + 1)::BIGINT END AS week
      FROM (SELECT k, h, known, {_T} AS t, {_L} AS landed
            FROM (SELECT k, max(year) AS y0, max_by(week, year * 100 + week) AS w0 FROM wk GROUP BY k),
                 (SELECT max(year) AS known FROM wk), (SELECT unnest(range(1, 301)) AS h)))""",
    "dense_grid": "SELECT * FROM study",
    "weekly_grid": f"""
SELECT g.k, g.year, g.week, w.y
FROM (SELECT k, year, unnest(range(CASE WHEN year = s // 100 THEN s % 100 ELSE 1 END,
                                   (CASE WHEN year = e // 100 THEN e % 100 ELSE {year_length('year')} END) + 1)) AS week
      FROM (SELECT k, s, e, unnest(range(s // 100, e // 100 + 1)) AS year
            FROM (SELECT k, min(year * 100 + week) AS s,
                         max(year * 100 + week) FILTER (lower(reporting_status) = 'complete') AS e
                  FROM wk GROUP BY k))) g
LEFT JOIN (SELECT * FROM wk WHERE lower(reporting_status) = 'complete') w USING (k, year, week)""",
    "zero_fill_gated": """
SELECT g.k, g.m, coalesce(s.y, 0)::BIGINT AS y
FROM (SELECT k, unnest(range(min(m), max(m) + 1)) AS m FROM oms GROUP BY k) g LEFT JOIN oms s USING (k, m)
WHERE g.k IN (SELECT k FROM gate60 WHERE reason = 'ok')""",
}
