"""Check SQL of the intake family."""

from tallyspan.oracles.base import (
    UNAVAILABLE, VIEWS, alnum, iso_month, month_of, num, r6, squeeze, week_start, whole, year_length,
)
from tallyspan.oracles.raw import YEARS

_ALIAS = {
    "disease": ("disease", "disease name", "illness", "diagnosis", "condition"),
    "year": ("year", "reporting year", "report year", "morbidity year"),
    "morbidity_week": ("morbidity week", "week", "week no", "week number", "epi week", "epidemiological week", "mw"),
    "case_count": ("case count", "cases", "case total", "total cases", "number of cases", "no of cases", "count", "total"),
}
_CODES = "('A01-A01', 'A02-A02', 'A03-A03', 'A04-A04', 'A05-A05')"
_REASONS = "('report_unavailable', 'outside_annual_top')"
_TOTALS = "('total', 'grand total', 'subtotal', 'source reported total for verification')"


def role(expr: str) -> str:
    whens = " ".join(f"WHEN {alnum(expr)} IN {names!r} THEN '{name}'" for name, names in _ALIAS.items())
    return f"(CASE {whens} END)"


def year_header(expr: str) -> str:
    return f"(CASE WHEN {whole(expr)} BETWEEN 1900 AND 9999 THEN {whole(expr)} END)"


_CODE = r"replace(replace(upper(regexp_replace(code_text, '\s+', '', 'g')), '–', '-'), '—', '-')"
_CNT = whole("count_text")
_STATUS = f"CASE WHEN {_CNT} IS NULL AND status_text IN {_REASONS} THEN status_text WHEN {_CNT} = 0 THEN 'observed_zero' WHEN {_CNT} > 0 THEN 'observed' END"
_STATUS_ERROR = f"""CASE WHEN {_CNT} IS NULL AND coalesce(status_text NOT IN {_REASONS}, true) THEN 'missing_without_reason'
 WHEN {_CNT} < 0 THEN 'negative_count'
 WHEN status_text <> (CASE WHEN {_CNT} = 0 THEN 'observed_zero' WHEN {_CNT} > 0 THEN 'observed' END) THEN 'status_conflict' END"""

VIEWS["head_score"] = f"""
SELECT source, row_pos, roles + CASE WHEN has_week AND years > 0 THEN 2 ELSE 0 END AS score
FROM (SELECT source, row_pos, count(DISTINCT {role('value')}) AS roles, coalesce(bool_or({role('value')} = 'morbidity_week'), false) AS has_week,
             count({year_header('value')}) AS years FROM cell WHERE row_pos < 20 GROUP BY source, row_pos)"""
VIEWS["head"] = """
SELECT source, row_pos AS header_row, score FROM head_score
QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, row_pos) = 1"""
VIEWS["hcell"] = f"""
SELECT source, col_pos, {role('value')} AS role,
       CASE WHEN row_number() OVER (PARTITION BY source, label ORDER BY col_pos) = 1 THEN label
            ELSE label || ' (column ' || (col_pos + 1) || ')' END AS header
FROM (SELECT c.*, CASE WHEN trim(value) = '' THEN 'Unnamed column ' || (col_pos + 1) ELSE value END AS label
      FROM cell c JOIN head h ON h.source = c.source AND h.header_row = c.row_pos)"""
VIEWS["reso"] = """
SELECT s.source, r.role, CASE WHEN n = 1 THEN f.header END AS header,
       CASE WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state
FROM (SELECT DISTINCT source FROM hcell) s CROSS JOIN (SELECT unnest(['disease', 'year', 'morbidity_week', 'case_count']) AS role) r
LEFT JOIN (SELECT source, role, count(*) AS n, min(header) AS header FROM hcell WHERE role IS NOT NULL GROUP BY ALL) f
  ON f.source = s.source AND f.role = r.role"""
VIEWS["names"] = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Notes ' || p_name WHEN 1 THEN 'Sheet ' || p_partkey WHEN 2 THEN ' READ  ME first'
                  WHEN 3 THEN 'data' ELSE p_name END AS name FROM part"""
VIEWS["problem"] = f"""
SELECT source, source_row, {whole('year_text')} AS year, {month_of('month_text')} AS month, {_CODE} AS code,
       {squeeze('label_text')} AS label, {_CNT} AS y, {_STATUS} AS status,
       coalesce({whole('year_text')} NOT BETWEEN 1900 AND 9999, true) AS bad_year, {month_of('month_text')} IS NULL AS bad_month,
       coalesce({_CODE} NOT IN {_CODES}, true) AS bad_code, coalesce({squeeze('label_text')}, '') = '' AS bad_label,
       coalesce(trim(count_text), '') <> '' AND {_CNT} IS NULL AS bad_count, {_STATUS_ERROR} AS status_error FROM raw"""
VIEWS["conv"] = """
SELECT *, n_good = n_rows AND n_good > 0 AS ready FROM (
SELECT source, count(*)::BIGINT AS n_rows, count(*) FILTER (good)::BIGINT AS n_good, count(DISTINCT lower(label)) FILTER (good)::BIGINT AS n_labels,
       min(year) FILTER (good) AS first_year, max(year) FILTER (good) AS last_year,
       count(*) FILTER (bad_year)::BIGINT AS bad_year, count(*) FILTER (bad_month)::BIGINT AS bad_month, count(*) FILTER (bad_code)::BIGINT AS bad_code,
       count(*) FILTER (bad_label)::BIGINT AS bad_label, count(*) FILTER (bad_count)::BIGINT AS bad_count
FROM (SELECT *, NOT (bad_year OR bad_month OR bad_code OR bad_label OR bad_count OR status_error IS NOT NULL) AS good FROM problem) GROUP BY source)"""
VIEWS["deci"] = f"""
SELECT k, year, week, target,
       CASE WHEN target = 'conflict' THEN CASE WHEN pick < 3 THEN 'include' WHEN pick < 6 THEN 'exclude' ELSE 'guess' END
            WHEN pick = 0 THEN 'zero' WHEN pick = 1 THEN 'missing' WHEN pick = 2 THEN 'nonexistent' WHEN pick = 6 THEN 'guess' ELSE 'corrected' END AS action,
       CASE WHEN source_row % 11 = 0 THEN ' ' ELSE 'letter' END AS evidence,
       CASE WHEN pick = 3 THEN '4' WHEN pick = 4 THEN '2.5' END AS corrected
FROM (SELECT *, CASE WHEN y IS NULL THEN 'blank' ELSE 'conflict' END AS target, source_row % 7 AS pick FROM wk
      WHERE y IS NULL OR (week = 53 AND {year_length('year')} = 52))"""
VIEWS["dchk"] = f"""
SELECT *, CASE WHEN target = 'blank' AND action NOT IN ('zero', 'missing', 'nonexistent', 'corrected') THEN 'unknown_action'
   WHEN target = 'conflict' AND action NOT IN ('include', 'exclude') THEN 'unknown_action'
   WHEN trim(evidence) = '' THEN 'evidence_required'
   WHEN action = 'corrected' AND (corrected IS NULL OR corrected <> '4') THEN 'bad_corrected_value'
   WHEN action = 'nonexistent' AND {year_length('year')} <> 52 THEN 'week_exists' ELSE 'ok' END AS error FROM deci"""


def day(expr: str, pattern: str) -> str:
    t = f"trim({expr})"
    return f"""strftime(CASE WHEN regexp_matches({t}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([T ].*)?$')
      THEN try_strptime(replace(regexp_extract({t}, '^[0-9/-]+'), '/', '-'), '%Y-%m-%d')::DATE
      WHEN {num(expr)} IS NOT NULL THEN CASE WHEN {num(expr)} BETWEEN 1 AND 100000 THEN DATE '1899-12-30' + floor({num(expr)})::INT END
      ELSE try_strptime({t}, '{pattern}')::DATE END, '%Y-%m-%d')"""


_DAY = f"coalesce(week_start_date, {week_start('year', 'week')})"
_W55 = "(source_row % 55)"

SQL = {
    "scan_typed": "SELECT k, year, month, m, y FROM om",
    "multi_source_union": "SELECT k, year, month, y, 'annual totals' AS skipped FROM om",
    "scan_raw_cells": """
SELECT source_row::VARCHAR AS row_key, i AS col_pos, coalesce([source_row::VARCHAR, year_text, month_text, count_text][i + 1], '') AS value
FROM raw, (SELECT unnest(range(0, 4)) AS i)""",
    "header_row_detect": "SELECT source, header_row, score FROM head",
    "source_limits": """
SELECT *, n_rows <= 20 AND n_columns <= 5 AND n_cells <= 100 AS within_limits
FROM (SELECT source, count(DISTINCT row_pos)::BIGINT AS n_rows, (max(col_pos) + 1)::BIGINT AS n_columns, count(*)::BIGINT AS n_cells,
             sum(strlen(value))::BIGINT AS n_bytes FROM cell GROUP BY source)""",
    "column_role_profile": f"""
SELECT source, col_pos, n, n > 0 AND nn = 0 AS as_label, n > 0 AND nw = n AND lo >= 1900 AND hi <= 9999 AS as_year,
       n > 0 AND nw = n AND lo >= 1 AND hi <= 53 AS as_week, n > 0 AND nw = n AND lo >= 0 AS as_count
FROM (SELECT source, col_pos, count(v)::BIGINT AS n, count({num('v')}) AS nn, count({whole('v')}) AS nw,
             coalesce(min({whole('v')}), -1) AS lo, coalesce(max({whole('v')}), -1) AS hi
      FROM (SELECT c.source, col_pos, CASE WHEN trim(value) <> '' AND {alnum('value')} NOT IN {_TOTALS} THEN value END AS v
            FROM cell c JOIN head h USING (source) WHERE row_pos > header_row) GROUP BY ALL)""",
    "header_dedupe": "SELECT source, col_pos, header FROM hcell",
    "alias_resolution": "SELECT source, role, header, state FROM reso",
    "layout_class": f"""
SELECT source, CASE WHEN w AND ny > 0 AND NOT yr THEN 'week_by_year' WHEN nm = 4 THEN 'rows' ELSE 'rejected' END AS layout, reasons
FROM (SELECT source, bool_or(role = 'morbidity_week' AND state = 'mapped') AS w, bool_or(role = 'year' AND state = 'mapped') AS yr,
             count(*) FILTER (state = 'mapped') AS nm,
             coalesce(string_agg(role || ':' || state, ',' ORDER BY role || ':' || state) FILTER (state <> 'mapped'), '') AS reasons
      FROM reso GROUP BY source) JOIN (SELECT source, count({year_header('header')}) AS ny FROM hcell GROUP BY source) USING (source)""",
    "year_headers": f"SELECT source, row_pos, col_pos, {year_header('value')} AS year FROM cell WHERE {year_header('value')} IS NOT NULL",
    "repeated_header_drop": """
SELECT c.* FROM cell c JOIN head h ON h.source = c.source
JOIN cell f ON f.source = c.source AND f.row_pos = h.header_row AND f.col_pos = 0
JOIN cell l ON l.source = c.source AND l.row_pos = c.row_pos AND l.col_pos = 0
WHERE c.row_pos > h.header_row AND lower(trim(l.value)) <> lower(trim(f.value))""",
    "source_name_class": r"""
SELECT name, nd AS non_data, NOT nd AS default_included,
       CASE WHEN NOT nd AND NOT regexp_full_match(trim(name), '(sheet\s*[0-9]*|data|records|weekly data|surveillance|table\s*[0-9]*)', 'i') THEN name END AS label_hint,
       count(*)::BIGINT AS n
FROM (SELECT name, regexp_matches(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '^(notes?|read ?me|summary)( |$|[0-9])') AS nd FROM names)
GROUP BY ALL""",
    "source_name_match": """
SELECT p_partkey, name, e AS expected, coalesce(e <> name, false) AS differs
FROM (SELECT p_partkey, name, CASE lower(trim(name)) WHEN 'economy' THEN 'ECONOMY' WHEN 'promo' THEN 'Promo' END AS e
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' || lower(p_type) ELSE p_type END AS name FROM part))""",
    "matrix_expand": """
SELECT num // 2 AS page, year, k AS label, month, y::DOUBLE AS y, (t + CASE WHEN (year + num) % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE AS printed_total
FROM mx JOIN (SELECT k, year, sum(y) AS t FROM mx GROUP BY ALL) USING (k, year)""",
    "printed_total_check": """
SELECT num // 2 AS page, year, k AS label, sum(y)::DOUBLE AS summed, (sum(y) + 1)::DOUBLE AS printed FROM mx
WHERE (year + num) % 5 = 0 GROUP BY ALL""",
    "scope_tags": """
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(lower(text), 'aged? [0-9]+|years old|age group') THEN 'age_limited' END,
  CASE WHEN regexp_matches(lower(text), 'top [0-9]+|top five|leading') THEN 'top_n_only' END,
  CASE WHEN contains(lower(text), 'unavailable') OR contains(lower(text), 'no data') THEN 'years_unavailable' END], lambda x: x IS NOT NULL), ',') AS tags
FROM documents""",
    "canonical_columns": "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS balance FROM customer",
    "required_columns": """
SELECT 'monthly' AS name, '' AS missing, count(*)::BIGINT AS n_rows FROM om
UNION ALL SELECT 'events', 'k,month,y,year', count(*)::BIGINT FROM events UNION ALL SELECT 'orders', 'k,month,y,year', count(*)::BIGINT FROM orders""",
    "strict_integer": f"SELECT source_row, {whole('year_text')} AS year, {_CNT} AS y FROM raw",
    "month_parse": f"SELECT source_row, {month_of('month_text')} AS month FROM raw",
    "code_normalize": f"""
SELECT source_row, code, CASE WHEN NOT regexp_full_match(code, '[AB][0-9]{{2}}-[AB][0-9]{{2}}') THEN 'bad_pattern'
       WHEN substr(code, 1, 3) > substr(code, 5, 3) THEN 'reversed_range' WHEN code NOT IN {_CODES} THEN 'outside_pool' END AS error
FROM (SELECT source_row, {_CODE} AS code FROM raw)""",
    "label_clean": f"SELECT source_row, {squeeze('label_text')} AS label, {squeeze('label_text')} <> '' AS usable FROM raw",
    "label_first_spelling": f"""
SELECT source_row, first_value({squeeze('label_text')}) OVER (PARTITION BY lower({squeeze('label_text')}) ORDER BY source_row) AS canonical,
       length({squeeze('label_text')}) BETWEEN 1 AND 200 AS label_ok FROM raw""",
    "label_conflicts": """
SELECT label_key, count(*)::BIGINT AS n_spellings, sum(n)::BIGINT AS n_rows, bool_or(label <> trim(label)) AS padded,
       count(*) > 1 OR bool_or(label <> trim(label)) AS inconsistent
FROM (SELECT label_text AS label, lower(trim(label_text)) AS label_key, count(*) AS n FROM raw GROUP BY ALL) GROUP BY label_key""",
    "observation_status": f"SELECT source_row, {_STATUS} AS status, {_STATUS_ERROR} AS error FROM raw",
    "availability_rules": f"""
SELECT * FROM (SELECT source_row, year, status,
  CASE WHEN year IN {UNAVAILABLE} AND status IS DISTINCT FROM 'report_unavailable' THEN 'count_in_unavailable_year'
       WHEN year NOT IN {UNAVAILABLE} AND status = 'report_unavailable' THEN 'unavailable_in_reported_year' END AS error
FROM (SELECT source_row, {whole('year_text')} AS year, {_STATUS} AS status FROM raw)) WHERE error IS NOT NULL""",
    "count_domain": f"""
SELECT * FROM (SELECT source_row, count_text, CASE WHEN coalesce(trim(count_text), '') = '' THEN NULL WHEN {num('count_text')} IS NULL THEN 'not_a_number'
  WHEN {num('count_text')} < 0 THEN 'negative' WHEN {num('count_text')} <> floor({num('count_text')}) THEN 'not_whole' END AS error FROM raw) WHERE error IS NOT NULL""",
    "range_check": f"""
SELECT 'year_text' AS field, source_row, year_text AS value FROM raw WHERE coalesce({whole('year_text')} NOT BETWEEN 1900 AND 9999, true)
UNION ALL SELECT 'month_text', source_row, month_text FROM raw WHERE coalesce({whole('month_text')} NOT BETWEEN 1 AND 12, true)""",
    "range_summary": f"""
SELECT field, value, count(*)::BIGINT AS n, min(source_row) AS first_row, max(source_row) AS last_row FROM (
SELECT 'year_text' AS field, source_row, year_text AS value FROM raw WHERE coalesce({whole('year_text')} NOT BETWEEN 1900 AND 9999, true)
UNION ALL SELECT 'month_text', source_row, month_text FROM raw WHERE coalesce({whole('month_text')} NOT BETWEEN 1 AND 12, true)) GROUP BY field, value""",
    "date_convention_parse": f"SELECT source_row, {day('date_text', '%d/%m/%Y')} AS day_first, {day('date_text', '%m/%d/%Y')} AS month_first FROM raw",
    "excluded_rows": f"""
SELECT * FROM (SELECT k, week, CASE WHEN week = 'Grand Total' THEN 'total_row' END AS reason FROM wide) WHERE reason IS NOT NULL""",
    "unpivot_years": f"""
SELECT w.k, w.week, y.year, y.year::VARCHAR AS source_column, v.y
FROM (SELECT DISTINCT k, week FROM wk) w CROSS JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS year) y
LEFT JOIN wk v ON v.k = w.k AND v.week = w.week AND v.year = y.year""",
    "week53_rules": f"""
SELECT k, year, week, y, CASE WHEN week < 53 OR {year_length('year')} = 53 OR y IS NULL THEN 'kept' WHEN y = 0 THEN 'dropped_zero' ELSE 'conflict' END AS outcome FROM wk""",
    "range_filter": """
SELECT k, year, month, y FROM bm WHERE k IN ('Brand#1', 'Brand#2') AND m BETWEEN 1996 * 12 + 3 AND 1999 * 12 + 5""",
    "training_exclusion": """
SELECT k, year, week, coalesce(nullif(trim(reporting_status), ''), 'unknown') AS effective_status,
       lower(coalesce(nullif(trim(reporting_status), ''), 'unknown')) <> 'complete' AS excluded FROM wk""",
    "assumption_prepare": """
SELECT k, year, week, y, coalesce(reporting_status, 'complete') AS prepared_status, reporting_status IS NULL AS status_assumed,
       (CASE WHEN max(week) OVER (PARTITION BY k, year) = 53 THEN 53 ELSE 52 END)::BIGINT AS assumed_weeks FROM wk""",
    "display_format": """
SELECT k, year, format('{:,.1f}', t::DOUBLE) AS total_text, CASE WHEN s < 0.004 THEN '<0.004' ELSE printf('%.3f', s) END AS share_text,
       CASE WHEN n = 12 THEN printf('%.1f', t / 8) ELSE 'Not available' END AS mean_text
FROM (SELECT k, year, t, n, round(t / sum(t) OVER (PARTITION BY year) / 10, 9) AS s
      FROM (SELECT k, year, sum(y)::DOUBLE AS t, count(*) AS n FROM bm GROUP BY ALL))""",
    "metadata_adoption": " UNION ALL ".join(f"""
SELECT source, '{f}' AS field, CASE WHEN a THEN v END AS value, CASE WHEN a THEN 'adopted' WHEN n > 0 THEN 'incomplete' ELSE 'absent' END AS state
FROM (SELECT source, count({f}) AS n, min({f}) AS v, count({f}) = count(*) AND count(DISTINCT {f}) = 1 AS a FROM raw GROUP BY source)"""
                                      for f in ("population", "location", "reporting_status")),
    "decision_check": "SELECT * FROM dchk",
    "apply_decisions": """
SELECT w.k, w.year, w.week, w.y, d.action, coalesce(d.action IN ('nonexistent', 'exclude'), false) AS excluded,
       CASE WHEN d.action = 'zero' THEN 0 WHEN d.action = 'corrected' THEN 4 WHEN d.action IN ('nonexistent', 'exclude') THEN NULL ELSE w.y END::BIGINT AS resolved
FROM wk w LEFT JOIN dchk d ON d.k = w.k AND d.year = w.year AND d.week = w.week AND d.error = 'ok'""",
    "completeness_claim": """
SELECT *, NOT claimed OR reference IS NOT NULL AS accepted
FROM (SELECT source, bool_and(lower(coalesce(reporting_status, 'unknown')) = 'complete') AS claimed, max(location) AS reference FROM raw GROUP BY source)""",
    "period_source": f"""
SELECT 'monthly' AS variant, 'year_month' AS used, {whole('year_text')} * 12 + {month_of('month_text')} - 1 AS m, count(*)::BIGINT AS n FROM raw GROUP BY ALL
UNION ALL SELECT 'weekly', 'year_week', m, count(*)::BIGINT FROM (SELECT CASE WHEN yr IS NOT NULL THEN {iso_month('yr', _W55)} END AS m
   FROM (SELECT source_row, {whole('year_text')} AS yr FROM raw)) GROUP BY ALL
UNION ALL SELECT 'dated', 'report_date', substr(d, 1, 4)::BIGINT * 12 + substr(d, 6, 2)::BIGINT - 1, count(*)::BIGINT
FROM (SELECT {day('date_text', '%d/%m/%Y')} AS d FROM raw) GROUP BY ALL""",
    "default_metadata": """
SELECT source_row, coalesce(population, 'unknown') AS population, coalesce(location, 'unknown') AS location, printf('%04d-%02d-01', year, month) AS date
FROM problem JOIN (SELECT source_row, population, location FROM raw) USING (source_row)
WHERE NOT (bad_year OR bad_month OR bad_code OR bad_label OR bad_count OR status_error IS NOT NULL)""",
    "typed_rows": """
SELECT source, source_row, year, month, code, label, y, status, array_to_string(list_filter([
  CASE WHEN bad_year THEN 'year' END, CASE WHEN bad_month THEN 'month' END, CASE WHEN bad_code THEN 'code' END, CASE WHEN bad_label THEN 'label' END,
  CASE WHEN bad_count THEN 'count' ELSE status_error END], lambda x: x IS NOT NULL), ',') AS problems FROM problem""",
    "conversion_report": "SELECT * FROM conv",
    "monthly_rollup": """
SELECT k, m, population, sum(y)::BIGINT AS y, count(*)::BIGINT AS n_rows
FROM (SELECT k, y, CASE WHEN k % 3 = 0 THEN 'young' ELSE 'all' END AS population,
             year(DATE '1970-01-01' + m::INT) * 12 + month(DATE '1970-01-01' + m::INT) - 1 AS m FROM ud) GROUP BY k, m, population""",
    "voiding_rollup": f"""
SELECT k, printf('%04dQ%d', year({_DAY}), quarter({_DAY})) AS period, CASE WHEN count(y) = count(*) THEN sum(y)::BIGINT END AS y, count(*)::BIGINT AS n_rows
FROM wk GROUP BY ALL""",
    "source_status": """
SELECT source, CASE WHEN regexp_matches(trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')), '^(notes?|read ?me|instructions?|summary|overview|contents|cover|legend|definitions?|guide|documentation|metadata|changelog)( |$|[0-9])') THEN 'excluded' WHEN unmapped THEN 'needs_mapping' WHEN errors <> '' THEN 'invalid' ELSE 'ready' END AS status, errors
FROM (SELECT source, n_rows, unmapped, array_to_string(list_sort(list_filter([CASE WHEN bad_year > 0 THEN 'year' END, CASE WHEN bad_month > 0 THEN 'month' END,
        CASE WHEN bad_code > 0 THEN 'code' END, CASE WHEN bad_label > 0 THEN 'label' END, CASE WHEN bad_count > 0 THEN 'count' END], lambda x: x IS NOT NULL)), ';') AS errors
      FROM conv JOIN (SELECT source, bool_or(state <> 'mapped') AS unmapped FROM reso GROUP BY source) USING (source))""",
    "series_sort": "SELECT k, year, week, row_number() OVER (PARTITION BY k ORDER BY year, week) AS place FROM wk",
    "preview_page": "SELECT source_row, year, month, y FROM problem ORDER BY source_row LIMIT 25 OFFSET 25",
    "share_of_blank": f"""
SELECT source, count(*) FILTER (c IS NULL)::BIGINT AS blank, count(*) FILTER (c = 0)::BIGINT AS zero, count(*) FILTER (c > 0)::BIGINT AS positive,
       {r6('avg(c) FILTER (c >= 0)')} AS mean_count FROM (SELECT source, {_CNT} AS c FROM raw) GROUP BY source""",
}
