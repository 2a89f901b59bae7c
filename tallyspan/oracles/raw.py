"""Table expressions for the raw rows and cells."""

from tallyspan.oracles.base import MONTHS, VIEWS


def _every(n: int) -> str:
    return f"o_orderkey % {n} = 0"


_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
_NAME = f"upper(substr({MONTHS}[{_M}], 1, 1)) || substr({MONTHS}[{_M}], 2)"
_DIGIT, _WORD = "substr(o_orderpriority, 1, 1)", "substr(o_orderpriority, 3, 20)"
_INIT = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' "
         "WHEN '4' THEN 'Not Specified' ELSE 'Low' END")
_COUNT = "floor(o_totalprice / 1000)::BIGINT::VARCHAR"

VIEWS["raw"] = f"""
SELECT 'sheet ' || o_custkey AS source, o_orderkey AS source_row,
  CASE WHEN {_every(17)} THEN 'x' WHEN {_every(19)} THEN {_Y} || '.5' WHEN {_every(23)} THEN NULL WHEN {_every(29)} THEN '3'
       WHEN {_every(5)} THEN {_Y} || '.0' ELSE {_Y}::VARCHAR END AS year_text,
  CASE WHEN {_every(37)} THEN 'Smarch' WHEN {_every(41)} THEN '13' WHEN {_every(3)} THEN ' ' || upper({_NAME})
       WHEN {_every(2)} THEN lower(substr({_NAME}, 1, 3)) ELSE {_M}::VARCHAR END AS month_text,
  CASE WHEN {_every(43)} THEN 'Z9' WHEN {_every(47)} THEN 'B0' || {_DIGIT} || '-A00'
       WHEN {_every(2)} THEN ' a0' || {_DIGIT} || ' – a0' || {_DIGIT} || ' ' ELSE 'A0' || {_DIGIT} || '-A0' || {_DIGIT} END AS code_text,
  CASE WHEN {_every(31)} THEN '  ' WHEN {_every(7)} THEN ' ' || lower({_WORD}) || '  ' WHEN {_every(4)} THEN {_INIT} ELSE {_WORD} END AS label_text,
  CASE WHEN {_every(13)} THEN NULL WHEN {_every(53)} THEN '' WHEN {_every(59)} THEN 'n/a' WHEN {_every(61)} THEN '-4'
       WHEN {_every(67)} THEN '2.5' WHEN {_every(11)} THEN '0' ELSE {_COUNT} END AS count_text,
  CASE WHEN {_every(26)} THEN 'report_unavailable' WHEN {_every(39)} THEN 'outside_annual_top' WHEN {_every(71)} THEN 'observed' END AS status_text,
  CASE WHEN {_every(73)} THEN 'soon' WHEN {_every(6)} THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN {_every(5)} THEN (o_orderdate::DATE - DATE '1899-12-30')::VARCHAR ELSE {_D} || '/' || {_M} || '/' || {_Y} END AS date_text,
  CASE WHEN {_every(10)} THEN NULL WHEN {_every(9)} THEN 'incomplete' WHEN {_every(8)} THEN 'COMPLETE' ELSE 'complete' END AS reporting_status,
  CASE WHEN o_custkey % 3 = 0 THEN '5-19' WHEN {_every(79)} THEN NULL ELSE 'all ages' END AS population,
  CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'North' ELSE 'South' END AS location
FROM orders"""

_STYLES = """[['Disease','Year','Morbidity Week','Case Count','Notes'],
 ['Illness','Reporting Year','Epi Week','No. of Cases','Remarks'],
 ['Diagnosis ','Report Year','Week No','Total','Total'],
 ['Label','Period','Wk','','']]"""
VIEWS["sheet_rows"] = f"""
SELECT 'sheet ' || o_custkey AS source, o_orderkey + 10 AS row_pos,
       [{_WORD}, {_Y}::VARCHAR, ((dayofyear(o_orderdate) - 1) // 7 + 1)::VARCHAR,
        CASE WHEN {_every(13)} THEN '' ELSE {_COUNT} END, CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE '' END] AS cells
FROM orders
UNION ALL SELECT 'sheet ' || c_custkey, 3, {_STYLES}[c_custkey % 4 + 1] FROM customer
UNION ALL SELECT 'sheet ' || c_custkey, t, ['Weekly report', '', '', '', '']
FROM customer, (SELECT unnest(range(0, 3)) AS t) WHERE t < c_custkey % 3 + 1"""
VIEWS["cell"] = """
SELECT source, row_pos, i - 1 AS col_pos, cells[i] AS value FROM sheet_rows, (SELECT unnest(range(1, 6)) AS i)"""

YEARS = range(1995, 2002)
VIEWS["wide"] = f"""
SELECT k, week::VARCHAR AS week, {', '.join(f'''max(coalesce(y::VARCHAR, '')) FILTER (year = {y}) AS "{y}"''' for y in YEARS)},
       sum(y)::BIGINT::VARCHAR AS "Total" FROM wk GROUP BY k, week
UNION ALL SELECT k, 'Grand Total', {', '.join(f'''sum(y) FILTER (year = {y})::BIGINT::VARCHAR''' for y in YEARS)}, sum(y)::BIGINT::VARCHAR FROM wk GROUP BY k"""
VIEWS["mx"] = """
SELECT k, regexp_extract(k, '([0-9]+)$', 1)::BIGINT AS num, year, month, y
FROM (SELECT k, year, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT k, year FROM bm)) LEFT JOIN bm USING (k, year, month)"""
