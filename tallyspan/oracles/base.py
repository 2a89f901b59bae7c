"""Plain SQL for the check side: shared table expressions and a small composer."""

from __future__ import annotations

import re

# name -> select statement; later ones may use earlier ones
VIEWS: dict[str, str] = {}

UNAVAILABLE = "(1997, 1999)"
NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"
SHORT = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def compose(final: str) -> str:
    """Put the table expressions that a statement uses in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(final)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" + final) if parts else final


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE)"


def num(expr: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({expr}), {NUMBER}) THEN try_cast(trim({expr}) AS DOUBLE) END)"


def whole(expr: str) -> str:
    return f"(CASE WHEN {num(expr)} = floor({num(expr)}) AND abs({num(expr)}) < 9e15 THEN {num(expr)}::BIGINT END)"


def month_of(expr: str) -> str:
    t = f"lower(trim({expr}))"
    n = f"coalesce(nullif(list_position({MONTHS}, {t}), 0), nullif(list_position({SHORT}, {t}), 0), {whole(expr)})"
    return f"(CASE WHEN {n} BETWEEN 1 AND 12 THEN ({n})::BIGINT END)"


def squeeze(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def alnum(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g'))"


def label(m: str) -> str:
    return f"printf('%04d-%02d', ({m}) // 12, ({m}) % 12 + 1)"


def week1(y: str) -> str:
    j = f"make_date(({y})::INT, 1, 1)"
    return f"({j} + (CASE WHEN dayofweek({j}) > 3 THEN 7 - dayofweek({j}) ELSE -dayofweek({j}) END)::INT)"


def week_start(y: str, w: str) -> str:
    return f"({week1(y)} + (7 * (({w}) - 1))::INT)"


def year_length(y: str) -> str:
    return f"((({week1(f'({y}) + 1')} - {week1(y)}) // 7)::BIGINT)"


def iso1(y: str) -> str:
    return f"date_trunc('week', make_date(({y})::INT, 1, 4))::DATE"


def iso_length(y: str) -> str:
    return f"((({iso1(f'({y}) + 1')} - {iso1(y)}) // 7)::BIGINT)"


def iso_month(y: str, w: str) -> str:
    t = f"({iso1(y)} + (7 * (({w}) - 1) + 3)::INT)"
    return (
        f"(CASE WHEN ({w}) BETWEEN 1 AND {iso_length(y)} THEN year({t}) * 12 + month({t}) - 1 "
        f"WHEN ({w}) = 53 THEN ({y}) * 12 + 11 END)::BIGINT"
    )


def hash_text(*exprs: str) -> str:
    return " || ".join(f"coalesce(length(({e})::VARCHAR)::VARCHAR || ':' || ({e})::VARCHAR, '~')" for e in exprs)


def signature(*exprs: str) -> str:
    h = f"sha256({hash_text(*exprs)})"
    lanes = [
        f"coalesce(sum((('0x' || substr({h}, {1 + 15 * i}, 15))::BIGINT >> {20 * j}) & 1048575), 0)::VARCHAR"
        for i in range(4) for j in range(3)
    ]
    return f"sha256(count({h})::VARCHAR || '/' || " + " || '/' || ".join(lanes) + ")"


VIEWS["om"] = """
SELECT o_orderpriority AS k, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month,
       (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS m, count(*)::BIGINT AS y
FROM orders GROUP BY ALL"""
VIEWS["oms"] = """
SELECT o_orderpriority || '/' || o_orderstatus AS k, year(o_orderdate)::BIGINT AS year,
       month(o_orderdate)::BIGINT AS month,
       (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS m, count(*)::BIGINT AS y
FROM orders GROUP BY ALL"""
VIEWS["bm"] = """
SELECT p_brand AS k, year(l_shipdate)::BIGINT AS year, month(l_shipdate)::BIGINT AS month,
       (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS m, sum(l_quantity)::BIGINT AS y
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
VIEWS["ud_seen"] = """
SELECT user_id AS k, (ts::DATE - DATE '1970-01-01')::BIGINT AS m, count(*) FILTER (event_type = 'error')::BIGINT AS y
FROM events GROUP BY ALL"""
VIEWS["ud"] = """
SELECT g.k, g.m, s.y, s.y IS NOT NULL AS observed
FROM (SELECT k, unnest(range((SELECT min(m) FROM ud_seen), (SELECT max(m) FROM ud_seen) + 1)) AS m
      FROM (SELECT DISTINCT k FROM ud_seen)) g LEFT JOIN ud_seen s USING (k, m)"""
VIEWS["rep_year"] = f"""
SELECT year, k, row_number() OVER (PARTITION BY year ORDER BY sum(y) DESC, k) AS rk
FROM bm WHERE year BETWEEN 1995 AND 2001 AND year NOT IN {UNAVAILABLE} GROUP BY year, k"""
VIEWS["rep"] = """
SELECT bm.k, bm.year, bm.month, bm.m, bm.y FROM bm JOIN rep_year r ON bm.k = r.k AND bm.year = r.year AND r.rk <= 5"""
VIEWS["study_cells"] = """
SELECT k, unnest(range(1995 * 12, 2001 * 12 + 12)) AS m FROM (SELECT DISTINCT k FROM rep)"""
VIEWS["study"] = f"""
SELECT c.k, c.m, (c.m // 12)::BIGINT AS year, (c.m % 12 + 1)::BIGINT AS month, r.y,
       CASE WHEN r.y = 0 THEN 'observed_zero' WHEN r.y IS NOT NULL THEN 'observed'
            WHEN c.m // 12 IN {UNAVAILABLE} THEN 'report_unavailable' ELSE 'outside_annual_top' END AS status,
       EXISTS (SELECT 1 FROM rep p WHERE p.k = c.k AND p.year = c.m // 12) AS present,
       (c.m // 12) NOT IN {UNAVAILABLE} AS year_available
FROM study_cells c LEFT JOIN rep r ON r.k = c.k AND r.m = c.m"""
VIEWS["wk"] = """
SELECT n_name AS k, year(o_orderdate)::BIGINT AS year, ((dayofyear(o_orderdate) - 1) // 7 + 1)::BIGINT AS week,
       CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0
            THEN count(*) FILTER (o_orderstatus = 'F')::BIGINT END AS y,
       CASE WHEN count(*) % 7 = 0 THEN NULL WHEN count(*) % 5 = 0 THEN 'Incomplete' ELSE 'complete' END AS reporting_status,
       CASE WHEN count(*) % 2 = 0 THEN min(o_orderdate)::DATE END AS week_start_date,
       min(o_orderkey)::BIGINT AS source_row
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3"""
