"""Intake of raw tables: layout, headers, roles, matrix pages and wide sheets.

All operators work on many sources at once. Rows of one source are only ever aggregated, never gathered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions import calendar as cal
from tallyspan.functions.text import alnum_key, block_code, month_number, number_or_null, squeeze_spaces, strict_integer, year_header
from tallyspan.operators.quality import observation_status

# Header names by role.
ALIASES = {
    "disease": ("disease", "disease name", "illness", "diagnosis", "condition"),
    "year": ("year", "reporting year", "report year", "morbidity year"),
    "morbidity_week": ("morbidity week", "week", "week no", "week number", "epi week", "epidemiological week", "mw"),
    "case_count": ("case count", "cases", "case total", "total cases", "number of cases", "no of cases", "count", "total"),
}
REQUIRED_ROLES = ("disease", "year", "morbidity_week", "case_count")
# Table names that hold no records, and names that say nothing about the label.
NON_DATA_NAME = (
    r"^(notes?|read\s*me|instructions?|summary|overview|contents|cover|legend|definitions?|guide|documentation|metadata|changelog)(\b|[0-9])"
)
GENERIC_NAME = r"(?i)^(sheet\s*[0-9]*|data|records|weekly data|surveillance|table\s*[0-9]*)$"
TOTAL_ROWS = ("total", "grand total", "subtotal", "source reported total for verification")
DATE_COLUMNS = ("date", "report_date", "reporting_date", "onset_date", "observation_date", "period", "reporting_period")


# ---- names and columns --------------------------------------------------------------------------------------------

def canonical_names(names: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Trimmed lower-case names, blanks and hyphens as underscores.

    A target takes over the first name that stands for it, in the order of the aliases, unless the target is there already.
    """
    clean = [re.sub(r"[ -]", "_", name.strip().lower()) for name in names]
    sources: dict[str, str] = {}
    for old, new in (aliases or {}).items():
        if old in clean and new not in clean:
            sources.setdefault(new, old)
    targets = {clean.index(old): new for new, old in sources.items()}
    return [targets.get(i, name) for i, name in enumerate(clean)]


def is_non_data(name: Column) -> Column:
    """Whether a table's name says that it holds no records."""
    return alnum_key(name).rlike(NON_DATA_NAME)


def canonical_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return df.toDF(*canonical_names(df.columns, aliases))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def union_tables(tables: dict[str, DataFrame], required: list[str]) -> tuple[DataFrame, list[str]]:
    """Union of the tables that have every required column, and the names of the others.

    A table with a month column that lacks another required one is an error, since it was meant to hold records.
    """
    chosen, skipped = [], []
    for name, df in tables.items():
        lacking = missing_columns(df, required)
        if not lacking:
            chosen.append(df.select(*required))
        elif "month" in df.columns:
            raise ValueError(f"table {name} lacks {', '.join(lacking)}")
        else:
            skipped.append(name)
    if not chosen:
        raise ValueError("no table holds all required columns: " + ", ".join(sorted(required)))
    result = chosen[0]
    for df in chosen[1:]:
        result = result.unionByName(df)
    return result, skipped


def period_index(df: DataFrame, convention: str = "day-first") -> tuple[DataFrame, str]:
    """Month index from year and month, else year and week, else the first known date column."""
    columns = set(df.columns)
    if {"year", "month"} <= columns:
        year, month = strict_integer(F.col("year")), month_number(F.col("month"))
        return df.withColumn("m", cal.month_index(year, month)), "year_month"
    if {"year", "week"} <= columns:
        year, week = strict_integer(F.col("year")), strict_integer(F.col("week"))
        return df.withColumn("m", cal.iso_week_month_index(year, week)), "year_week"
    for name in DATE_COLUMNS:
        if name in columns:
            day = parse_date(F.col(name), convention)
            return df.withColumn("m", cal.month_index(F.year(day), F.month(day))), name
    raise ValueError("no period columns: year and month, year and week, or a date column")


def parse_date(text: Column, convention: str) -> Column:
    """ISO text is always year-first, plain numbers are spreadsheet serials, the rest follows the declared convention."""
    patterns = {
        "day-first": ("d/M/yyyy", "d-M-yyyy"), "month-first": ("M/d/yyyy", "M-d-yyyy"), "year-first": ("yyyy/M/d", "yyyy-M-d"),
    }
    if convention not in patterns:
        raise ValueError(f"unknown date convention {convention}")
    clean = F.trim(text)
    iso = clean.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([T ].*)?$")
    iso_text = F.regexp_extract(clean, r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", 1)
    iso_day = F.try_to_date(F.regexp_replace(iso_text, "/", "-"), "yyyy-M-d")
    serial = number_or_null(clean)
    serial_day = F.when(serial.between(1, 100000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))
    # a failing parse is slow, so only text of the right shape is tried
    shape = r"^[0-9]{4}%s[0-9]{1,2}%s[0-9]{1,2}$" if convention == "year-first" else r"^[0-9]{1,2}%s[0-9]{1,2}%s[0-9]{4}$"
    given = F.coalesce(*[
        F.when(clean.rlike(shape % (mark, mark)), F.try_to_date(clean, p)) for mark, p in zip("/-", patterns[convention])
    ])
    return F.when(iso, iso_day).when(serial.isNotNull(), serial_day).otherwise(given)


# ---- sheets -------------------------------------------------------------------------------------------------------

def role_of(text: Column) -> Column:
    pairs = [F.lit(x) for role, names in ALIASES.items() for name in names for x in (name, role)]
    return F.try_element_at(F.create_map(*pairs), alnum_key(text))


def header_rows(cells: DataFrame, searched: int = 20) -> DataFrame:
    """Header row of every source: most roles named, a bonus for a week column beside year columns, earliest on ties."""
    top = cells.filter(F.col("row_pos") < searched)
    scored = top.groupBy("source", "row_pos").agg(
        F.countDistinct(role_of(F.col("value"))).alias("roles"),
        F.max((role_of(F.col("value")) == "morbidity_week").cast("int")).alias("has_week"),
        F.count(year_header(F.col("value"))).alias("years"),
    )
    bonus = F.when((F.coalesce("has_week", F.lit(0)) == 1) & (F.col("years") > 0), 2).otherwise(0)
    ranked = scored.withColumn("score", (F.col("roles") + bonus).cast("bigint"))
    best = F.max_by(F.struct("row_pos", "score"), F.struct(F.col("score"), (-F.col("row_pos")).alias("p")))
    return ranked.groupBy("source").agg(best.alias("b")).select("source", F.col("b.row_pos").alias("header_row"), F.col("b.score").alias("score"))


def header_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Header texts of each source, blank ones named and repeated ones numbered. A source has few columns."""
    row = cells.join(headers.select("source", F.col("header_row").alias("row_pos")), ["source", "row_pos"])
    place = (F.col("col_pos") + 1).cast("string")
    named = row.withColumn("label", F.when(F.trim("value") == "", F.concat(F.lit("Unnamed column "), place)).otherwise(F.col("value")))
    order = Window.partitionBy("source", "label").orderBy("col_pos")
    return named.withColumn("_n", F.row_number().over(order)).select(
        "source", "col_pos",
        F.when(F.col("_n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" (column "), place, F.lit(")"))).alias("header"),
        role_of(F.col("value")).alias("role"),
    )


def role_resolution(headers: DataFrame) -> DataFrame:
    """Per source and required role: mapped, ambiguous or unresolved."""
    roles = headers.select("source").distinct().select("source", F.explode(F.array(*[F.lit(r) for r in REQUIRED_ROLES])).alias("role"))
    found = headers.filter(F.col("role").isNotNull()).groupBy("source", "role").agg(F.count("*").alias("n"), F.min("header").alias("header"))
    return roles.join(found, ["source", "role"], "left").select(
        "source", "role", F.when(F.col("n") == 1, F.col("header")).alias("header"),
        F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("state"),
    )


def layout_class(resolution: DataFrame, headers: DataFrame) -> DataFrame:
    """week_by_year when a week column stands beside year columns and no year column, rows when all roles map, else rejected."""
    year_columns = headers.groupBy("source").agg(F.count(year_header(F.col("header"))).alias("n_years"))
    mapped = lambda role: F.max(((F.col("role") == role) & (F.col("state") == "mapped")).cast("int"))
    roles = resolution.groupBy("source").agg(
        *[mapped(r).alias(r) for r in REQUIRED_ROLES],
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") != "mapped", F.concat("role", F.lit(":"), "state")))), ",").alias("reasons"),
    )
    return roles.join(year_columns, "source").select(
        "source",
        F.when((F.col("morbidity_week") == 1) & (F.col("n_years") > 0) & (F.col("year") == 0), "week_by_year")
        .when(F.col("disease") + F.col("year") + F.col("morbidity_week") + F.col("case_count") == 4, "rows")
        .otherwise("rejected").alias("layout"),
        "reasons",
    )


def column_roles(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Which role each body column could play, judged by all of its values; totals and blanks do not count."""
    body = cells.join(headers.select("source", "header_row"), "source").filter(F.col("row_pos") > F.col("header_row"))
    value = F.when(~alnum_key(F.col("value")).isin(list(TOTAL_ROWS)) & (F.trim("value") != ""), F.col("value"))
    number = number_or_null(value)
    whole = F.when(number % 1 == 0, number)
    sums = body.groupBy("source", "col_pos").agg(
        F.count(value).alias("n"), F.count(number).alias("n_numbers"), F.count(whole).alias("n_whole"),
        F.min(whole).alias("low"), F.max(whole).alias("high"),
    )
    all_whole = (F.col("n") > 0) & (F.col("n_whole") == F.col("n"))
    return sums.select(
        "source", "col_pos", "n",
        ((F.col("n") > 0) & (F.col("n_numbers") == 0)).alias("as_label"),
        F.coalesce(all_whole & (F.col("low") >= 1900) & (F.col("high") <= 9999), F.lit(False)).alias("as_year"),
        F.coalesce(all_whole & (F.col("low") >= 1) & (F.col("high") <= 53), F.lit(False)).alias("as_week"),
        F.coalesce(all_whole & (F.col("low") >= 0), F.lit(False)).alias("as_count"),
    )


def source_limits(cells: DataFrame, max_rows: int, max_columns: int, max_cells: int) -> DataFrame:
    """Size of every source against the limits. Rows are counted by their first cell, so no distinct count is needed."""
    sums = cells.groupBy("source").agg(
        F.count(F.when(F.col("col_pos") == 0, 1)).alias("n_rows"), (F.max("col_pos") + 1).alias("n_columns"),
        F.count("*").alias("n_cells"), F.sum(F.octet_length("value")).alias("n_bytes"),
    )
    return sums.withColumn(
        "within_limits", (F.col("n_rows") <= max_rows) & (F.col("n_columns") <= max_columns) & (F.col("n_cells") <= max_cells)
    )


def source_name_class(names: DataFrame) -> DataFrame:
    """Names that point to notes or summaries are left out by default; generic names give no label."""
    non_data = is_non_data(F.col("name"))
    generic = F.trim("name").rlike(GENERIC_NAME)
    return names.select(
        "name", non_data.alias("non_data"), (~non_data).alias("default_included"),
        F.when(~non_data & ~generic & (F.trim("name") != ""), F.col("name")).alias("label_hint"),
    )


def source_name_match(names: DataFrame, expected: list[str]) -> DataFrame:
    """Expected names found without regard to case and spaces, with a flag where the spelling differs."""
    pairs = [F.lit(x) for e in expected for x in (e.strip().lower(), e)]
    wanted = F.try_element_at(F.create_map(*pairs), F.lower(F.trim("name")))
    return names.withColumn("expected", wanted).withColumn("differs", F.col("expected").isNotNull() & (F.col("expected") != F.col("name")))


def drop_repeated_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Body cells without the rows that repeat the header's first cell."""
    first = cells.filter("col_pos = 0").join(headers, "source").filter(F.col("row_pos") == F.col("header_row")).select(
        "source", "header_row", F.lower(F.trim("value")).alias("first_header")
    )
    lead = cells.filter("col_pos = 0").join(first, "source").filter(
        (F.col("row_pos") > F.col("header_row")) & (F.lower(F.trim("value")) != F.col("first_header"))
    ).select("source", "row_pos")
    return cells.join(lead, ["source", "row_pos"], "left_semi")


def scope_tags(documents: DataFrame, text: str) -> DataFrame:
    """Tags that a document's wording sets on its data: age limits, top-n lists, absent years."""
    lower = F.lower(F.col(text))
    tags = F.array_compact(F.array(
        F.when(lower.rlike(r"aged? [0-9]+|years old|age group"), "age_limited"),
        F.when(lower.rlike(r"top [0-9]+|top five|leading"), "top_n_only"),
        F.when(lower.contains("unavailable") | lower.contains("no data"), "years_unavailable"),
    ))
    return documents.withColumn("tags", F.array_join(tags, ","))


def once(**columns: Column) -> Column:
    """Columns that are computed once per row, however often later steps use them."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


# ---- rows ---------------------------------------------------------------------------------------------------------

def unpivot_years(wide: DataFrame, id_columns: list[str]) -> DataFrame:
    """Year-headed columns into rows; a total column is ignored because the years already hold its parts."""
    years = [c for c in wide.columns if c.strip().isdigit() and 1900 <= int(c) <= 9999]
    if not years:
        raise ValueError("no year columns")
    return wide.unpivot(id_columns, years, "source_column", "value").withColumn("year", F.col("source_column").cast("bigint"))


def excluded_rows(df: DataFrame, values: list[str], period: str) -> DataFrame:
    """Reason why a row is no observation: blank, or a total."""
    blank = F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in [period, *values]]).isNull()
    return df.withColumn(
        "reason", F.when(blank, "empty_row").when(alnum_key(F.col(period)).isin(list(TOTAL_ROWS)), "total_row")
    )


def week53_rules(df: DataFrame) -> DataFrame:
    """A zero in week 53 of a 52-week year is dropped with a reason; any other supplied count there is a conflict."""
    outside = (F.col("week") == 53) & (cal.year_length(F.col("year")) == 52)
    return df.withColumn(
        "outcome",
        F.when(~outside | F.col("y").isNull(), "kept").when(F.col("y") == 0, "dropped_zero").otherwise("conflict"),
    )


def typed_rows(raw: DataFrame, allowed_codes: list[str], reasons: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every raw row with its typed values and the list of its problems; good rows have an empty list.

    The parsed values come out of an inlined struct. A later filter on the problems cannot be pushed below it, which would
    repeat every pattern in the filter, so each one is matched once per row. Columns named in `keep` pass through unchanged.
    """
    parsed = raw.select("source", "source_row", *keep, once(
        year=strict_integer(F.col("year_text")), month=month_number(F.col("month_text")), code=block_code(F.col("code_text")),
        label=squeeze_spaces(F.col("label_text")), y=strict_integer(F.col("count_text")),
        _supplied=F.nullif(F.trim("count_text"), F.lit("")).isNotNull(), _status=F.trim("status_text"),
    ))
    status, status_error = observation_status(F.col("y"), F.col("_status"), reasons)
    year = F.col("year")
    problems = F.array_compact(F.array(
        F.when(year.isNull() | ~year.between(1900, 9999), "year"),
        F.when(F.col("month").isNull(), "month"),
        F.when(~F.coalesce(F.col("code").isin(allowed_codes), F.lit(False)), "code"),
        F.when(F.coalesce("label", F.lit("")) == "", "label"),
        F.when(F.col("_supplied") & F.col("y").isNull(), "count").otherwise(status_error),
    ))
    return parsed.select(
        "source", "source_row", "year", "month", "code", "label", "y", status.alias("status"), problems.alias("problems"), *keep
    )


def expand_matrix(pages: DataFrame) -> DataFrame:
    """Cells with one line per label under month columns into rows; the year marker carries on to the rows below it.

    The carry runs inside a page group, whose rows are the lines of one printed report.
    """
    label = F.trim("label")
    marker = F.when(label.rlike(r"^(19|20)[0-9]{2}$"), label.cast("bigint"))
    order = Window.partitionBy("page").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = pages.withColumn("_marker", marker).withColumn("year", F.last("_marker", ignorenulls=True).over(order)).filter(
        F.col("_marker").isNull() & F.col("year").isNotNull()
    )
    lines = carried.select(
        "page", "row_pos", "year", F.split("label", "\n").alias("labels"),
        F.split("total", "\n").alias("totals"), F.array(*[F.split(f"c{i}", "\n") for i in range(1, 13)]).alias("columns"),
    )
    fits = F.forall("columns", lambda c: F.size(c) == F.size(F.col("labels")))
    single = lines.filter(fits).select("page", "row_pos", "year", "columns", "totals", F.posexplode("labels").alias("line", "label"))
    plain = F.trim(F.regexp_replace("label", r"\s*\([A-Z][0-9]{2}(-[A-Z]?[0-9]{2})?\)\s*$", ""))
    return single.select(
        "page", "row_pos", "year", "line", plain.alias("label"), _line_number(F.get("totals", F.col("line"))).alias("printed_total"),
        F.posexplode(F.transform("columns", lambda c: F.get(c, F.col("line")))).alias("month0", "text"),
    ).select("page", "row_pos", "year", "label", (F.col("month0") + 1).cast("bigint").alias("month"), _line_number(F.col("text")).alias("y"), "printed_total")


def _line_number(text: Column) -> Column:
    return number_or_null(F.regexp_replace(text, ",", ""))


def printed_total_check(expanded: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Lines whose months do not add up to the printed total."""
    return expanded.groupBy("page", "year", "label").agg(
        F.sum("y").alias("summed"), F.max("printed_total").alias("printed")
    ).filter(F.abs(F.col("printed") - F.col("summed")) > tolerance)


def monthly_rollup(rows: DataFrame, *metadata: str) -> DataFrame:
    """Daily or weekly rows into months; a month whose inputs are all null stays null."""
    return rows.groupBy("k", "m", *metadata).agg(F.sum("y").alias("y"), F.count("*").alias("n_rows"))


def voiding_rollup(rows: DataFrame, period: Column) -> DataFrame:
    """Larger periods; one blank input voids the whole period."""
    return rows.groupBy("k", period.alias("period")).agg(
        F.when(F.count("y") == F.count("*"), F.sum("y")).alias("y"), F.count("*").alias("n_rows")
    )


def conversion_report(typed: DataFrame) -> DataFrame:
    """Per source: rows, labels, year span, rejected rows, blockers and whether it is ready."""
    good = F.size("problems") == 0
    return typed.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count(F.when(good, 1)).alias("n_good"),
        F.countDistinct(F.when(good, F.lower("label"))).alias("n_labels"),
        F.min(F.when(good, F.col("year"))).alias("first_year"), F.max(F.when(good, F.col("year"))).alias("last_year"),
        *[F.count(F.when(F.array_contains("problems", p), 1)).alias(f"bad_{p}") for p in ("year", "month", "code", "label", "count")],
    ).withColumn("ready", (F.col("n_good") == F.col("n_rows")) & (F.col("n_good") > 0))


def assumption_prepare(weekly: DataFrame) -> DataFrame:
    """Unknown reporting status taken as complete and year lengths from the presence of week 53, both marked."""
    status = F.lower(F.coalesce("reporting_status", F.lit("unknown")))
    lengths = weekly.groupBy("k", "year").agg(F.when(F.max("week") == 53, 53).otherwise(52).cast("bigint").alias("assumed_weeks"))
    known = status.isin("complete", "incomplete")
    return weekly.join(lengths, ["k", "year"]).select(
        "k", "year", "week", "y", F.when(known, F.col("reporting_status")).otherwise("complete").alias("prepared_status"),
        (~known).alias("status_assumed"), "assumed_weeks",
    )
