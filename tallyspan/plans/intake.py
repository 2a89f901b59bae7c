"""Queries of the intake family: sources, columns, cells and raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import SCOPE
from tallyspan.functions import calendar as cal
from tallyspan.functions import text as tx
from tallyspan.functions.numeric import r6
from tallyspan.operators import intake, quality
from tallyspan.plans.registry import query
from tallyspan.session import new_folder
from tallyspan.sources import raw, readers, series
from tallyspan.sources.tables import table

CODES = [f"A0{i}-A0{i}" for i in range(1, 6)]
REASONS = ["report_unavailable", "outside_annual_top"]
CELL_REQUIRED = ["k", "year", "month", "y"]


def typed(spark, folder):
    return intake.typed_rows(raw.raw_orders(spark, folder), CODES, REASONS)


@query("scan_typed")
def scan_typed(spark, folder):
    """The monthly table written as CSV with a header and read back as text, then typed."""
    path = new_folder(spark, "monthly-csv")
    series.orders_monthly(spark, folder).write.csv(path, header=True)
    return readers.read_monthly_csv(spark, path, ["k", "year", "month", "m", "y"])


@query("multi_source_union")
def multi_source_union(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    tables = {
        "early": monthly.filter("year <= 1998"),
        "late": monthly.filter("year > 1998"),
        "annual totals": monthly.groupBy("k", "year").agg(F.sum("y").alias("total")),
    }
    rows, skipped = intake.union_tables(tables, CELL_REQUIRED)
    return rows.withColumn("skipped", F.lit(",".join(skipped)))


@query("scan_raw_cells")
def scan_raw_cells(spark, folder):
    """Headerless text with an unusual delimiter; every cell stays as it is, blank ones too."""
    path = new_folder(spark, "raw-text")
    columns = ["source_row", "year_text", "month_text", "count_text"]
    rows = raw.raw_orders(spark, folder).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    rows.select(F.concat_ws(";", *columns).alias("value")).write.text(path)
    return readers.read_raw_cells(spark, path, ";")


@query("header_row_detect")
def header_row_detect(spark, folder):
    return intake.header_rows(raw.sheet_cells(spark, folder))


@query("source_limits")
def source_limits(spark, folder):
    return intake.source_limits(raw.sheet_cells(spark, folder), 20, 5, 100)


@query("column_role_profile")
def column_role_profile(spark, folder):
    cells = raw.sheet_cells(spark, folder)
    return intake.column_roles(cells, intake.header_rows(cells))


def _headers(spark, folder):
    cells = raw.sheet_cells(spark, folder)
    return intake.header_cells(cells, intake.header_rows(cells))


@query("header_dedupe")
def header_dedupe(spark, folder):
    return _headers(spark, folder).select("source", "col_pos", "header")


@query("alias_resolution")
def alias_resolution(spark, folder):
    return intake.role_resolution(_headers(spark, folder))


@query("layout_class")
def layout_class(spark, folder):
    headers = _headers(spark, folder)
    return intake.layout_class(intake.role_resolution(headers), headers)


@query("year_headers")
def year_headers(spark, folder):
    found = tx.year_header(F.col("value"))
    return raw.sheet_cells(spark, folder).select("source", "row_pos", "col_pos", found.alias("year")).filter("year is not null")


@query("repeated_header_drop")
def repeated_header_drop(spark, folder):
    cells = raw.sheet_cells(spark, folder)
    headers = intake.header_rows(cells).select("source", "header_row")
    repeated = cells.join(headers, "source").filter("row_pos = header_row").drop("header_row")
    paged = cells.unionByName(repeated.withColumn("row_pos", F.lit(1_000_000_000_000).cast("bigint")))
    return intake.drop_repeated_headers(paged, headers)


def _part_names(spark, folder):
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    return part.select(
        "p_partkey", "p_type",
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("Notes "), "p_name")).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("Sheet "), F.col("p_partkey").cast("string")))
        .when(F.col("p_partkey") % 6 == 2, F.lit(" READ  ME first")).when(F.col("p_partkey") % 6 == 3, F.lit("data")).otherwise(F.col("p_name")).alias("name"),
    )


@query("source_name_class")
def source_name_class(spark, folder):
    return intake.source_name_class(_part_names(spark, folder)).groupBy("name", "non_data", "default_included", "label_hint").agg(F.count("*").alias("n"))


@query("source_name_match")
def source_name_match(spark, folder):
    part = table(spark, folder, "part", "p_partkey", "p_type")
    names = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.lower("p_type"))).otherwise(F.col("p_type")).alias("name"))
    return intake.source_name_match(names, ["ECONOMY", "Promo"])


@query("matrix_expand")
def matrix_expand(spark, folder):
    return intake.expand_matrix(raw.month_matrix(spark, folder)).select("page", "year", "label", "month", "y", "printed_total")


@query("printed_total_check")
def printed_total_check(spark, folder):
    return intake.printed_total_check(intake.expand_matrix(raw.month_matrix(spark, folder)))


@query("scope_tags")
def scope_tags(spark, folder):
    return intake.scope_tags(table(spark, folder, "documents", "doc_id", "text"), "text").select("doc_id", "tags")


@query("canonical_columns")
def canonical_columns(spark, folder):
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal").toDF(" Cust-Key", "Full Name ", "ACCT BAL")
    return intake.canonical_columns(customer, {"acct_bal": "balance"})


@query("required_columns")
def required_columns(spark, folder):
    """Which of three tables could be read as a monthly table, with the columns they lack and their size."""
    result = None
    for name, df in {
        "monthly": series.orders_monthly(spark, folder), "events": table(spark, folder, "events"), "orders": table(spark, folder, "orders"),
    }.items():
        lacking = ",".join(intake.missing_columns(df, CELL_REQUIRED))
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(lacking).alias("missing"), "n_rows")
        result = row if result is None else result.unionByName(row)
    return result


@query("strict_integer")
def strict_integer(spark, folder):
    return raw.raw_orders(spark, folder).select(
        "source_row", tx.strict_integer(F.col("year_text")).alias("year"), tx.strict_integer(F.col("count_text")).alias("y")
    )


@query("month_parse")
def month_parse(spark, folder):
    return raw.raw_orders(spark, folder).select("source_row", tx.month_number(F.col("month_text")).alias("month"))


@query("code_normalize")
def code_normalize(spark, folder):
    coded = raw.raw_orders(spark, folder).select("source_row", tx.block_code(F.col("code_text")).alias("code"))
    return coded.withColumn("error", tx.block_code_error(F.col("code"), CODES))


@query("label_clean")
def label_clean(spark, folder):
    label = tx.squeeze_spaces(F.col("label_text"))
    return raw.raw_orders(spark, folder).select("source_row", label.alias("label"), (label != "").alias("usable"))


@query("label_first_spelling")
def label_first_spelling(spark, folder):
    rows = raw.raw_orders(spark, folder).select("source_row", "label_text")
    return quality.label_first_spelling(rows, "label_text", "source_row").select("source_row", "canonical", "label_ok")


@query("label_conflicts")
def label_conflicts(spark, folder):
    return quality.label_conflicts(raw.raw_orders(spark, folder), "label_text")


@query("observation_status")
def observation_status(spark, folder):
    status, error = quality.observation_status(tx.strict_integer(F.col("count_text")), F.col("status_text"), REASONS)
    return raw.raw_orders(spark, folder).select("source_row", status.alias("status"), error.alias("error"))


@query("availability_rules")
def availability_rules(spark, folder):
    rows = typed(spark, folder).select("source_row", "year", "status")
    error = quality.availability_error(F.col("year"), F.col("status"), SCOPE.unavailable_years)
    return rows.withColumn("error", error).filter("error is not null")


@query("count_domain")
def count_domain(spark, folder):
    return raw.raw_orders(spark, folder).select("source_row", "count_text", quality.count_domain(F.col("count_text")).alias("error")).filter("error is not null")


@query("range_check")
def range_check(spark, folder):
    return quality.range_check(raw.raw_orders(spark, folder), {"year_text": (1900, 9999), "month_text": (1, 12)}, "source_row")


@query("range_summary")
def range_summary(spark, folder):
    bad = quality.range_check(raw.raw_orders(spark, folder), {"year_text": (1900, 9999), "month_text": (1, 12)}, "source_row")
    return quality.range_summary(bad, "source_row")


@query("date_convention_parse")
def date_convention_parse(spark, folder):
    rows = raw.raw_orders(spark, folder)
    return rows.select(
        "source_row", tx.date_text(intake.parse_date(F.col("date_text"), "day-first")).alias("day_first"),
        tx.date_text(intake.parse_date(F.col("date_text"), "month-first")).alias("month_first"),
    )


def _wide(spark, folder):
    return raw.wide_weeks(spark, folder, list(SCOPE.years))


@query("excluded_rows")
def excluded_rows(spark, folder):
    return intake.excluded_rows(_wide(spark, folder), [str(y) for y in SCOPE.years], "week").select("k", "week", "reason").filter("reason is not null")


@query("unpivot_years")
def unpivot_years(spark, folder):
    kept = intake.excluded_rows(_wide(spark, folder), [str(y) for y in SCOPE.years], "week").filter("reason is null").drop("reason")
    rows = intake.unpivot_years(kept.withColumn("source_row", tx.strict_integer(F.col("week"))), ["k", "source_row"])
    return rows.select("k", F.col("source_row").alias("week"), "year", "source_column", tx.strict_integer(F.col("value")).alias("y"))


@query("week53_rules")
def week53_rules(spark, folder):
    return intake.week53_rules(series.weekly_reports(spark, folder).select("k", "year", "week", "y"))


@query("range_filter")
def range_filter(spark, folder):
    cells = series.brand_monthly(spark, folder, months=(1996 * 12 + 3, 1999 * 12 + 5))
    return cells.filter(F.col("k").isin("Brand#1", "Brand#2")).select("k", "year", "month", "y")


@query("training_exclusion")
def training_exclusion(spark, folder):
    rows = series.weekly_reports(spark, folder).select("k", "year", "week", "reporting_status")
    return quality.training_exclusion(rows, None).select("k", "year", "week", "effective_status", "excluded")


@query("assumption_prepare")
def assumption_prepare(spark, folder):
    return intake.assumption_prepare(series.settle(series.weekly_reports(spark, folder)))


@query("display_format")
def display_format(spark, folder):
    """Totals with one decimal, shares with three and a floor text, and a text where nothing is known."""
    cells = series.settle(series.brand_monthly(spark, folder))
    yearly = cells.groupBy("k", "year").agg(F.sum("y").alias("total"), F.count("*").alias("n"))
    whole = cells.groupBy("year").agg(F.sum("y").alias("all"))
    share = F.round(F.col("total") / F.col("all") / 10, 9)
    mean = F.when(F.col("n") == 12, F.col("total") / 8)
    return yearly.join(whole, "year").select(
        "k", "year", F.format_string("%,.1f", F.col("total").cast("double")).alias("total_text"),
        F.when(share < 0.004, F.lit("<0.004")).otherwise(tx.number_text(share, 3)).alias("share_text"),
        tx.number_text(mean, 1).alias("mean_text"),
    )


@query("metadata_adoption")
def metadata_adoption(spark, folder):
    return quality.metadata_adoption(raw.raw_orders(spark, folder), ["population", "location", "reporting_status"], "source")


def _decisions(weekly):
    """Reviews of blank cells and week-53 conflicts; which action a cell gets follows from its keys."""
    conflict = (F.col("week") == 53) & (cal.year_length(F.col("year")) == 52) & F.col("y").isNotNull()
    cells = weekly.filter(F.col("y").isNull() | conflict).withColumn("target", F.when(F.col("y").isNull(), "blank").otherwise("conflict"))
    pick = F.col("source_row") % 7
    return cells.select(
        "k", "year", "week", "target",
        F.when(F.col("target") == "conflict", F.when(pick < 3, "include").when(pick < 6, "exclude").otherwise("guess"))
        .otherwise(F.when(pick == 0, "zero").when(pick == 1, "missing").when(pick == 2, "nonexistent").when(pick == 6, "guess").otherwise("corrected")).alias("action"),
        F.when(F.col("source_row") % 11 == 0, " ").otherwise("letter").alias("evidence"),
        F.when(pick == 3, "4").when(pick == 4, "2.5").otherwise(F.lit(None)).alias("corrected"),
    )


@query("decision_check")
def decision_check(spark, folder):
    return quality.decision_error(_decisions(series.weekly_reports(spark, folder)), cal.year_length(F.col("year")))


@query("apply_decisions")
def apply_decisions(spark, folder):
    weekly = series.settle(series.weekly_reports(spark, folder))
    checked = quality.decision_error(_decisions(weekly), cal.year_length(F.col("year")))
    return quality.apply_decisions(weekly.select("k", "year", "week", "y"), checked)


@query("completeness_claim")
def completeness_claim(spark, folder):
    """A source that claims complete reporting must name a reference; here the population text stands in for one."""
    rows = raw.raw_orders(spark, folder).groupBy("source").agg(
        F.bool_and(F.lower(F.coalesce("reporting_status", F.lit("unknown"))) == "complete").alias("claimed"),
        F.max(F.nullif(F.trim("location"), F.lit(""))).alias("reference"),
    )
    return rows.withColumn("accepted", ~F.col("claimed") | F.col("reference").isNotNull())


@query("period_source")
def period_source(spark, folder):
    """The same rows with their period from year and month, from year and week and from a date, and what fails."""
    rows = raw.raw_orders(spark, folder)
    variants = {
        "monthly": rows.select("source_row", F.col("year_text").alias("year"), F.col("month_text").alias("month")),
        "weekly": rows.select("source_row", F.col("year_text").alias("year"), (F.col("source_row") % 55).cast("string").alias("week")),
        "dated": rows.select("source_row", F.col("date_text").alias("report_date")),
    }
    result = None
    for name, df in variants.items():
        indexed, used = intake.period_index(df)
        row = indexed.groupBy("m").agg(F.count("*").alias("n")).select(F.lit(name).alias("variant"), F.lit(used).alias("used"), "m", "n")
        result = row if result is None else result.unionByName(row)
    return result


@query("default_metadata")
def default_metadata(spark, folder):
    rows = intake.typed_rows(raw.raw_orders(spark, folder), CODES, REASONS, keep=("population", "location"))
    return rows.filter(F.size("problems") == 0).select(
        "source_row", F.coalesce("population", F.lit("unknown")).alias("population"), F.coalesce("location", F.lit("unknown")).alias("location"),
        tx.date_text(cal.month_start(cal.month_index(F.col("year"), F.col("month")))).alias("date"),
    )


@query("typed_rows")
def typed_rows(spark, folder):
    return typed(spark, folder).withColumn("problems", F.array_join("problems", ","))


@query("conversion_report")
def conversion_report(spark, folder):
    return intake.conversion_report(typed(spark, folder))


@query("monthly_rollup")
def monthly_rollup(spark, folder):
    """Daily rows into months, the population kept apart."""
    daily = series.user_daily(spark, folder).select(
        "k", F.when(F.col("k") % 3 == 0, "young").otherwise("all").alias("population"), "y",
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("m").cast("int")).alias("d"),
    )
    return intake.monthly_rollup(daily.withColumn("m", cal.month_index(F.year("d"), F.month("d"))), "population")


@query("voiding_rollup")
def voiding_rollup(spark, folder):
    weekly = series.weekly_reports(spark, folder)
    day = F.coalesce("week_start_date", cal.week_start(F.col("year"), F.col("week")))
    return intake.voiding_rollup(weekly, F.format_string("%04dQ%d", F.year(day), F.quarter(day)))


@query("source_status")
def source_status(spark, folder):
    """State of every sheet from its mapping and from the problems of its rows."""
    mapped = intake.role_resolution(_headers(spark, folder)).groupBy("source").agg(F.bool_or(F.col("state") != "mapped").alias("unmapped"))
    report = intake.conversion_report(typed(spark, folder))
    errors = F.explode(F.array(*[F.struct(F.lit(p).alias("error"), F.col(f"bad_{p}").alias("n")) for p in ("year", "month", "code", "label", "count")]))
    checks = report.join(mapped, "source").select("source", "unmapped", (~intake.is_non_data(F.col("source"))).alias("included"), errors.alias("e")).select(
        "source", "included", "unmapped", "e.error", "e.n"
    )
    return quality.source_status(checks)


@query("series_sort")
def series_sort(spark, folder):
    """Stable order by series, year and week with the place of each row; the order is per series."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("k").orderBy("year", "week")).cast("bigint")
    return series.weekly_reports(spark, folder).select("k", "year", "week", place.alias("place")).orderBy("k", "year", "week")


@query("preview_page")
def preview_page(spark, folder):
    """Second page of 25 rows and nothing more, as a table preview shows it."""
    return typed(spark, folder).select("source_row", "year", "month", "y").orderBy("source_row").offset(25).limit(25)


@query("share_of_blank")
def share_of_blank(spark, folder):
    """How many counts of each sheet are blank, zero or positive, so that a blank never reads as a zero."""
    count = tx.strict_integer(F.col("count_text"))
    return raw.raw_orders(spark, folder).groupBy("source").agg(
        F.count(F.when(count.isNull(), 1)).alias("blank"), F.count(F.when(count == 0, 1)).alias("zero"),
        F.count(F.when(count > 0, 1)).alias("positive"), r6(F.avg(F.when(count >= 0, count))).alias("mean_count"),
    )
