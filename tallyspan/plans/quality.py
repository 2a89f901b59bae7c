"""Queries on coverage, duplicates, readiness, summaries and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import MODEL, SCOPE
from tallyspan.functions import calendar as cal
from tallyspan.functions.numeric import r6
from tallyspan.operators import coverage, exports, intake, quality, summaries
from tallyspan.plans.registry import query
from tallyspan.plans.versions import study, study_of
from tallyspan.sources import raw, series
from tallyspan.sources.tables import table

APPROVED = [f"NATION_{i}" for i in range(0, 20)]


def _labels(months):
    return F.array_join(F.transform(months, lambda m: cal.month_label(m)), ",")


# ---- presence and readiness ---------------------------------------------------------------------------------------

@query("observed_only")
def observed_only(spark, folder):
    return coverage.observed_only(study(spark, folder)).select("k", "m", "y", "status")


@query("annual_presence_limit")
def annual_presence_limit(spark, folder):
    return coverage.presence_limit(series.brand_monthly(spark, folder), SCOPE.annual_limit)


@query("annual_completeness")
def annual_completeness(spark, folder):
    return coverage.annual_completeness(study(spark, folder))


@query("readiness")
def readiness(spark, folder):
    ready = coverage.readiness(study(spark, folder), SCOPE.available_years)
    return ready.select("k", "year_count", "month_count", F.array_join("missing_years", ",").alias("missing_years"), _labels("missing_months").alias("missing_months"))


def _decided(spark, folder):
    ready = coverage.readiness(study(spark, folder), SCOPE.available_years)
    return coverage.readiness_decision(ready, coverage.threshold_policy(MODEL.min_observations))


@query("readiness_decision")
def readiness_decision(spark, folder):
    return _decided(spark, folder)


@query("candidate_universe")
def candidate_universe(spark, folder):
    brands = table(spark, folder, "part", "p_brand").select(F.col("p_brand").alias("k")).distinct()
    absent = brands.agg(F.explode(F.array(*[F.lit(k) for k in SCOPE.absent_candidates])).alias("k"))
    ready = coverage.readiness(study(spark, folder), SCOPE.available_years)
    listed = coverage.candidate_universe(ready.select("k", "month_count"), brands.unionByName(absent))
    return coverage.readiness_decision(listed, coverage.threshold_policy(MODEL.min_observations))


@query("annual_history")
def annual_history(spark, folder):
    return coverage.annual_history(study(spark, folder), SCOPE.unavailable_years)


@query("status_bands")
def status_bands(spark, folder):
    return coverage.status_bands(study(spark, folder))


@query("latest_observation")
def latest_observation(spark, folder):
    """Latest observed day of every user, zero included and missing days passed over."""
    seen = series.user_daily(spark, folder).filter("observed")
    return summaries.latest(seen, "m", "y")


@query("latest_complete_week")
def latest_complete_week(spark, folder):
    weekly = series.weekly_reports(spark, folder).filter((F.lower("reporting_status") == "complete") & F.col("y").isNotNull())
    return weekly.groupBy("k").agg(F.max_by(F.struct("year", "week", "y"), F.struct("year", "week")).alias("r")).select("k", "r.year", "r.week", "r.y")


@query("series_summary")
def series_summary(spark, folder):
    cells = study(spark, folder)
    ready = coverage.readiness(cells, SCOPE.available_years)
    decided = coverage.readiness_decision(ready, coverage.threshold_policy(MODEL.min_observations))
    latest = summaries.latest(coverage.observed_only(cells), "m", "y")
    return ready.select("k", "year_count").join(decided, "k").join(latest, "k", "left").select(
        "k", "year_count", "month_count", "eligible", cal.month_label(F.col("m")).alias("latest_month"), F.col("y").alias("latest_count")
    )


@query("coverage_gate")
def coverage_gate(spark, folder):
    return coverage.coverage_gate(series.orders_monthly(spark, folder, "o_orderstatus"), minimum=80)


@query("missing_periods")
def missing_periods(spark, folder):
    return coverage.missing_periods(series.user_daily(spark, folder).filter("observed").select("k", "m", "y"))


@query("missing_weeks")
def missing_weeks(spark, folder):
    return coverage.missing_weeks(series.settle(series.weekly_reports(spark, folder)))


@query("quality_report")
def quality_report(spark, folder):
    return coverage.quality_report(series.settle(series.weekly_reports(spark, folder)))


@query("eligibility_reasons")
def eligibility_reasons(spark, folder):
    return coverage.eligibility_reasons(series.settle(series.weekly_reports(spark, folder)), 156, APPROVED)


@query("workflow_route")
def workflow_route(spark, folder):
    return coverage.workflow_route(coverage.eligibility_reasons(series.settle(series.weekly_reports(spark, folder)), 156, APPROVED))


# ---- duplicates and conflicts -------------------------------------------------------------------------------------

@query("duplicate_keys")
def duplicate_keys(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query("duplicate_sources")
def duplicate_sources(spark, folder):
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    return quality.duplicate_sources(lines, ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("description_conflicts")
def description_conflicts(spark, folder):
    return quality.description_conflicts(raw.raw_orders(spark, folder), "code_text", "label_text")


@query("single_context_guard")
def single_context_guard(spark, folder):
    return quality.single_context(raw.raw_orders(spark, folder), ["population", "location"], "source")


@query("provenance_label")
def provenance_label(spark, folder):
    return quality.provenance_label(raw.raw_orders(spark, folder), ["population", "location"], "source")


@query("series_catalog")
def series_catalog(spark, folder):
    """What each sheet holds: rows, years, and the populations and places it names."""
    from tallyspan.functions.text import strict_integer

    return raw.raw_orders(spark, folder).withColumn("year", strict_integer(F.col("year_text"))).groupBy("source").agg(
        F.count("*").alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.array_join(F.sort_array(F.collect_set("population")), ",").alias("populations"),
        F.array_join(F.sort_array(F.collect_set("location")), ",").alias("locations"),
    )


@query("source_mix")
def source_mix(spark, folder):
    events = table(spark, folder, "events", "user_id", "event_type")
    kinds = events.select(F.col("user_id").alias("k"), F.when(F.col("user_id") % 7 == 0, "synthetic").otherwise("real").alias("source_kind"))
    return quality.source_mix(kinds)


@query("blank_groups")
def blank_groups(spark, folder):
    blanks = series.weekly_reports(spark, folder).filter("y is null")
    return quality.blank_groups(blanks, cal.year_length(F.col("year")))


@query("findings_capped")
def findings_capped(spark, folder):
    weekly = series.settle(series.weekly_reports(spark, folder))
    columns = ["k", "year", "week"]
    found = weekly.select(*columns, F.explode(F.array_compact(F.array(
        F.when(F.col("y").isNull(), "blank_observations"), F.when(F.col("y") == 0, "zero_weeks"), F.when(F.col("week") == 53, "week53"),
    ))).alias("check"))
    gaps = coverage.missing_weeks(weekly).withColumn("check", F.lit("missing_weeks"))
    return quality.findings_capped(found.unionByName(gaps), 50)


@query("cell_compare")
def cell_compare(spark, folder):
    """The monthly table against a second extract with every March one higher and every August absent."""
    cells = series.settle(series.orders_monthly(spark, folder))
    second = cells.filter("month <> 8").select("k", "m", F.when(F.col("month") == 3, F.col("y") + 1).otherwise(F.col("y")).alias("y"))
    return quality.cell_compare(cells, second)


@query("annual_reconciliation")
def annual_reconciliation(spark, folder):
    reported = series.reported_brands(spark, folder)
    cells = study_of(reported)
    brands = reported.groupBy("k", "year").agg(F.sum("y").alias("t"))
    wrong = F.when((F.col("year") + F.length("k")) % 5 == 0, 1).otherwise(0)
    return quality.annual_reconciliation(cells, brands.select("k", "year", (F.col("t") + wrong).alias("printed_total")))


# ---- summaries ----------------------------------------------------------------------------------------------------

@query("summary_cards")
def summary_cards(spark, folder):
    cards = summaries.summary_cards(series.settle(series.brand_monthly(spark, folder)))
    return cards.withColumn("share", r6(F.col("share")))


@query("seasonal_pivot")
def seasonal_pivot(spark, folder):
    return summaries.seasonal_pivot(series.orders_monthly(spark, folder), list(SCOPE.years))


@query("scope_subset")
def scope_subset(spark, folder):
    """Whether the labels that each sheet uses lie inside the approved list."""
    label = F.nullif(F.upper(F.trim("label_text")), F.lit(""))
    inside = exports.scope_subset(label, ["URGENT", "HIGH", "MEDIUM", "LOW"])
    return raw.raw_orders(spark, folder).groupBy("source").agg(inside.alias("inside"))


@query("warning_refresh")
def warning_refresh(spark, folder):
    """Stored warnings of each sheet with last time's derived ones replaced by the current ones."""
    from tallyspan.plans.intake import typed

    report = intake.conversion_report(typed(spark, folder))
    note = lambda field, text: F.when(F.col(field) > 0, F.lit(text))
    current = F.array_compact(F.array(note("bad_year", "year"), note("bad_month", "month"), note("bad_count", "count")))
    derived = F.array(F.lit("year"), F.lit("month"), F.lit("count"))
    stored = F.when(F.col("n_rows") % 2 == 0, F.array(F.lit("kept"), F.lit("year"), F.lit("kept"))).otherwise(F.array(F.lit("month"), F.lit("note")))
    return report.select("source", F.array_join(exports.warning_refresh(stored, derived, current), ",").alias("warnings"))
