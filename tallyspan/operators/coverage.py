"""What is present, what is missing and whether a series is fit for use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions import calendar as cal
from tallyspan.operators.grid import dense_grid, span

OBSERVED = ("observed", "observed_zero")


def forecast_calendar(df: DataFrame, horizon: int) -> DataFrame:
    """The next periods of every key, counted from the end of the whole table and not of the key."""
    keys = df.select("k").distinct().withColumn("_s", span(df))
    return keys.select("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "_s").select(
        "k", F.col("h").cast("bigint").alias("h"), (F.col("_s.hi") + F.col("h")).alias("m")
    )


def advance_weeks(df: DataFrame, steps: int) -> DataFrame:
    """Labels of the weeks after each key's last week; only the offset is given where the calendar is unknown."""
    position = F.struct(F.col("year").alias("year"), F.col("week").alias("week"))
    last = df.groupBy("k").agg(F.max(position).alias("p"))
    known = df.agg(F.max("year")).scalar()
    ahead = last.withColumn("known", known).select(
        "k", "known", F.col("p.year").alias("y0"), F.col("p.week").alias("w0"),
        F.explode(F.expr(f"sequence(1L, {int(steps)}L)")).alias("h"),
    )
    year, week = cal.advance_week(F.col("y0"), F.col("w0"), F.col("h"), F.col("known"))
    return ahead.select("k", "h", year.alias("year"), week.alias("week")).withColumn(
        "label",
        F.when(F.col("year").isNotNull(), cal.week_label(F.col("year"), F.col("week"))).otherwise(
            F.concat(F.lit("+"), F.col("h").cast("string"))
        ),
    )


def coverage_gate(df: DataFrame, minimum: int, incomplete: Column | None = None) -> DataFrame:
    """One reason per key: duplicates, a hole in the span, known gaps in reporting, a short history, or ok."""
    bad = F.lit(False) if incomplete is None else incomplete
    return df.groupBy("k").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("m").alias("n_periods"),
        (F.max("m") - F.min("m") + 1).alias("span"),
        F.count(F.when(F.col("y") < 0, 1)).alias("n_negative"),
        F.count(F.when(bad, 1)).alias("n_incomplete"),
    ).select(
        "k", "n_rows", "n_periods", "span",
        F.when(F.col("n_incomplete") > 0, "incomplete_reporting")
        .when(F.col("n_negative") > 0, "invalid_count")
        .when(F.col("n_rows") > F.col("n_periods"), "duplicate_period")
        .when(F.col("n_periods") < F.col("span"), "missing_period")
        .when(F.col("n_periods") < minimum, "insufficient_history")
        .otherwise("ok").alias("reason"),
    )


def is_observed(status: str = "status", count: str = "y") -> Column:
    return F.col(status).isin(list(OBSERVED)) & F.col(count).isNotNull()


def observed_only(df: DataFrame) -> DataFrame:
    return df.filter(is_observed())


def presence_limit(df: DataFrame, limit: int) -> DataFrame:
    """Number of distinct keys reported per year, flagged where it exceeds the limit."""
    return (
        df.filter(F.col("y").isNotNull()).groupBy("year").agg(F.countDistinct("k").alias("n_keys"))
        .withColumn("over_limit", F.col("n_keys") > limit)
    )


def annual_completeness(df: DataFrame) -> DataFrame:
    """A key that appears in a year must have all twelve months."""
    return df.filter(is_observed()).groupBy("k", "year").agg(F.countDistinct("m").alias("n_months")).withColumn(
        "complete", F.col("n_months") == 12
    )


def readiness(df: DataFrame, available_years: tuple[int, ...]) -> DataFrame:
    """Reported years and months of every key, and the available ones it lacks, as sorted lists."""
    seen = F.when(is_observed(), F.col("m"))
    years = F.array(*[F.lit(y).cast("bigint") for y in available_years])
    months = F.array(*[F.lit(y * 12 + i).cast("bigint") for y in available_years for i in range(12)])
    return (
        df.groupBy("k").agg(F.collect_set(seen).alias("months"))
        .withColumn("years", F.array_distinct(F.transform("months", lambda m: cal.index_year(m))))
        .select(
            "k",
            F.size("years").cast("bigint").alias("year_count"),
            F.size("months").cast("bigint").alias("month_count"),
            F.array_sort(F.array_except(years, F.col("years"))).alias("missing_years"),
            F.array_sort(F.array_except(months, F.col("months"))).alias("missing_months"),
        )
    )


def threshold_policy(minimum: int):
    """Readiness rule as two expressions (eligible, reason); any function of this shape can take its place."""

    def decide(month_count: Column) -> tuple[Column, Column]:
        reason = F.concat(
            F.lit("reported months: "), month_count.cast("string"), F.lit(f"; minimum {minimum}")
        )
        return month_count >= minimum, reason

    return decide


def readiness_decision(ready: DataFrame, policy=None) -> DataFrame:
    """Apply a policy to the readiness rows; without one nothing is eligible and the configuration is asked for."""
    count = F.coalesce("month_count", F.lit(0))
    if policy is None:
        eligible, reason = F.lit(False), F.lit("a readiness policy is required")
        status = F.when(count == 0, "not_ready").otherwise("methodology_configuration_required")
    else:
        chosen, why = policy(count)
        eligible = F.coalesce((count > 0) & chosen, F.lit(False))
        reason = F.when(count == 0, "no reported observations").otherwise(why)
        status = F.when(eligible, "ready").otherwise("not_ready")
    return ready.select("k", count.alias("month_count"), eligible.alias("eligible"), status.alias("readiness_status"),
                        reason.alias("reason"))


def candidate_universe(ready: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate appears, also one without a single row."""
    return candidates.join(ready, "k", "left")


def annual_history(df: DataFrame, unavailable: tuple[int, ...]) -> DataFrame:
    """Yearly total where the year was reported, otherwise null and the reason."""
    return (
        df.groupBy("k", "year")
        .agg(F.bool_or("present").alias("present"), F.sum("y").alias("total"))
        .select(
            "k", "year", "present",
            F.when(F.col("present"), F.col("total")).alias("annual_total"),
            F.when(F.col("present"), "reported")
            .when(F.col("year").isin(list(unavailable)), "report_unavailable")
            .otherwise("outside_annual_top").alias("status"),
        )
    )


def missing_periods(df: DataFrame) -> DataFrame:
    """Periods inside each key's own span without any row; a zero is a row."""
    return dense_grid(df.select("k", "m", F.lit(1).alias("_x")), own_span=True).filter(F.col("_x").isNull()).select("k", "m")


def missing_weeks(df: DataFrame) -> DataFrame:
    """Reporting weeks between a key's first and last row that have no row at all."""
    position = F.struct(F.col("year").alias("year"), F.col("week").alias("week"))
    spans = df.groupBy("k").agg(F.min(position).alias("s"), F.max(position).alias("e"))
    years = spans.select("k", "s", "e", F.explode(F.sequence("s.year", "e.year")).alias("year"))
    low = F.when(F.col("year") == F.col("s.year"), F.col("s.week")).otherwise(F.lit(1)).cast("bigint")
    high = F.when(F.col("year") == F.col("e.year"), F.col("e.week")).otherwise(cal.year_length(F.col("year")))
    weeks = years.withColumn("_lo", low).withColumn("_hi", high.cast("bigint")).filter("_lo <= _hi").select(
        "k", "year", F.explode(F.sequence("_lo", "_hi")).alias("week")
    )
    return weeks.join(df.select("k", "year", "week"), ["k", "year", "week"], "left_anti")


def status_bands(df: DataFrame) -> DataFrame:
    """Years in which a key has any cell of a status, with the first and last day of the year."""
    return df.select("k", "year", "status").distinct().select(
        "k", "year", "status",
        F.format_string("%04d-01-01", "year").alias("band_start"),
        F.format_string("%04d-12-31", "year").alias("band_end"),
    )


def quality_report(weekly: DataFrame) -> DataFrame:
    """One row per check with its number of findings, in a single pass over the rows plus the calendar check."""
    length = cal.year_length(F.col("year"))
    complete = F.lower(F.coalesce("reporting_status", F.lit("unknown"))) == "complete"
    counted = weekly.groupBy("k", "year", "week").agg(
        F.count("*").alias("copies"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("blank"),
        F.count(F.when(F.col("y") == 0, 1)).alias("zero"),
        F.count(F.when(~complete, 1)).alias("untrained"),
    ).agg(
        F.sum("copies").alias("observations"),
        F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("duplicates"),
        F.sum("blank").alias("blank_observations"),
        F.sum("zero").alias("zero_weeks"),
        F.sum(F.when(F.col("week") == 53, F.col("copies")).otherwise(0)).alias("week53"),
        F.sum(F.when((F.col("week") == 53) & (length == 52), F.col("copies")).otherwise(0)).alias("week53_conflicts"),
        F.sum("untrained").alias("excluded_from_training"),
    )
    names = counted.columns
    rows = counted.unpivot([], names, "check", "findings")
    gaps = missing_weeks(weekly).agg(F.lit("missing_weeks").alias("check"), F.count("*").alias("findings"))
    return rows.unionByName(gaps)


def eligibility_reasons(weekly: DataFrame, minimum_weeks: int, approved: list[str]) -> DataFrame:
    """Per key, the list of rules that stand in the way of a formal evaluation."""
    complete = F.lower(F.coalesce("reporting_status", F.lit("unknown"))) == "complete"
    base = weekly.groupBy("k").agg(
        F.count(F.when(complete & F.col("y").isNotNull(), 1)).alias("n_complete"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("n_blank"),
        F.count(F.when(F.col("week") == 53, 1)).alias("n_week53"),
        F.count(F.when((F.col("week") == 53) & (cal.year_length(F.col("year")) == 52), 1)).alias("n_conflict"),
    )
    gaps = missing_weeks(weekly).groupBy("k").agg(F.count("*").alias("n_missing"))
    reasons = F.array_compact(F.array(
        F.when(~F.col("k").isin(approved), "scope_not_approved"),
        F.when(F.col("n_complete") < minimum_weeks, "insufficient_complete_history"),
        F.when((F.col("n_blank") > 0) | (F.col("n_missing") > 0), "gaps_need_approval"),
        F.when(F.col("n_week53") > 0, "week53_needs_approval"),
        F.when(F.col("n_conflict") > 0, "week53_conflict"),
    ))
    return base.join(gaps, "k", "left").select(
        "k", "n_complete", (F.size(reasons) == 0).alias("eligible"), F.concat_ws(";", reasons).alias("reasons")
    )


def workflow_route(reasons: DataFrame) -> DataFrame:
    """research when nothing stands in the way, provisional when the history suffices, refused otherwise."""
    found = F.split("reasons", ";")
    return reasons.select(
        "k", "reasons",
        F.when(F.col("eligible"), "research")
        .when(F.array_contains(found, "insufficient_complete_history") | F.array_contains(found, "week53_conflict"), "refused")
        .otherwise("provisional").alias("route"),
    )
