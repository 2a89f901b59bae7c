"""Checks on raw and typed rows. Findings come back as rows; nothing is repaired or dropped on the way.

Groups are counted with ordinary aggregates first, which combine on the map side, and rows are then matched to the few
keys that fail. A key that holds a large share of all rows is therefore never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.text import fold_key, number_or_null, squeeze_spaces, strict_integer
from tallyspan.session import settle


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every copy of a key that occurs more than once, with the number of copies."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return df.join(repeated, keys)


def duplicate_sources(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Keys supplied by more than one source, one row per key and source, with each source's number of rows."""
    counted = df.groupBy(*keys, source).agg(F.count("*").alias("n_rows"))
    shared = counted.groupBy(*keys).agg(F.count("*").alias("n_sources")).filter(F.col("n_sources") > 1)
    return counted.join(shared, keys)


def description_conflicts(df: DataFrame, code: str, description: str) -> DataFrame:
    """Codes with more than one description once case and spaces are ignored."""
    variants = df.groupBy(code).agg(F.countDistinct(fold_key(F.col(description))).alias("n_descriptions"))
    return variants.withColumn("conflict", F.col("n_descriptions") > 1)


def label_first_spelling(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Every row with the spelling its label had first, and whether the label is usable at all."""
    cleaned = df.withColumn("_label", squeeze_spaces(F.col(label))).withColumn("_key", F.lower("_label"))
    # Settled, so that its size is known and a small table of labels is broadcast instead of shuffling all rows on few labels.
    first = settle(cleaned.groupBy("_key").agg(F.min_by("_label", row_id).alias("canonical")), "labels")
    usable = F.col("_label").isNotNull() & F.length("_label").between(1, 200)
    return cleaned.join(first, "_key", "left").withColumn("label_ok", F.coalesce(usable, F.lit(False))).drop("_label", "_key")


def label_conflicts(df: DataFrame, label: str) -> DataFrame:
    """Labels that differ only by case or padding from another one, or carry padding themselves."""
    spelled = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    keyed = spelled.withColumn("label_key", F.lower(F.trim("label")))
    return keyed.groupBy("label_key").agg(
        F.count("*").alias("n_spellings"), F.sum("n_rows").alias("n_rows"),
        F.bool_or(F.col("label") != F.trim("label")).alias("padded"),
    ).withColumn("inconsistent", (F.col("n_spellings") > 1) | F.col("padded"))


def observation_status(count: Column, status: Column, reasons: list[str]) -> tuple[Column, Column]:
    """(status, error): an absent count needs a reason, zero and positive counts set the status themselves."""
    inferred = F.when(count == 0, "observed_zero").when(count > 0, "observed")
    has_reason = F.coalesce(status.isin(reasons), F.lit(False))
    error = (
        F.when(count.isNull() & ~has_reason, "missing_without_reason")
        .when(count < 0, "negative_count")
        .when(count.isNotNull() & (status != inferred), "status_conflict")
    )
    return F.when(count.isNull() & has_reason, status).otherwise(inferred), error


def availability_error(year: Column, status: Column, unavailable: tuple[int, ...]) -> Column:
    """Counts in a year without a report, and the reverse."""
    absent = year.isin(list(unavailable))
    blocked = status == "report_unavailable"
    return F.when(absent & ~F.coalesce(blocked, F.lit(False)), "count_in_unavailable_year").when(
        ~absent & blocked, "unavailable_in_reported_year"
    )


def count_domain(text: Column) -> Column:
    """Error code of a raw count; blank is no error and is not zero."""
    blank = text.isNull() | (F.trim(text) == "")
    value = number_or_null(text)
    return F.when(~blank, F.when(value.isNull(), "not_a_number").when(value < 0, "negative").when(value % 1 != 0, "not_whole"))


def range_check(df: DataFrame, bounds: dict[str, tuple[int, int]], row_id: str) -> DataFrame:
    """One row per bad cell: its column, its source row and the value as supplied."""
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("field"), F.col(name).alias("value"),
            F.coalesce(strict_integer(F.col(name)).between(low, high), F.lit(False)).alias("ok"),
        ) for name, (low, high) in bounds.items()
    ]))
    return df.select(row_id, cells.alias("c")).filter(~F.col("c.ok")).select("c.field", row_id, "c.value")


def range_summary(bad: DataFrame, row_id: str) -> DataFrame:
    """Bad cells per column and value: how many, and the first and last source row."""
    return bad.groupBy("field", "value").agg(
        F.count("*").alias("n"), F.min(row_id).alias("first_row"), F.max(row_id).alias("last_row")
    )


def metadata_adoption(df: DataFrame, fields: list[str], source: str) -> DataFrame:
    """A column becomes metadata of its source only when every row supplies the same text."""
    supplied = {name: F.when(F.trim(name) != "", F.col(name)) for name in fields}
    sums = df.groupBy(source).agg(
        F.count("*").alias("_n"),
        *[F.count(c).alias(f"{n}_n") for n, c in supplied.items()],
        *[F.min(c).alias(f"{n}_lo") for n, c in supplied.items()],
        *[F.max(c).alias(f"{n}_hi") for n, c in supplied.items()],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"))
        for n in fields
    ]))
    agreed = (F.col("c.n") == F.col("_n")) & (F.col("c.lo") == F.col("c.hi"))
    return sums.select(source, "_n", cells.alias("c")).select(
        source, "c.field", F.when(agreed, F.col("c.lo")).alias("value"),
        F.when(agreed, "adopted").when(F.col("c.n") > 0, "incomplete").otherwise("absent").alias("state"),
    )


def single_context(df: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """Whether all rows of a key share one population, classification and so on; unknown counts as a value."""
    folded = [F.countDistinct(F.coalesce(F.nullif(F.lower(F.trim(f)), F.lit("")), F.lit("unknown"))).alias(f"n_{f}") for f in fields]
    checks = [F.col(f"n_{f}") > 1 for f in fields]
    mixed = F.concat_ws(",", *[F.when(c, F.lit(f)) for f, c in zip(fields, checks)])
    return df.groupBy(*keys).agg(*folded).withColumn("mixed", mixed).withColumn("single_context", F.col("mixed") == "")


def provenance_label(df: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """Readable list of the distinct values of each field; the values are few by nature."""
    parts = []
    for field in fields:
        values = F.array_join(F.sort_array(F.collect_set(field)), ", ")
        parts.append(F.concat(F.lit(f"{field}: "), F.coalesce(F.nullif(values, F.lit("")), F.lit("unknown"))))
    return df.groupBy(*keys).agg(F.concat_ws("; ", *parts).alias("label"))


def training_exclusion(df: DataFrame, dataset_status: str | None) -> DataFrame:
    """A row trains a model only when its reporting is complete; the row's own value wins over the data set's."""
    status = F.coalesce(F.nullif(F.trim("reporting_status"), F.lit("")), F.lit(dataset_status).cast("string"), F.lit("unknown"))
    return df.withColumn("effective_status", status).withColumn("excluded", F.lower("effective_status") != "complete")


def findings_capped(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings of each check for display, with the true total beside them.

    The totals are counted apart and the list is cut by a group limit, so a check with very many findings stays cheap.
    """
    totals = findings.groupBy("check").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("check").orderBy("k", "year", "week"))
    shown = findings.withColumn("place", place.cast("bigint")).filter(F.col("place") <= limit)
    return shown.join(totals, "check")


def blank_groups(blanks: DataFrame, length: Column) -> DataFrame:
    """Blank cells by key, week and calendar class, with the number of cells and the years they span."""
    kind = F.when(F.col("week") != 53, "plain").when(length == 53, "week53_exists").otherwise("week53_absent")
    return blanks.withColumn("kind", kind).groupBy("k", "week", "kind").agg(
        F.count("*").alias("n_cells"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def source_status(checks: DataFrame) -> DataFrame:
    """Overall state of every source from its check rows (source, included, unmapped, error, n)."""
    return checks.groupBy("source").agg(
        F.bool_and("included").alias("included"), F.bool_or("unmapped").alias("unmapped"),
        F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("error")))).alias("errors"),
    ).select(
        "source",
        F.when(~F.col("included"), "excluded").when(F.col("unmapped"), "needs_mapping")
        .when(F.size("errors") > 0, "invalid").otherwise("ready").alias("status"),
        F.concat_ws(";", "errors").alias("errors"),
    )


def decision_error(decisions: DataFrame, length: Column) -> DataFrame:
    """Error code of a review decision: unknown action, no evidence, bad corrected value, wrong calendar."""
    blank_actions = ["zero", "missing", "nonexistent", "corrected"]
    conflict_actions = ["include", "exclude"]
    value = number_or_null(F.col("corrected"))
    bad_value = value.isNull() | (value < 0) | (value % 1 != 0)
    code = (
        F.when((F.col("target") == "blank") & ~F.col("action").isin(blank_actions), "unknown_action")
        .when((F.col("target") == "conflict") & ~F.col("action").isin(conflict_actions), "unknown_action")
        .when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "evidence_required")
        .when((F.col("action") == "corrected") & F.coalesce(bad_value, F.lit(True)), "bad_corrected_value")
        .when((F.col("action") == "nonexistent") & (length != 52), "week_exists")
    )
    return decisions.withColumn("error", F.coalesce(code, F.lit("ok")))


def apply_decisions(cells: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cells with their reviewed decisions applied: corrected, zero, kept as missing, or excluded from use."""
    joined = cells.join(decisions.filter("error = 'ok'").select("k", "year", "week", "action", "corrected"), ["k", "year", "week"], "left")
    return joined.withColumn("excluded", F.coalesce(F.col("action").isin("nonexistent", "exclude"), F.lit(False))).withColumn(
        "resolved",
        F.when(F.col("action") == "zero", F.lit(0).cast("bigint"))
        .when(F.col("action") == "corrected", strict_integer(F.col("corrected")))
        .when(F.col("excluded"), F.lit(None).cast("bigint"))
        .otherwise(F.col("y")),
    ).drop("corrected")


def cell_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two extracts cell by cell; null equals null, and a cell that only one side has does not match."""
    left = a.select("k", "m", F.col("y").alias("y_a"), F.lit(True).alias("_a"))
    right = b.select("k", "m", F.col("y").alias("y_b"), F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return left.join(right, ["k", "m"], "full_outer").select("k", "m", "y_a", "y_b", (both & F.col("y_a").eqNullSafe(F.col("y_b"))).alias("match"))


def annual_reconciliation(cells: DataFrame, printed: DataFrame) -> DataFrame:
    """Printed yearly totals against summed cells, with blank and explicit zero cells counted."""
    summed = cells.groupBy("k", "year").agg(
        F.sum("y").alias("summed_total"), F.count("*").alias("n_cells"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("blank_cells"), F.count(F.when(F.col("y") == 0, 1)).alias("zero_cells"),
    )
    return summed.join(printed.select("k", "year", "printed_total"), ["k", "year"], "full_outer").withColumn(
        "status",
        F.when(F.col("printed_total").isNull(), "no_printed_total").when(F.col("summed_total").isNull(), "no_cells")
        .when(F.col("printed_total") == F.col("summed_total"), "match").otherwise("difference"),
    )


def source_mix(df: DataFrame, kind: str = "source_kind") -> DataFrame:
    """One row: are the series real, synthetic or a mix, and how many of each."""
    return df.groupBy("k").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).agg(
        F.count(F.when((F.col("lo") == "real") | (F.col("hi") == "real"), 1)).alias("n_real"),
        F.count(F.when((F.col("lo") == "synthetic") | (F.col("hi") == "synthetic"), 1)).alias("n_synthetic"),
    ).withColumn(
        "label",
        F.when((F.col("n_real") > 0) & (F.col("n_synthetic") > 0), "mixed").when(F.col("n_real") > 0, "real").otherwise("synthetic"),
    )
