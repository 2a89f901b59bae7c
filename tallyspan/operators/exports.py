"""Tables and documents for export. Unknown stays blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions.numeric import is_finite


def history_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed and projected rows in one table, each row saying which it is."""
    past = history.withColumn("kind", F.when(F.col("y").isNull(), "unknown").otherwise("observed"))
    return past.unionByName(forecast.withColumn("kind", F.lit("forecast")), allowMissingColumns=True)


def with_context(rows: DataFrame, context: dict[str, str]) -> DataFrame:
    """Constant provenance columns on every row, as literals: no join is needed."""
    return rows.select("*", *[F.lit(v).alias(n) for n, v in context.items()])


def report_document(history: DataFrame, annual: DataFrame, forecast: DataFrame) -> DataFrame:
    """One JSON document per key. Its lists hold a key's periods, whose number the calendar bounds."""
    months = history.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("m", "y"))).alias("history"))
    years = annual.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("year", "annual_total", "status"))).alias("annual"))
    ahead = forecast.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("forecast"))
    body = F.to_json(F.struct("k", "history", "annual", "forecast"), {"ignoreNullFields": "false"})
    return months.join(years, "k", "left").join(ahead, "k", "left").select("k", body.alias("document"))


def emit_json(value: Column) -> Column:
    """A struct of a number field `value` and others as JSON; null, that is refused, where the number is not finite."""
    return F.when(is_finite(value["value"]), F.to_json(value))


def parse_json(text: Column, schema: str) -> Column:
    """The struct that a JSON text holds; null where it is no such text or its number is not finite."""
    parsed = F.from_json(text, schema)
    return F.when(is_finite(parsed["value"]), parsed)


def snapshot_reconcile(snapshot: DataFrame, observed: DataFrame, complete: Column) -> DataFrame:
    """A stored forecast against later observations, one row per model, scored only where reporting is complete."""
    joined = snapshot.join(observed.withColumn("complete", complete), ["k", "m"])
    error = F.when(F.col("complete") & F.col("y").isNotNull(), F.abs(F.col("y") - F.col("predicted")))
    return joined.select("k", "m", "model", "predicted", F.col("y").alias("observed"), "complete", error.alias("absolute_error"))


def context_guard(rows: DataFrame, expected: dict[str, str], row_id: str) -> DataFrame:
    """Rows whose own context contradicts the snapshot's; an empty cell contradicts nothing."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.nullif(F.trim(f), F.lit("")).alias("supplied"), F.lit(v).alias("expected"))
        for f, v in expected.items()
    ]))
    return rows.select(row_id, cells.alias("c")).select(row_id, "c.*").filter(
        F.col("supplied").isNotNull() & ~F.col("supplied").eqNullSafe(F.col("expected"))
    )


def warning_refresh(stored: Column, derived: Column, current: Column) -> Column:
    """Stored warnings without the derived ones of last time, then the current derived ones, each once and in order."""
    return F.array_distinct(F.concat(F.array_except(stored, derived), current))


def scope_subset(label: Column, approved: list[str]) -> Column:
    """Aggregate: every label of the group is approved. Labels are tested one by one and never gathered."""
    return F.coalesce(F.bool_and(label.isin(approved)), F.lit(True))
