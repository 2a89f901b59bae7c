"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.plans.intake import CODES, REASONS
from tallyspan.plans.registry import query
from tallyspan.sources import raw
from tallyspan.sources.tables import table
from tallyspan.streaming import intake


def _stream(spark, folder, name, *columns):
    path = f"{folder}/{name}.parquet"
    return intake.read_stream(spark, path, table(spark, folder, name).schema).select(*columns)


def _events(spark, folder, *columns):
    """Event rows with a zoned time stamp, as windows and watermarks need it."""
    return _stream(spark, folder, "events", "ts", *columns).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest")
def stream_ingest(spark, folder):
    """Orders arriving as raw text: checked on the way, good and bad rows written apart."""
    rows = raw.raw_rows(_stream(spark, folder, "orders", *raw.ORDER_COLUMNS))
    stored = intake.drain(intake.checked_intake(rows, CODES, REASONS), "ingest", "accepted")
    return stored.groupBy("accepted", "problems").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


@query("stream_rollup")
def stream_rollup(spark, folder):
    closed = intake.drain(intake.period_counts(_events(spark, folder, "event_type"), "ts", ["event_type"], "1 day", "1 day"), "rollup")
    batch = table(spark, folder, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = intake.with_open_periods(closed, batch, "ts", ["event_type"], "1 day")
    return whole.select("event_type", F.date_format("period_start", "yyyy-MM-dd").alias("day"), "n", "closed_by_stream")


@query("stream_dedupe")
def stream_dedupe(spark, folder):
    """Every event delivered twice; each is stored once."""
    once = _events(spark, folder, "event_id", "user_id", "event_type")
    again = _events(spark, folder, "event_id", "user_id", "event_type")
    stored = intake.drain(intake.deduplicated(once.unionByName(again), "ts", ["event_id"], "2 days"), "dedupe")
    return stored.select("event_id", "user_id", "event_type")


@query("revision_log")
def revision_log(spark, folder):
    """Each event is a new value for its user, day and type."""
    arrivals = _events(spark, folder, "event_id", "user_id", "event_type", "value").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "event_id", "value"
    )
    stored = intake.drain(arrivals, "revisions")
    return intake.revision_log(stored, ["user_id", "day", "event_type"], "event_id")
