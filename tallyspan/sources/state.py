"""Event tables for versions, runs and feeds, derived from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.config import MODEL
from tallyspan.sources.tables import table


def version_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a dataset of its customer: uploaded on its date, then activated, cancelled or left pending.

    Every tenth dataset also gets a second decision, which comes too late to be legal.
    """
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    day = F.to_date("o_orderdate")
    base = orders.select(
        F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("signature"),
        "o_orderstatus", day.alias("day"),
    )
    decided = F.col("o_orderstatus") != "P"
    choice = F.when(F.col("o_orderstatus") == "F", "activate").when(F.col("id") % 2 == 0, "reject").otherwise("cancel")

    def event(action, days: int):
        return F.struct(
            action.alias("action"), F.date_format(F.date_add("day", days), "yyyy-MM-dd").alias("at"), F.lit(days).cast("bigint").alias("seq")
        )

    events = F.array_compact(F.array(
        event(F.lit("upload"), 0), F.when(decided, event(choice, 1)), F.when(decided & (F.col("id") % 10 == 0), event(F.lit("cancel"), 2))
    ))
    return base.select("scope", "id", "signature", F.explode(events).alias("e")).select("scope", "id", "signature", "e.action", "e.at", "e.seq")


def forecast_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a run of its user's data set for its event type."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value")
    return events.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("signature"), F.col("event_type").alias("block"),
        F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "running").otherwise("completed").alias("status"),
        F.when(F.col("event_id") % 7 == 0, "older model").otherwise(MODEL.name).alias("model_name"), F.lit(MODEL.version).alias("model_version"),
        F.when(F.col("event_id") % 3 == 0, "c-old").otherwise(MODEL.signature).alias("configuration"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "value",
    )


def notices(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"),
        F.when(F.col("user_id") % 3 == 1, "admin").when(F.col("user_id") % 3 == 2, "viewer").alias("role_target"),
        F.when(F.col("user_id") % 5 == 0, F.col("user_id") % 20).alias("user_target"),
    )


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Views and sign-ups count as read by one of two readers."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type")
    return events.filter(F.col("event_type").isin("view", "signup")).select(F.col("event_id").alias("notification_id"), (F.col("user_id") % 2 * 10).alias("user_id"))
