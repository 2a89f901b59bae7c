"""Notification feeds: audience, read receipts and change tokens of one reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def audience(user_id: int, role: str) -> Column:
    """Addressed to everyone, to the reader's role or to the reader."""
    by_role = F.col("role_target").isNull() | (F.col("role_target") == role)
    by_user = F.col("user_target").isNull() | (F.col("user_target") == user_id)
    return by_role & by_user


def feed(notices: DataFrame, reads: DataFrame, user_id: int, role: str) -> DataFrame:
    mine = reads.filter(F.col("user_id") == user_id).select(F.col("notification_id").alias("id"), F.lit(True).alias("is_read"))
    return notices.filter(audience(user_id, role)).join(mine, "id", "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))


def unread(notices: DataFrame, reads: DataFrame, user_id: int, role: str) -> DataFrame:
    mine = reads.filter(F.col("user_id") == user_id).select(F.col("notification_id").alias("id"))
    return notices.filter(audience(user_id, role)).join(mine, "id", "left_anti")


def mark_read(notices: DataFrame, reads: DataFrame, user_id: int, role: str, selected: DataFrame) -> DataFrame:
    """New receipts for the selected visible notices that have none yet."""
    chosen = unread(notices, reads, user_id, role).join(selected.select("id"), "id", "left_semi")
    return chosen.select(F.col("id").alias("notification_id"), F.lit(user_id).cast("bigint").alias("user_id"))


def by_day(items: DataFrame) -> DataFrame:
    """Newest first with the day each item belongs to."""
    return items.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).orderBy(F.desc("id"))


def filtered(items: DataFrame, status: str = "all", kind: str = "all") -> DataFrame:
    if status != "all":
        items = items.filter(F.col("is_read") == (status == "read"))
    return items if kind == "all" else items.filter(F.col("type") == kind)


def change_token(states: DataFrame, audit: DataFrame, notices: DataFrame, reads: DataFrame, user_id: int, role: str) -> DataFrame:
    """One row that changes when anything a reader sees could have changed."""
    token = unread(notices, reads, user_id, role).agg(F.count("*").alias("unread"))
    return token.select(
        states.filter("state = 'active'").agg(F.max("id")).scalar().alias("active_id"),
        audit.agg(F.max("id")).scalar().alias("last_audit"),
        notices.agg(F.max("id")).scalar().alias("last_notice"), "unread",
    )
