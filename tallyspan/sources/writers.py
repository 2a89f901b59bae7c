"""Sinks. Exports and snapshots are whole tables; events are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null and empty cells are both left blank."""
    df.write.mode("errorifexists").csv(path, header=True, emptyValue="", nullValue="")


def write_snapshot(df: DataFrame, root: str, signature: str) -> str:
    """A folder named by its content. Writing the same content again fails, so a snapshot is never replaced."""
    if len(signature) != 64 or set(signature) - set("0123456789abcdef"):
        raise ValueError("a snapshot is named by a content signature")
    path = f"{root.rstrip('/')}/snapshot={signature}"
    df.write.mode("errorifexists").parquet(path)
    return path


def append_rows(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
