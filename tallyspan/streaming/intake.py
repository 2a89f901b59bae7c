"""Structured Streaming intake.

Streams read a folder of parquet files and write to the shared folder. The file sink keeps a log of committed batches, so
a restarted query neither repeats nor loses rows. `drain` runs everything that is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyspan.operators.intake import typed_rows
from tallyspan.operators.ordering import positions_in_group
from tallyspan.session import new_folder


#: Files that one micro-batch takes; state and memory follow this and not the table.
FILES_PER_BATCH = 64


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet file, or the parquet files of a folder as they arrive."""
    # A plain path must be a folder for a stream; a pattern that only this path matches may be a file as well.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Process all input that is available, commit it, and return the written table."""
    spark = stream.sparkSession
    root = new_folder(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    running = writer.trigger(availableNow=True).start(f"{root}/data")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def checked_intake(raw_stream: DataFrame, codes: list[str], reasons: list[str]) -> DataFrame:
    """The batch checks on a stream: each row arrives typed, with its problems and whether it is accepted."""
    typed = typed_rows(raw_stream, codes, reasons)
    return typed.withColumn("accepted", F.size("problems") == 0).withColumn("problems", F.array_join("problems", ","))


def period_counts(events: DataFrame, time: str, keys: list[str], period: str, lateness: str) -> DataFrame:
    """Counts per tumbling period; rows later than the allowed lateness no longer change a closed period."""
    window = F.window(time, period)
    return events.withWatermark(time, lateness).groupBy(window, *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "n"
    )


def with_open_periods(closed: DataFrame, events: DataFrame, time: str, keys: list[str], period: str) -> DataFrame:
    """Closed periods from the stream, and the periods still open counted from the source rows after the last closed one.

    `closed_by_stream` says which is which, so a stream that yields nothing shows.
    """
    limit = closed.agg(F.max("period_end")).scalar()
    window = F.window(time, period)
    late = events.filter((F.col(time) >= limit) | limit.isNull())
    still_open = late.groupBy(window, *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "n"
    )
    return closed.withColumn("closed_by_stream", F.lit(True)).unionByName(still_open.withColumn("closed_by_stream", F.lit(False)))


def deduplicated(events: DataFrame, time: str, keys: list[str], lateness: str) -> DataFrame:
    """One row per key within the allowed lateness; the state of older keys is dropped."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def revision_log(arrivals: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Every value of a reported period is kept; later arrivals are numbered as revisions of it."""
    numbered = positions_in_group(arrivals, keys, [arrival], "revision")
    newest = numbered.groupBy(*keys).agg(F.max("revision").alias("n_revisions"))
    return numbered.join(newest, keys).withColumn("is_latest", F.col("revision") == F.col("n_revisions"))
