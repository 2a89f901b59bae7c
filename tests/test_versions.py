from pyspark.sql import functions as F

from tallyspan.config import MODEL
from tallyspan.operators import exports, feeds, versions
from tallyspan.streaming import intake as streams

EVENT = "scope string, id long, signature string, action string, at string, seq long"


def test_one_active_dataset_per_scope(spark, rows):
    events = spark.createDataFrame([
        ("s", 1, "x", "upload", "01", 0), ("s", 1, "x", "activate", "02", 1), ("s", 2, "y", "upload", "02", 0), ("s", 2, "y", "activate", "03", 1),
        ("s", 3, "z", "upload", "04", 0), ("s", 4, "w", "upload", "04", 0), ("s", 4, "w", "cancel", "05", 1), ("s", 4, "w", "activate", "06", 2),
        ("t", 5, "v", "upload", "01", 0), ("t", 5, "v", "activate", "02", 1),
    ], EVENT)
    found = versions.dataset_state(events)
    assert rows(found, "id", "state", "n_illegal") == [(1, "retired", 0), (2, "active", 0), (3, "pending", 0), (4, "cancelled", 1), (5, "active", 0)]
    assert rows(versions.pending_list(found), "id") == [(3,)]


def test_results_of_another_configuration_are_invisible(spark, rows):
    data = [(1, "s", MODEL.signature, "completed"), (2, "s", "other", "completed"), (3, "t", MODEL.signature, "completed"), (4, "s", MODEL.signature, "failed")]
    runs = spark.createDataFrame(data, "run_id long, signature string, configuration string, status string").withColumn(
        "model_name", F.lit(MODEL.name)).withColumn("model_version", F.lit(MODEL.version))
    active = spark.createDataFrame([("s",)], "signature string")
    assert rows(versions.visible_results(runs, active), "run_id") == [(1,)]


def test_upsert_keeps_only_the_newest_values(spark, rows):
    runs = spark.createDataFrame([(1, "running", 1), (1, "completed", 2), (2, "completed", 1), (2, "failed", 2)], "run_id long, status string, version long")
    values = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "run_id long, version long, value double")
    latest, kept = versions.upsert_runs(runs, values)
    assert rows(latest, "run_id", "status") == [(1, "completed"), (2, "failed")]
    assert rows(kept, "run_id", "value") == [(1, 6.0)]


def test_error_rows_must_be_later_and_unique(spark, rows):
    data = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("b", 2, 2), ("c", 1, 2), ("c", 1, 2)], "k string, cutoff long, m long")
    assert rows(versions.error_row_check(data), "k", "valid") == [("a", True), ("b", False), ("c", False)]


def test_feed_audience_and_receipts(spark, rows):
    notices = spark.createDataFrame([(1, "x", None, None), (2, "x", "admin", None), (3, "x", "viewer", None), (4, "y", None, 7), (5, "y", None, 8)],
                                    "id long, type string, role_target string, user_target long")
    reads = spark.createDataFrame([(1, 7), (2, 8)], "notification_id long, user_id long")
    assert rows(feeds.feed(notices, reads, 7, "admin"), "id", "is_read") == [(1, True), (2, False), (4, False)]
    assert rows(feeds.unread(notices, reads, 7, "admin"), "id") == [(2,), (4,)]
    assert rows(feeds.mark_read(notices, reads, 7, "admin", notices.filter("type = 'y'"))) == [(4, 7)]
    assert rows(feeds.filtered(feeds.feed(notices, reads, 7, "admin"), "read"), "id") == [(1,)]


def test_warnings_are_refreshed_in_order(spark):
    df = spark.createDataFrame([(["kept", "old", "kept"], ["old"], ["new"])], "s array<string>, d array<string>, c array<string>")
    assert df.select(exports.warning_refresh(F.col("s"), F.col("d"), F.col("c"))).first()[0] == ["kept", "new"]


def test_context_guard_ignores_empty_cells(spark, rows):
    df = spark.createDataFrame([(1, "5-19", None), (2, "all", " "), (3, None, "x")], "row long, population string, location string")
    found = exports.context_guard(df, {"population": "5-19", "location": "South"}, "row")
    assert rows(found, "row", "field") == [(2, "population"), (3, "location")]


def test_incomplete_observations_are_not_scored(spark, rows):
    snapshot = spark.createDataFrame([("a", 1, "base", 2.0), ("a", 2, "base", 2.0), ("a", 9, "base", 2.0)], "k string, m long, model string, predicted double")
    observed = spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "k string, m long, y long")
    assert rows(exports.snapshot_reconcile(snapshot, observed, F.col("m") == 1), "m", "absolute_error") == [(1, 3.0), (2, None)]


def test_stream_equals_batch_with_open_periods(spark, rows, tmp_path):
    from tallyspan.session import new_folder

    folder = new_folder(spark, "t-stream")
    data = spark.range(200).selectExpr("id", "timestamp_seconds(1700000000 + id * 3000) AS ts", "if(id % 4 = 0, 'a', 'b') AS kind")
    data.coalesce(1).write.parquet(folder)
    stream = streams.read_stream(spark, folder, data.schema)
    closed = streams.drain(streams.period_counts(stream, "ts", ["kind"], "1 day", "1 day"), "t-rollup")
    whole = streams.with_open_periods(closed, spark.read.parquet(folder), "ts", ["kind"], "1 day")
    batch = data.groupBy(F.window("ts", "1 day").start.alias("d"), "kind").agg(F.count("*").alias("n"))
    assert 0 < closed.count() < batch.count()
    assert rows(whole, "kind", "period_start", "n") == rows(batch, "kind", "d", "n")


def test_stream_keeps_one_row_per_key(spark):
    from tallyspan.session import new_folder

    folder = new_folder(spark, "t-dedupe")
    spark.range(50).selectExpr("id % 10 AS id", "timestamp_seconds(1700000000 + id) AS ts").coalesce(1).write.parquet(folder)
    stream = streams.read_stream(spark, folder, spark.read.parquet(folder).schema)
    stored = streams.drain(streams.deduplicated(stream, "ts", ["id"], "1 hour"), "t-dedupe")
    assert stored.count() == 10 and stored.select("id").distinct().count() == 10
