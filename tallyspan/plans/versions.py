"""Queries on versions, runs, feeds and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.config import MODEL, SCOPE
from tallyspan.functions.hashing import content_signature, row_hash
from tallyspan.functions.numeric import r6
from tallyspan.operators import coverage, exports, feeds, forecast, grid, metrics, model_grid, ranking, search, versions
from tallyspan.plans.forecasts import backtest_rows, candidates, future_paths, rounded
from tallyspan.plans.registry import query
from tallyspan.session import new_folder, settle
from tallyspan.sources import raw, readers, series, state, writers
from tallyspan.sources.tables import table

READER = (10, "admin")


def study(spark, folder):
    return study_of(series.reported_brands(spark, folder))


def study_of(reported):
    return grid.study_grid(reported, SCOPE.first_year, SCOPE.last_year, SCOPE.unavailable_years)


# ---- signatures ---------------------------------------------------------------------------------------------------

@query("content_signature")
def table_signature(spark, folder):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return content_signature(table(spark, folder, "lineitem", *columns), columns)


@query("series_signature")
def series_signature(spark, folder):
    return content_signature(series.user_daily(spark, folder), ["k", "m", "y"], ["k"])


@query("export_roundtrip")
def export_roundtrip(spark, folder):
    """The study table exported and read again has the signature it had before."""
    cells = study(spark, folder).select("k", "m", "y", "status")
    path = new_folder(spark, "export")
    writers.export_csv(cells, path)
    again = readers.read_monthly_csv(spark, path, ["k", "m", "y", "status"], ("k", "status"))
    columns = ["k", "m", "y", "status"]
    before, after = content_signature(cells, columns), content_signature(again, columns)
    return before.join(after.withColumnRenamed("n_rows", "n_read"), "content_signature", "full_outer").select(
        "n_rows", "n_read", (F.col("n_rows") == F.col("n_read")).alias("identical")
    )


# ---- datasets -----------------------------------------------------------------------------------------------------

@query("dataset_state")
def dataset_state(spark, folder):
    return versions.dataset_state(state.version_events(spark, folder))


@query("pending_list")
def pending_list(spark, folder):
    return versions.pending_list(versions.dataset_state(state.version_events(spark, folder)))


@query("active_dataset")
def active_dataset(spark, folder):
    """Lines of each customer's active data set, with the derived counts computed on read."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_quantity", "l_linenumber").withColumnRenamed("l_orderkey", "id")
    rows = versions.active_rows(versions.dataset_state(state.version_events(spark, folder)), lines)
    return rows.groupBy("scope", "id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("l_linenumber").alias("n_lines"), F.sum("l_quantity").alias("quantity")
    )


@query("dataset_stage")
def dataset_stage(spark, folder):
    """A validated candidate appended under its signature with a pending event; missing cells are stored with their reason."""
    cells = study(spark, folder).select("k", "m", "y", "status")
    mark = content_signature(cells, ["k", "m", "y", "status"])
    root = new_folder(spark, "staged")
    signed = cells.withColumn("signature", mark.select("content_signature").scalar())
    writers.append_rows(signed, f"{root}/observations", "signature")
    event = mark.select(F.col("content_signature").alias("signature"), "n_rows", F.lit("pending").alias("state"))
    writers.append_rows(event, f"{root}/events")
    stored = spark.read.parquet(f"{root}/observations").groupBy("signature").agg(
        F.count("*").alias("n_stored"), F.count("y").alias("n_observed"), F.count(F.when(F.col("y").isNull() & F.col("status").isNotNull(), 1)).alias("n_reasons"))
    return spark.read.parquet(f"{root}/events").join(stored, "signature").select("n_rows", "n_stored", "n_observed", "n_reasons", "state")


@query("json_round_trip")
def json_round_trip(spark, folder):
    """Values stored as JSON and read again; every tenth is not a number and must be refused."""
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    stored = events.select("event_id", exports.emit_json(F.struct("user_id", value.alias("value"))).alias("payload"))
    parsed = exports.parse_json(F.col("payload"), "user_id bigint, value double")
    return stored.select("event_id", F.col("payload").isNotNull().alias("stored"), parsed["user_id"].alias("user_id"), parsed["value"].alias("value"))


@query("state_scan")
def state_scan(spark, folder):
    """Run rows written by block and scanned again for one block and status."""
    path = new_folder(spark, "runs")
    writers.append_rows(state.forecast_runs(spark, folder), path, "block")
    found = spark.read.parquet(path).filter("block = 'error' and status = 'completed'")
    return found.select("run_id", "signature", "block", "status", "created_at")


@query("snapshot_write")
def snapshot_write(spark, folder):
    """A snapshot named by its content; a second write of the same content is refused."""
    paths = future_paths(series.settle(series.orders_monthly(spark, folder))).select("k", "m", "h", F.format_string("%.6f", F.col("hybrid")).alias("value"))
    mark = content_signature(paths, ["k", "m", "h", "value"]).first()["content_signature"]
    root = new_folder(spark, "snapshots")
    path = writers.write_snapshot(paths, root, mark)
    try:
        writers.write_snapshot(paths, root, mark)
        refused = False
    except Exception as error:  # noqa: BLE001
        refused = "already exists" in str(error).lower() or "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows")).withColumn("second_write_refused", F.lit(refused))


@query("audit_append")
def audit_append(spark, folder):
    """Decision events appended in two batches; both are there afterwards."""
    path = new_folder(spark, "audit")
    events = state.version_events(spark, folder)
    writers.append_rows(events.filter("action = 'upload'"), path)
    writers.append_rows(events.filter("action <> 'upload'"), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


@query("ranking_append")
def ranking_append(spark, folder):
    """Two ranking runs appended; the newest is the one read back."""
    path = new_folder(spark, "rankings")
    ranked = ranking.rank_totals(ranking.projected_total(future_paths(series.settle(series.orders_monthly(spark, folder)))))
    for run in (1, 2):
        writers.append_rows(ranked.withColumn("ranking_run", F.lit(run).cast("bigint")), path)
    return versions.latest_per_key(spark.read.parquet(path), ["k"], ["ranking_run"]).select("k", "rank", "projected_total", "ranking_run")


# ---- runs ---------------------------------------------------------------------------------------------------------

@query("current_runs")
def current_runs(spark, folder):
    return state.forecast_runs(spark, folder).filter(versions.is_current()).select("run_id", "signature", "block", "created_at")


@query("latest_run")
def latest_run(spark, folder):
    current = state.forecast_runs(spark, folder).filter(versions.is_current()).select("run_id", "signature", "block", "created_at")
    return versions.latest_per_key(current, ["signature", "block"], ["created_at", "run_id"])


@query("run_upsert")
def run_upsert(spark, folder):
    """Runs saved as running and, once they end, saved again; each run keeps its newest row and that row's values."""
    runs = state.forecast_runs(spark, folder).select("run_id", "status", "value")
    first = runs.select("run_id", F.lit("running").alias("status"), F.lit(1).cast("bigint").alias("version"))
    second = runs.filter("status <> 'running'").select("run_id", "status", F.lit(2).cast("bigint").alias("version"))
    values = runs.select("run_id", F.explode(F.expr("sequence(1L, 2L)")).alias("version"), "value").select(
        "run_id", "version", F.explode(F.expr("sequence(1L, 3L)")).alias("h"), (F.col("value") * F.col("version")).alias("value")
    )
    latest, kept = versions.upsert_runs(first.unionByName(second), values)
    sums = kept.groupBy("run_id").agg(F.count("*").alias("n_values"), F.sum("value").alias("total"))
    return rounded(latest.join(sums, "run_id", "left").select("run_id", "status", "version", "n_values", "total"), "total")


@query("visible_results")
def visible_results(spark, folder):
    """Current runs of the users whose newest event is no error."""
    events = table(spark, folder, "events", "user_id", "event_id", "event_type")
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t")).filter("t <> 'error'")
    active = last.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("signature"))
    return versions.visible_results(state.forecast_runs(spark, folder), active).select("run_id", "signature", "block")


@query("run_status_counts")
def run_status_counts(spark, folder):
    return state.forecast_runs(spark, folder).groupBy("block", "status").agg(F.count("*").alias("n_runs"), F.count("value").alias("n_values"))


@query("lock_lookup")
def lock_lookup(spark, folder):
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    keyed = customers.withColumn("source_key", versions.source_key("c_mktsegment", "c_nationkey"))
    done = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("locked_at"),
                                                      row_hash(F.col("o_orderkey")).alias("lock_id"))
    newest = versions.latest_per_key(done, ["o_custkey"], ["locked_at", "lock_id"])
    locks = newest.join(keyed.filter("c_nationkey % 4 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    keys = keyed.select("c_mktsegment", "c_nationkey", "source_key").distinct()
    return versions.lock_lookup(keys, locks)


def _split(spark, folder):
    return forecast.three_way_split(series.settle(series.brand_monthly(spark, folder).select("k", "m", "y")), 12, 12)


def _winners(split):
    return search.candidate_search(split, candidates(split.select("k").distinct()), 5)


def _scores(split):
    return search.score_candidates(search.fit_candidates(split, candidates(split.select("k").distinct())))


@query("candidate_search")
def candidate_search(spark, folder):
    return _winners(_split(spark, folder))


@query("shortlist")
def shortlist(spark, folder):
    from tallyspan.operators.metrics import shortlist as cut

    return cut(_scores(_split(spark, folder)), "aic", 5).select("k", "candidate", "aic", "place")


@query("tolerant_winner")
def tolerant_winner(spark, folder):
    from tallyspan.operators.metrics import tolerant_winner as pick

    return pick(_scores(_split(spark, folder))).select("k", "candidate", "rmse", "mae")


@query("model_grid")
def model_grid_query(spark, folder):
    """All 144 orders of every brand with their criterion, or why they are refused."""
    found = model_grid.fit_grid(_split(spark, folder))
    return found.select("k", "candidate", "n", "parameters", F.round("aic", 6).alias("aic"), "status")


@query("model_shortlist")
def model_shortlist(spark, folder):
    split = _split(spark, folder)
    return model_grid.shortlist(model_grid.fit_grid(split), split).select("k", "candidate", "place", "aic", "scored", "rmse", "mae", "mape")


@query("residual_grid")
def residual_grid(spark, folder):
    """Median errors of all 96 residual settings behind each brand's chosen order."""
    split = settle(_split(spark, folder), "split")
    listed = model_grid.shortlist(model_grid.fit_grid(split), split)
    winners = settle(metrics.tolerant_winner(listed.select("k", "candidate", "rmse", "mae", "mape")), "winners")
    return model_grid.residual_scores(settle(model_grid.correct_grid(split, winners), "corrected"), split)


@query("model_selection")
def model_selection(spark, folder):
    return model_grid.select_models(_split(spark, folder))


@query("rank_correlation")
def rank_correlation(spark, folder):
    from tallyspan.operators.metrics import rank_correlation as correlate

    return rounded(correlate(_scores(_split(spark, folder)), "aic", "rmse"), "rho")


def _locks(split):
    fixed = content_signature(split.filter("split <> 'test'"), ["m", "y"], ["k"])
    return search.lock(_winners(split), fixed)


@query("config_lock")
def config_lock(spark, folder):
    """Locks checked against data that changed for some keys and with one altered setting."""
    split = _split(spark, folder)
    locks = _locks(split).withColumn("candidate", F.when(F.col("k") == "Brand#3", "other").otherwise(F.col("candidate")))
    changed = split.filter("split <> 'test'").withColumn("y", F.when(F.col("k") == "Brand#5", F.col("y") + 1).otherwise(F.col("y")))
    return search.verify_lock(locks, content_signature(changed, ["m", "y"], ["k"])).select("k", "lock_status")


@query("evidence_reuse")
def evidence_reuse(spark, folder):
    """Stored evaluations against the ones wanted now: some absent, some with test outcomes that were revised."""
    tested = _split(spark, folder).filter("split = 'test'")
    now = content_signature(tested, ["m", "y"], ["k"]).select(row_hash(F.col("k")).alias("evidence_key"), "k", F.col("content_signature").alias("payload_hash"))
    before = tested.filter("k <> 'Brand#7'").withColumn("y", F.when(F.col("k") == "Brand#8", F.col("y") + 1).otherwise(F.col("y")))
    stored = content_signature(before, ["m", "y"], ["k"]).select(row_hash(F.col("k")).alias("evidence_key"), F.col("content_signature").alias("payload_hash"))
    return versions.evidence_reuse(now, stored).select("k", "outcome")


@query("config_override")
def config_override(spark, folder):
    """History length per key: its own setting where there is one, else the default."""
    own = F.create_map(F.lit("Brand#1"), F.lit(24), F.lit("Brand#2"), F.lit(36), F.lit("default"), F.lit(12))
    length = F.coalesce(F.try_element_at(own, F.col("k")), F.try_element_at(own, F.lit("default"))).cast("bigint")
    cells = series.settle(series.brand_monthly(spark, folder))
    end = cells.agg(F.max("m")).scalar()
    return cells.withColumn("_e", end).withColumn("months", length).filter(F.col("m") > F.col("_e") - F.col("months")).groupBy("k", "months").agg(
        F.sum("y").alias("total"), F.count("*").alias("n")
    )


@query("seed_median")
def seed_median(spark, folder):
    from tallyspan.operators.metrics import seed_median as median

    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    runs = events.groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("candidate"), (F.col("event_id") % 3).alias("seed")).agg(
        F.bool_and(F.col("event_id") % 50 != 0).alias("ok"), F.max("value").alias("mae"), (F.max("value") * 2).alias("rmse")
    )
    return rounded(median(runs, "k", "candidate"), "mae", "rmse")


@query("error_row_check")
def error_row_check(spark, folder):
    folds = forecast.rolling_folds(series.settle(series.orders_monthly(spark, folder)), 3, 12)
    ends = folds.filter("train").groupBy("k", "fold").agg(F.max("m").alias("cutoff"))
    rows = folds.filter("not train").join(ends, ["k", "fold"]).select("k", "cutoff", "m")
    doubled = rows.unionByName(rows.filter("k = '2-HIGH'"))
    swapped = doubled.select("k", F.when(F.col("k") == "5-LOW", F.col("m")).otherwise(F.col("cutoff")).alias("cutoff"), "m")
    return versions.error_row_check(swapped)


# ---- feeds --------------------------------------------------------------------------------------------------------

def _feed(spark, folder):
    return feeds.feed(state.notices(spark, folder), state.receipts(spark, folder), *READER)


@query("audience_feed")
def audience_feed(spark, folder):
    return _feed(spark, folder).select("id", "type", "is_read")


@query("unread_count")
def unread_count(spark, folder):
    return feeds.unread(state.notices(spark, folder), state.receipts(spark, folder), *READER).agg(F.count("*").alias("unread"))


@query("mark_read")
def mark_read(spark, folder):
    selected = state.notices(spark, folder).filter("type = 'error'")
    return feeds.mark_read(state.notices(spark, folder), state.receipts(spark, folder), *READER, selected)


@query("feed_by_day")
def feed_by_day(spark, folder):
    return feeds.by_day(_feed(spark, folder)).select("id", "type", "day")


@query("feed_filter")
def feed_filter(spark, folder):
    return feeds.filtered(_feed(spark, folder), "unread", "click").select("id", "type", "is_read")


@query("change_token")
def change_token(spark, folder):
    events = state.version_events(spark, folder)
    audit = events.select((F.col("id") * 10 + F.col("seq")).alias("id"))
    return feeds.change_token(versions.dataset_state(events), audit, state.notices(spark, folder), state.receipts(spark, folder), *READER)


# ---- exports ------------------------------------------------------------------------------------------------------

def _export(spark, folder):
    reported = series.reported_brands(spark, folder)
    history = study_of(reported).select("k", "m", "y", "status")
    ahead = forecast.corrected_forecast(forecast.future_frame(reported, MODEL.horizon))
    return exports.history_forecast(history, ahead.select("k", "m", r6(F.col("base")).alias("projected"), F.lit("projected").alias("status")))


@query("history_forecast_union")
def history_forecast_union(spark, folder):
    return _export(spark, folder)


@query("report_export")
def report_export(spark, folder):
    """Written as CSV and read back as text: unknown counts are blank cells."""
    path = new_folder(spark, "report")
    rows = _export(spark, folder).select("k", "m", "y", "status", "kind")
    writers.export_csv(rows, path)
    back = readers.read_text_csv(spark, path)
    return back.groupBy("kind", "status").agg(F.count("*").alias("n"), F.count("y").alias("n_counts"))


@query("provenance_export")
def provenance_export(spark, folder):
    context = {
        "dataset_type": "derived", "frequency": "monthly", "model_version": MODEL.version, "configuration": MODEL.signature,
        "evaluation_split": MODEL.evaluation_split, "residual_method": MODEL.residual_method, "gap_handling": MODEL.gap_handling,
    }
    rows = exports.with_context(_export(spark, folder), context)
    return rows.withColumn("excluded_from_training", F.col("y").isNull())


@query("report_document")
def report_document(spark, folder):
    reported = series.reported_brands(spark, folder)
    cells = study_of(reported)
    annual = coverage.annual_history(cells, SCOPE.unavailable_years)
    ahead = future_totals(reported)
    return exports.report_document(cells.select("k", "m", "y"), annual, ahead)


def future_totals(reported):
    """Seasonal-naive path of every reported key, whole numbers."""
    frame = forecast.future_frame(reported, MODEL.horizon)
    return forecast.seasonal_naive(frame).select("k", "h", F.col("naive").cast("bigint").alias("value"))


@query("snapshot_reconcile")
def snapshot_reconcile(spark, folder):
    monthly = series.settle(series.orders_monthly(spark, folder))
    rows = exports.snapshot_reconcile(
        backtest_rows(monthly).select("k", "m", "model", "predicted"), monthly.select("k", "m", "y"), F.col("m") % 5 != 0
    )
    return rounded(rows, "predicted", "absolute_error")


@query("context_guard")
def context_guard(spark, folder):
    return exports.context_guard(raw.raw_orders(spark, folder), {"population": "5-19", "location": "South"}, "source_row")


@query("revision_of_runs")
def revision_of_runs(spark, folder):
    """How often each block's runs were superseded by a newer current run of the same data set."""
    current = state.forecast_runs(spark, folder).filter(versions.is_current())
    counted = current.groupBy("signature", "block").agg(F.count("*").alias("n"))
    return counted.groupBy("block").agg(F.sum(F.col("n") - 1).alias("superseded"), F.count("*").alias("kept"))


@query("fold_signatures")
def fold_signatures(spark, folder):
    """Signature of the training window of every rolling fold; it does not move when later counts do."""
    folds = forecast.rolling_folds(series.orders_monthly(spark, folder), 3, 12).filter("train")
    return content_signature(folds, ["m", "y"], ["k", "fold"])
