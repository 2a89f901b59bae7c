"""Dataset versions, forecast runs and what is visible under the active version.

State is never updated in place. Events are appended, and the current state follows from them, so a lost executor or a
repeated job cannot leave a half-made change. One writer at a time is assumed per scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.config import MODEL, ModelSettings
from tallyspan.functions.hashing import row_hash


def dataset_state(events: DataFrame) -> DataFrame:
    """State of every dataset from its events (scope, id, signature, action, at, seq).

    Only the first decision on a pending dataset counts; later ones are illegal and are reported as such. Of the
    activated datasets of a scope the one activated last is active, the others are retired.
    """
    decisive = F.col("action") != "upload"
    moment = F.struct("at", "seq")
    per_dataset = events.groupBy("scope", "id").agg(
        F.max("signature").alias("signature"),
        F.min(F.when(~decisive, F.col("at"))).alias("uploaded_at"),
        F.min_by("action", F.when(decisive, moment)).alias("decision"),
        F.min(F.when(decisive, moment)).alias("decided"),
        F.count(F.when(decisive, 1)).alias("n_decisions"),
    )
    latest = per_dataset.filter("decision = 'activate'").groupBy("scope").agg(
        F.max_by("id", F.struct(F.col("decided.at"), F.col("decided.seq"), F.col("id"))).alias("active_id")
    )
    return per_dataset.join(latest, "scope", "left").select(
        "scope", "id", "signature", "uploaded_at", F.col("decided.at").alias("decided_at"),
        F.when(F.col("decision").isNull(), "pending")
        .when(F.col("decision") == "cancel", "cancelled").when(F.col("decision") == "reject", "rejected")
        .when(F.col("id") == F.col("active_id"), "active").otherwise("retired").alias("state"),
        F.greatest(F.col("n_decisions") - 1, F.lit(0)).cast("bigint").alias("n_illegal"),
    )


def pending_list(states: DataFrame) -> DataFrame:
    return states.filter("state = 'pending'").select("scope", "id", "uploaded_at").orderBy(F.desc("uploaded_at"), "id")


def active_rows(states: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of the active datasets only; stored rows are read as they are."""
    return observations.join(states.filter("state = 'active'").select("scope", "id"), "id")


def is_current(settings: ModelSettings = MODEL) -> Column:
    """A finished run of this model, version and configuration. All tests are on plain columns and reach the scan."""
    return (
        (F.col("status") == "completed") & (F.col("model_name") == settings.name) & (F.col("model_version") == settings.version)
        & (F.col("configuration") == settings.signature)
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key. The aggregate keeps one row per key on the map side, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_runs(runs: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appended run rows seen as an upsert: the newest row of each run, and only that version's values."""
    latest = latest_per_key(runs, ["run_id"], ["version"])
    kept = latest.filter("status = 'completed'").select("run_id", "version")
    return latest, values.join(kept, ["run_id", "version"], "left_semi")


def visible_results(runs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Current runs that belong to an active signature; all others stay invisible."""
    return runs.filter(is_current()).join(signatures.select("signature").distinct(), "signature", "left_semi")


def lock_lookup(keys: DataFrame, locks: DataFrame) -> DataFrame:
    """Latest stored lock for each source key and series, or missing."""
    latest = latest_per_key(locks.select("source_key", "locked_at", "lock_id"), ["source_key"], ["locked_at", "lock_id"])
    return keys.join(latest, "source_key", "left").withColumn("state", F.when(F.col("lock_id").isNull(), "missing").otherwise("runtime"))


def evidence_reuse(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Which evaluations can be reused: same key and same payload hash; a changed payload is flagged, not overwritten."""
    return wanted.join(stored.select("evidence_key", F.col("payload_hash").alias("stored_hash")), "evidence_key", "left").withColumn(
        "outcome",
        F.when(F.col("stored_hash").isNull(), "evaluate").when(F.col("stored_hash") == F.col("payload_hash"), "reuse").otherwise("revised"),
    )


def source_key(*columns: str) -> Column:
    return row_hash(*[F.col(c) for c in columns])


def error_row_check(rows: DataFrame) -> DataFrame:
    """Per key: every target lies after its training cutoff and no pair repeats."""
    pairs = rows.groupBy("k", "cutoff", "m").agg(F.count("*").alias("_n"))
    return pairs.groupBy("k").agg(
        F.sum("_n").alias("n_rows"), F.count(F.when(F.col("cutoff") >= F.col("m"), 1)).alias("n_not_after"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("n_repeated"),
    ).withColumn("valid", (F.col("n_not_after") == 0) & (F.col("n_repeated") == 0))
