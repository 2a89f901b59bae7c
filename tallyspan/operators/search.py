"""Candidate search: all settings of all series are fitted and scored in one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyspan.functions.hashing import row_hash
from tallyspan.functions.numeric import floor_zero
from tallyspan.operators import metrics


def fit_candidates(split: DataFrame, grid: DataFrame) -> DataFrame:
    """Fitted and validation values of each candidate: a level or a line, plus means by season position.

    `split` holds k, m, y and split (train, validation, test). Test rows are dropped first and never reach the search.
    """
    known = split.filter(F.col("split") != "test").select("k", "m", F.col("y").cast("double").alias("y"), (F.col("split") == "train").alias("train"))
    wide = known.join(grid, "k")
    by_fit = Window.partitionBy("k", "candidate")
    y = F.when(F.col("train"), F.col("y"))
    timed = wide.withColumn("_t", (F.col("m") - F.min("m").over(by_fit)).cast("double")).withColumn("_y", y)
    line = F.regr_intercept("_y", "_t").over(by_fit) + F.regr_slope("_y", "_t").over(by_fit) * F.col("_t")
    trended = timed.withColumn("_trend", F.when(F.col("kind") == "trend", line).otherwise(F.avg("_y").over(by_fit)))
    phase = Window.partitionBy("k", "candidate", "_phase")
    return (
        trended.withColumn("_phase", F.col("m") % F.col("season"))
        .withColumn("predicted", F.col("_trend") + F.avg(F.col("_y") - F.col("_trend")).over(phase))
        .select("k", "candidate", "kind", "season", "m", "train", F.col("y").alias("actual"), "predicted")
    )


def score_candidates(fitted: DataFrame) -> DataFrame:
    """Information criterion on training rows and errors on validation rows, one row per key and candidate."""
    e = F.col("actual") - F.col("predicted")
    floored = F.col("actual") - floor_zero(F.col("predicted"))
    held = F.when(~F.col("train"), floored)
    sums = fitted.groupBy("k", "candidate", "kind", "season").agg(
        F.count(F.when(F.col("train"), 1)).alias("n"),
        F.sum(F.when(F.col("train"), e * e)).alias("rss"),
        F.sqrt(F.avg(held * held)).alias("rmse"),
        F.avg(F.abs(held)).alias("mae"),
        F.avg(F.when(F.col("actual") != 0, F.abs(held) / F.abs(F.col("actual")))).alias("mape"),
    )
    parameters = F.col("season") + F.when(F.col("kind") == "trend", 1).otherwise(0)
    aic = F.col("n") * F.log(F.col("rss") / F.col("n")) + 2 * parameters
    return sums.select("k", "candidate", F.round(aic, 6).alias("aic"), F.round("rmse", 6).alias("rmse"),
                       F.round("mae", 6).alias("mae"), F.round(F.col("mape") * 100, 6).alias("mape"))


def candidate_search(split: DataFrame, grid: DataFrame, listed: int) -> DataFrame:
    """Shortlist by the criterion, then the validation winner of each key."""
    short = metrics.shortlist(score_candidates(fit_candidates(split, grid)), "aic", listed)
    return metrics.tolerant_winner(short.drop("place"))


def lock(winners: DataFrame, data_signature: DataFrame) -> DataFrame:
    """Identifier over the chosen setting and over the training and validation data it was chosen on."""
    return winners.join(data_signature, "k").select(
        "k", "candidate", F.col("content_signature").alias("data_signature"),
        row_hash(F.col("k"), F.col("candidate"), F.col("content_signature")).alias("lock_id"),
    )


def verify_lock(locks: DataFrame, current: DataFrame) -> DataFrame:
    """A lock holds when its identifier follows from its body and the data still have the signature it names."""
    body = row_hash(F.col("k"), F.col("candidate"), F.col("data_signature"))
    return locks.join(current.select("k", F.col("content_signature").alias("now")), "k", "left").select(
        "k", "candidate",
        F.when(F.col("lock_id") != body, "lock_altered")
        .when(F.col("now").isNull() | (F.col("now") != F.col("data_signature")), "data_changed")
        .otherwise("valid").alias("lock_status"),
    )
