"""Fitted models that have no closed form in SQL: boosted trees on residual lags, and a trend with Fourier terms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyspan.config import MODEL, ModelSettings
from tallyspan.operators.forecast import residual_rows, trend_season
from tallyspan.operators.lags import calendar_lags
from tallyspan.session import settle

SETTLE_EVERY = 12


def _lag_names(lags: int) -> list[str]:
    return [f"lag{i}" for i in range(1, lags + 1)]


def _features(df: DataFrame, lags: int) -> DataFrame:
    """Lags with a stand-in for the unknown ones and a flag beside each, since the trees refuse missing values."""
    names = _lag_names(lags)
    filled = df.select(
        "*", *[F.coalesce(n, F.lit(0.0)).alias(f"{n}_v") for n in names], *[F.col(n).isNull().cast("double").alias(f"{n}_u") for n in names]
    )
    columns = [f"{n}_v" for n in names] + [f"{n}_u" for n in names]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled).drop(*columns)


def fit_residual_trees(frame: DataFrame, settings: ModelSettings = MODEL) -> tuple[GBTRegressionModel, DataFrame]:
    """One tree ensemble for all series, trained on their usable residual rows, and the fitted frame."""
    fitted = residual_rows(trend_season(frame, settings.season), settings)
    rows = calendar_lags(fitted.select("k", "m", "residual", "usable"), settings.lags, "residual").filter("usable")
    learner = GBTRegressor(
        labelCol="residual", featuresCol="features", seed=settings.seed, maxIter=settings.tree_count,
        maxDepth=settings.tree_depth, stepSize=settings.tree_step, subsamplingRate=0.9,
    )
    return learner.fit(_features(rows, settings.lags)), fitted


def tree_corrections(model: GBTRegressionModel, fitted: DataFrame, end: int, settings: ModelSettings = MODEL) -> DataFrame:
    """Recursive corrections of all series: every step appends one prediction to each series' own history.

    A series that ends early is first carried to the end of the table by predictions, as many as it needs. The steps are
    narrow, one row per series; a written table cuts the plan now and then, and series that need no more steps are set aside there.
    """
    known = fitted.filter(F.col("residual").isNotNull())
    last = known.groupBy("k").agg(F.max("m").alias("last_m"))
    slots = [
        F.max(F.when(F.col("m") == F.col("last_m") - (settings.lags - 1 - i), F.col("residual"))).alias(f"s{i}") for i in range(settings.lags)
    ]
    state = known.join(last, "k").filter(F.col("m") > F.col("last_m") - settings.lags).groupBy("k", "last_m").agg(*slots).select(
        "k", "last_m", F.array(*[F.col(f"s{i}") for i in range(settings.lags)]).alias("history")
    )
    first = last.agg(F.min("last_m")).first()[0]
    steps = end + settings.horizon - first
    done: list[DataFrame] = []
    for step in range(1, steps + 1):
        lagged = state.select("k", "last_m", "history", *[
            F.element_at("history", -i).alias(f"lag{i}") for i in range(1, settings.lags + 1)
        ])
        predicted = model.transform(_features(lagged, settings.lags))
        wanted = F.col("last_m") + step <= end + settings.horizon
        state = predicted.select(
            "k", "last_m", F.when(wanted, F.concat("history", F.array("prediction"))).otherwise(F.col("history")).alias("history")
        )
        if step % SETTLE_EVERY == 0 and step < steps:
            state = settle(state, "recursion")
            ended = F.col("last_m") + step >= end + settings.horizon
            done.append(state.filter(ended))
            state = state.filter(~ended)
    for part in done:
        state = state.unionByName(part)
    return state.select("k", "last_m", F.posexplode(F.slice("history", F.lit(settings.lags + 1), F.size("history"))).alias("pos", "correction")).select(
        "k", (F.col("last_m") + 1 + F.col("pos")).alias("m"), "correction"
    ).filter(F.col("m") > end).withColumn("h", F.col("m") - end)


# ---- trend with Fourier terms -------------------------------------------------------------------------------------

def _fourier_terms(t: Column, m: Column, pairs: int, season: int) -> list[Column]:
    terms = [F.lit(1.0), t]
    for i in range(1, pairs + 1):
        angle = m * (2 * math.pi * i / season)
        terms += [F.sin(angle), F.cos(angle)]
    return terms


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(sums: pd.Series) -> pd.Series:
    """Coefficients from the normal-equation sums of each series, all series of a batch at once."""
    packed = np.stack(sums.to_numpy())
    size = int((math.isqrt(1 + 4 * packed.shape[1]) - 1) // 2)
    left = packed[:, : size * size].reshape(-1, size, size)
    right = packed[:, size * size:]
    try:
        return pd.Series(list(np.linalg.solve(left, right[..., None])[..., 0]))
    except np.linalg.LinAlgError:  # one series without a unique fit must not end the others
        return pd.Series([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right, strict=True)])


def fourier_base(frame: DataFrame, pairs: int = 3, season: int = 12, ridge: float = 1e-6) -> DataFrame:
    """Line plus Fourier pairs fitted on training rows by ridge regression.

    The sums of the normal equations are ordinary aggregates, one row per series; only that row meets Python.
    """
    origin = frame.agg(F.min("m")).scalar()
    timed = frame.withColumn("_o", origin).withColumn("_t", (F.col("m") - F.col("_o")) / F.lit(12.0))
    terms = _fourier_terms(F.col("_t"), F.col("m"), pairs, season)
    known = F.col("train") & F.col("y").isNotNull()
    size = len(terms)
    sums = []
    for i in range(size):
        for j in range(size):
            total = F.sum(F.when(known, terms[i] * terms[j]))
            sums.append(total + F.lit(ridge) if i == j else total)
    sums += [F.sum(F.when(known, term * F.col("y"))) for term in terms]
    fits = timed.filter(known).groupBy("k").agg(F.array(*sums).alias("_sums"), F.count("*").alias("n_train")).filter(F.col("n_train") >= size)
    solved = fits.select("k", _solve("_sums").alias("_w"))
    value = F.lit(0.0)
    for i, term in enumerate(terms):
        value = value + F.element_at("_w", i + 1) * term
    return timed.join(solved, "k").select("k", "m", "h", "y", "train", value.alias("base"))
