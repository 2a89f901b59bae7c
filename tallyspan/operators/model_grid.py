"""Model selection over a whole grid of orders, and over a grid of residual networks behind the chosen one.

The first grid has every (p, d, q)(P, D, Q) with p and q up to 2 and the others up to 1: 144 candidates a series. They are fitted by two-step least squares: a long
autoregression gives the innovations, then the differenced series is regressed on its own lags and on those of the innovations. All candidates of one differencing
share one matrix of sums and differ in which of its rows and columns they solve. All candidates see the same rows, so their criteria can be compared.

The second grid has every combination of 6 lag depths, 4 numbers of hidden units and 4 penalties, each with 3 seeds: hidden weights are drawn from the seed, output weights are a ridge
regression of the residuals.

A series is bounded by its calendar, so one group of a task is one series; candidates are scored, cut and chosen by ordinary DataFrame steps. Test rows never enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions.hashing import row_hash
from tallyspan.functions.numeric import floor_zero
from tallyspan.operators import metrics
from tallyspan.session import settle

Order = tuple[int, int, int, int, int, int]
#: Lags of the first regression, beside the seasonal one.
LONG = 3
#: A root this near to the unit circle or inside counts as unstable.
EDGE = 1.000001


@dataclass(frozen=True)
class Grid:
    """What is searched. The values of the lists are those of the published search."""

    season: int = 12
    listed: int = 10
    lags: tuple[int, ...] = (2, 4, 6, 8, 13, 26)
    hidden: tuple[int, ...] = (2, 4, 8, 12)
    penalties: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)
    seeds: tuple[int, ...] = (1, 2, 3)

    def orders(self) -> Iterator[Order]:
        return product(range(3), range(2), range(3), range(2), range(2), range(2))

    def name(self, order: Order) -> str:
        p, d, q, sp, sd, sq = order
        return f"({p},{d},{q})({sp},{sd},{sq}){self.season}"


def _lagged(x: np.ndarray, lag: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[lag:] = x[:-lag] if lag else x
    return out


class Sums:
    """Regressors of one series for one differencing, and the sums that all its candidates are solved from."""

    def __init__(self, y: np.ndarray, d: int, sd: int, season: int) -> None:
        self.y, self.d, self.sd, self.season = y, d, sd, season
        w = y - _lagged(y, 1) if d else y
        self.w = w = w - _lagged(w, season) if sd else w
        first = np.column_stack([np.ones(len(w)), *(_lagged(w, i) for i in (*range(1, LONG + 1), season))])
        known = np.isfinite(first).all(1) & np.isfinite(w)
        self.e = np.full(len(w), np.nan)
        if known.sum() > first.shape[1]:
            long = np.linalg.lstsq(first[known], w[known], rcond=None)[0]
            self.e[known] = w[known] - first[known] @ long
        lags = (1, 2, season)
        self.x = np.column_stack([np.ones(len(w)), *(_lagged(w, i) for i in lags), *(_lagged(self.e, i) for i in lags)])
        self.known = np.isfinite(self.x).all(1) & np.isfinite(w)

    def sum_up(self, rows: np.ndarray) -> None:
        x, w = self.x[rows], self.w[rows]
        self.n, self.left, self.right, self.total = int(rows.sum()), x.T @ x, x.T @ w, float(w @ w)

    def columns(self, order: Order) -> list[int]:
        """Columns of the regressors; a constant only where nothing is differenced."""
        p, d, q, sp, sd, sq = order
        return [0] * (not d and not sd) + [1, 2][:p] + [3] * sp + [4, 5][:q] + [6] * sq

    def solve(self, order: Order) -> tuple[np.ndarray, list[int], float]:
        at = self.columns(order)
        b = np.linalg.lstsq(self.left[np.ix_(at, at)], self.right[at], rcond=1e-10)[0] if at else np.zeros(0)
        return b, at, max(0.0, self.total - float(b @ self.right[at]))

    def stable(self, b: np.ndarray, at: list[int]) -> bool:
        """Whether all roots of the autoregression and of the moving average lie outside the unit circle."""
        for lags in ({1: 1, 2: 2, 3: self.season}, {4: 1, 5: 2, 6: self.season}):
            poly = np.zeros(self.season + 1)
            poly[0] = 1.0
            for value, column in zip(b, at, strict=True):
                if column in lags:
                    poly[lags[column]] += -value if column <= 3 else value
            used = np.trim_zeros(poly, "b")
            if len(used) > 1 and (np.abs(np.roots(used[::-1])) <= EDGE).any():
                return False
        return True

    def forecast(self, b: np.ndarray, at: list[int], steps: int) -> np.ndarray:
        """Values after the last one; innovations to come are zero, and so are unknown earlier ones. A missing earlier value counts as the mean."""
        w = np.where(np.isfinite(self.w), self.w, np.nanmean(self.w)).tolist()
        e = np.nan_to_num(self.e).tolist()
        y = np.where(np.isfinite(self.y), self.y, np.nanmean(self.y)).tolist()
        s, out = self.season, []
        for _ in range(steps):
            x = (1.0, w[-1], w[-2], w[-s], e[-1], e[-2], e[-s])
            now = sum(v * x[c] for v, c in zip(b.tolist(), at, strict=True))
            w.append(now)
            e.append(0.0)
            now += (y[-1] if self.d else 0.0) + (y[-s] if self.sd else 0.0) - (y[-s - 1] if self.d and self.sd else 0.0)
            y.append(now)
            out.append(now)
        return np.array(out)

    def residuals(self, b: np.ndarray, at: list[int]) -> np.ndarray:
        """One-step errors of the training rows; null where a regressor is unknown."""
        return np.where(self.known, self.w - self.x[:, at] @ b, np.nan)


def _series(rows: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """Training values on the whole calendar, their last position, and the number of positions after it."""
    train = rows[rows["split"] == "train"]
    if train.empty:
        return np.zeros(0), 0, 0
    first, last = int(train["m"].min()), int(train["m"].max())
    y = np.full(last - first + 1, np.nan)
    y[train["m"].to_numpy(np.int64) - first] = train["y"].to_numpy(float)
    return y, last, int(rows["m"].max()) - last


def _sums(y: np.ndarray, season: int) -> dict[tuple[int, int], Sums]:
    found = {(d, sd): Sums(y, d, sd, season) for d in (0, 1) for sd in (0, 1)}
    common = np.logical_and.reduce([s.known for s in found.values()])
    for s in found.values():
        s.sum_up(common)
    return found


FITTED = "k string, candidate string, n bigint, parameters bigint, aic double, status string, last_m bigint, forecast array<double>"


def _fit_all(rows: pd.DataFrame, grid: Grid) -> pd.DataFrame:
    y, last, steps = _series(rows)
    short = len(y) <= 2 * grid.season + 2
    sums = {} if short else _sums(y, grid.season)
    out = []
    for order in grid.orders():
        s = sums.get((order[1], order[4]))
        n = s.n if s else 0
        parameters = len(s.columns(order)) + 1 if s else 0
        status, aic, path = "few_rows", None, None
        if s and n > 2 * 8:
            b, at, rss = s.solve(order)
            path = s.forecast(b, at, steps)
            status = "unstable" if not s.stable(b, at) else "available" if rss > 0 and np.isfinite(path).all() else "not_finite"
            aic = n * np.log(rss / n) + 2 * parameters if rss > 0 else None
        out.append((rows["k"].iloc[0], grid.name(order), n, parameters, aic, status, last, path if status == "available" else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")])


def _searched(split: DataFrame) -> DataFrame:
    """Rows that the search may see: training and validation."""
    return split.filter(F.col("split") != "test").select(F.col("k").cast("string").alias("k"), F.col("m").cast("bigint").alias("m"), F.col("y").cast("double").alias("y"), "split")


def fit_grid(split: DataFrame, grid: Grid | None = None) -> DataFrame:
    """All candidates of all series: rows (k, candidate, n, parameters, aic, status, last_m, forecast).

    `split` has k, m, y and split (train, validation, test); a hole in the calendar is a missing value. `status` is `available`, or the reason why a candidate is refused: `few_rows`
    (16 common rows or fewer), `unstable`, `not_finite`. The forecast covers every position after the last training one.
    """
    chosen = grid or Grid()

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return _fit_all(rows, chosen)

    return _searched(split).groupBy("k").applyInPandas(of, FITTED)


def _errors(e: Column, actual: Column) -> list[Column]:
    relative = F.when(actual != 0, F.abs(e) / F.abs(actual))
    return [F.count(e).alias("scored"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(relative) * 100, 6).alias("mape")]


def _scored(paths: DataFrame, split: DataFrame, *keys: str) -> DataFrame:
    """Errors of floored forecasts on the observed validation rows, by key; `paths` has k, last_m and forecast."""
    steps = paths.select("k", *keys, "last_m", F.posexplode("forecast").alias("_h", "_p")).withColumn("m", F.col("last_m") + 1 + F.col("_h"))
    held = split.filter((F.col("split") == "validation") & F.col("y").isNotNull()).select("k", "m", F.col("y").cast("double").alias("actual"))
    return steps.join(held, ["k", "m"]).groupBy("k", *keys).agg(*_errors(F.col("actual") - floor_zero(F.col("_p")), F.col("actual")))


def shortlist(fitted: DataFrame, split: DataFrame, grid: Grid | None = None) -> DataFrame:
    """The available candidates of lowest criterion of each series with their validation errors, and the place of each; only these are scored."""
    grid = grid or Grid()
    chosen = metrics.shortlist(fitted.filter(F.col("status") == "available").withColumn("aic", F.round("aic", 6)), "aic", grid.listed)
    chosen = settle(chosen, "shortlist")
    return chosen.drop("forecast", "status").join(_scored(chosen.select("k", "candidate", "last_m", "forecast"), split, "candidate"), ["k", "candidate"])


CORRECTED = "k string, setting string, lags bigint, hidden bigint, penalty double, seed bigint, examples bigint, ok boolean, last_m bigint, forecast array<double>"


def _network(residuals: np.ndarray, lags: int, hidden: int, seed: int, penalties: tuple[float, ...], steps: int) -> tuple[int, list[np.ndarray | None]]:
    """Corrections for the steps to come by each penalty, and the number of examples they were learned from."""
    size = float(np.nanstd(residuals)) or 1.0
    z = residuals / size
    x = np.column_stack([_lagged(z, i) for i in range(1, lags + 1)])
    known = np.isfinite(x).all(1) & np.isfinite(z)
    n = int(known.sum())
    if n < hidden + 2:
        return n, [None] * len(penalties)
    draw = np.random.default_rng([seed, lags, hidden])
    weights, shift = draw.normal(size=(lags, hidden)) / np.sqrt(lags), draw.normal(size=hidden)
    h = np.column_stack([np.ones(n), np.tanh(x[known] @ weights + shift)])
    left, right = h.T @ h, h.T @ z[known]
    paths: list[np.ndarray | None] = []
    for penalty in penalties:
        b = np.linalg.solve(left + penalty * np.eye(hidden + 1), right)
        past = np.nan_to_num(z[-lags:]).tolist()
        for _ in range(steps):
            past.append(float(b[0] + np.tanh(np.array(past[:-lags - 1:-1]) @ weights + shift) @ b[1:]))
        path = np.array(past[lags:]) * size
        paths.append(path if np.isfinite(path).all() else None)
    return n, paths


def _correct_all(rows: pd.DataFrame, grid: Grid) -> pd.DataFrame:
    y, last, steps = _series(rows)
    order = next(o for o in grid.orders() if grid.name(o) == rows["candidate"].iloc[0])
    s = _sums(y, grid.season)[order[1], order[4]]
    b, at, _ = s.solve(order)
    base, residuals = s.forecast(b, at, steps), s.residuals(b, at)
    out = []
    for lags, hidden, seed in product(grid.lags, grid.hidden, grid.seeds):
        n, paths = _network(residuals, lags, hidden, seed, grid.penalties, steps) if lags < len(residuals) else (0, [None] * len(grid.penalties))
        for penalty, path in zip(grid.penalties, paths, strict=True):
            out.append((rows["k"].iloc[0], f"{lags}-{hidden}-{penalty:g}", lags, hidden, penalty, seed, n, path is not None, last, None if path is None else base + path))
    return pd.DataFrame(out, columns=[c.split()[0] for c in CORRECTED.split(", ")])


def correct_grid(split: DataFrame, winners: DataFrame, grid: Grid | None = None) -> DataFrame:
    """All residual settings and seeds behind each series' chosen candidate: rows of CORRECTED; `ok` is false where residuals are too few, `forecast` has the correction added."""
    chosen = grid or Grid()

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return _correct_all(rows, chosen)

    return _searched(split).join(winners.select("k", "candidate"), "k").groupBy("k").applyInPandas(of, CORRECTED)


def residual_scores(corrected: DataFrame, split: DataFrame) -> DataFrame:
    """Median errors over the seeds of every setting: rows (k, setting, n_seeds, all_ok, rmse, mae, mape); null where a seed failed."""
    runs = corrected.select("k", "setting", "seed", "ok").join(_scored(corrected.filter("ok"), split, "setting", "seed"), ["k", "setting", "seed"], "left")
    middle = [F.when(F.bool_and("ok"), F.round(F.median(c), 6)).alias(c) for c in ("rmse", "mae", "mape")]
    return runs.groupBy("k", "setting").agg(F.count("*").alias("n_seeds"), F.bool_and("ok").alias("all_ok"), *middle)


def select_models(split: DataFrame, grid: Grid | None = None) -> DataFrame:
    """The chosen candidate and residual setting of every series: rows (k, candidate, setting, base_rmse, hybrid_rmse, helps, status, lock_id).

    The candidate is the winner among the shortlisted, the setting the winner among those that all seeds succeeded with. A series without an available
    candidate has status `no_candidate`, one without a setting `no_correction`.
    """
    grid = grid or Grid()
    split = settle(split.withColumn("k", F.col("k").cast("string")), "split")
    listed = shortlist(fit_grid(split, grid), split, grid)
    winners = settle(metrics.tolerant_winner(listed.drop("place", "last_m", "n", "parameters", "aic", "scored")), "winners")
    scores = residual_scores(settle(correct_grid(split, winners, grid), "corrected"), split).filter("all_ok and rmse is not null")
    chosen = metrics.tolerant_winner(scores.drop("n_seeds", "all_ok"), "setting").select("k", "setting", F.col("rmse").alias("hybrid_rmse"))
    joined = split.select("k").distinct().join(winners.select("k", "candidate", F.col("rmse").alias("base_rmse")), "k", "left").join(chosen, "k", "left")
    status = F.when(F.col("candidate").isNull(), "no_candidate").when(F.col("setting").isNull(), "no_correction").otherwise("selected")
    return joined.select("k", "candidate", "setting", "base_rmse", "hybrid_rmse", (F.col("hybrid_rmse") < F.col("base_rmse")).alias("helps"), status.alias("status"),
                         F.when(status == "selected", row_hash(F.col("k"), F.col("candidate"), F.col("setting"))).alias("lock_id"))
