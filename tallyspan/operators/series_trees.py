"""Residual corrections by boosted regression trees, an ensemble for every series.

Each series learns its own trees from its own residual lags, at the published settings: 1,000 trees of depth 6, step 0.3, nine tenths of rows and of columns for each tree, penalties of one
on the size and on the square of a leaf. An unknown lag is a missing value: every split learns to which side missing values go.

A series has one row a period, so a group is bounded by the calendar and series are spread over tasks. All draws come from the seed and the name of the series.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyspan.config import MODEL, ModelSettings


@dataclass(frozen=True)
class TreeSettings:
    """The published values."""

    count: int = 1000
    depth: int = 6
    step: float = 0.3
    rows: float = 0.9
    columns: float = 0.9
    size_penalty: float = 1.0
    square_penalty: float = 1.0
    #: A leaf has so many rows at least.
    least_rows: int = 1


def _shrunk(total: np.ndarray, penalty: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - penalty, 0.0)


@dataclass(frozen=True)
class Split:
    """The best cut of some rows: a column, a threshold (values below it go left), the side of missing values, and what it gains."""

    column: int
    threshold: float
    missing_left: bool
    gain: float


def best_split(x: np.ndarray, g: np.ndarray, settings: TreeSettings) -> Split | None:
    """Tries every threshold between two different values of every column, with missing values on either side; ties go to the lower column, then threshold."""
    n, total = len(g), float(g.sum())
    order = np.argsort(x, axis=0, kind="stable")  # missing values last
    values = np.take_along_axis(x, order, axis=0)
    sums = np.cumsum(g[order], axis=0)
    present = np.isfinite(values)
    many = present.sum(axis=0)
    known = np.where(many > 0, np.take_along_axis(sums, np.maximum(many - 1, 0)[None], axis=0)[0], 0.0)
    below = np.arange(1, n)[:, None]
    cut = present[1:] & (values[1:] != values[:-1])
    best: Split | None = None
    own = _shrunk(np.array(total), settings.size_penalty) ** 2 / (n + settings.square_penalty)
    for missing_left in (False, True):
        left = sums[:-1] + (total - known if missing_left else 0.0)
        n_left = np.minimum(below + (n - many if missing_left else 0), n)
        n_right = np.maximum(n - n_left, 0)
        able = cut & (n_left >= settings.least_rows) & (n_right >= settings.least_rows)
        gain = (_shrunk(left, settings.size_penalty) ** 2 / (n_left + settings.square_penalty)
                + _shrunk(total - left, settings.size_penalty) ** 2 / (n_right + settings.square_penalty) - own) / 2
        gain = np.where(able, gain, -np.inf)
        at = int(np.argmax(gain.T))
        column, row = divmod(at, n - 1)
        found = float(gain[row, column])
        if found > 1e-9 and (best is None or found > best.gain + 1e-12):
            best = Split(column, float((values[row, column] + values[row + 1, column]) / 2), missing_left, found)
    return best


class Trees:
    """An ensemble for squared errors, grown one tree after the other on what is left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int, settings: TreeSettings) -> None:
        self.settings, self.start = settings, float(y.mean())
        self._nodes: list[list[tuple]] = []
        draw = np.random.default_rng(seed)
        now = np.full(len(y), self.start)
        for _ in range(settings.count):
            rows = draw.random(len(y)) < settings.rows
            if not rows.any():
                rows[:] = True
            columns = np.sort(draw.permutation(x.shape[1])[:max(1, round(settings.columns * x.shape[1]))])
            nodes: list[tuple] = []
            moved = np.zeros(len(y))
            self._grow(x, now - y, rows, np.arange(len(y)), columns, settings.depth, nodes, moved)
            now = now + moved
            self._nodes.append(nodes)

    def _grow(self, x: np.ndarray, g: np.ndarray, chosen: np.ndarray, at: np.ndarray, columns: np.ndarray, depth: int, nodes: list[tuple], moved: np.ndarray) -> int:
        """Adds the node of some rows and those below it; all rows are moved, the chosen ones alone decide."""
        place = len(nodes)
        nodes.append(())
        own = at[chosen[at]]
        split = best_split(x[np.ix_(own, columns)], g[own], self.settings) if depth and len(own) > 1 else None
        if split is None:
            value = -float(_shrunk(g[own].sum(), self.settings.size_penalty)) / (len(own) + self.settings.square_penalty) * self.settings.step
            nodes[place] = (-1, value)
            moved[at] = value
            return place
        column = int(columns[split.column])
        v = x[at, column]
        left = np.where(np.isfinite(v), v < split.threshold, split.missing_left)
        a = self._grow(x, g, chosen, at[left], columns, depth - 1, nodes, moved)
        b = self._grow(x, g, chosen, at[~left], columns, depth - 1, nodes, moved)
        nodes[place] = (column, split.threshold, split.missing_left, a, b)
        return place

    def predict(self, row: list[float]) -> float:
        total = self.start
        for nodes in self._nodes:
            node = nodes[0]
            while node[0] >= 0:
                v = row[node[0]]
                node = nodes[node[3] if (node[2] if v != v else v < node[1]) else node[4]]
            total += node[1]
        return total


CORRECTIONS = "k string, m bigint, h bigint, correction double, n_rows bigint"


def _corrected(rows: pd.DataFrame, model: ModelSettings, trees: TreeSettings) -> pd.DataFrame:
    end = int(rows["end"].iloc[0])
    known = rows[rows["residual"].notna()]
    key = rows["k"].iloc[0]
    out: list[tuple] = []
    if len(known):
        first, last = int(known["m"].min()), int(known["m"].max())
        e = np.full(last - first + 1, np.nan)
        e[known["m"].to_numpy(np.int64) - first] = known["residual"].to_numpy(float)
        usable = known.loc[known["usable"].to_numpy(bool), "m"].to_numpy(np.int64) - first
        padded = np.concatenate([np.full(model.lags, np.nan), e])
        x = np.column_stack([padded[usable + model.lags - i] for i in range(1, model.lags + 1)])
        if len(usable) >= model.min_residual_rows:
            fitted = Trees(x, e[usable], zlib.crc32(f"{model.seed}:{key}".encode()), trees)
            past = padded.tolist()
            for m in range(last + 1, end + model.horizon + 1):
                past.append(fitted.predict(past[:-model.lags - 1:-1]))
                if m > end:
                    out.append((key, m, m - end, past[-1], len(usable)))
        else:
            out = [(key, end + h, h, None, len(usable)) for h in range(1, model.horizon + 1)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in CORRECTIONS.split(", ")])


def tree_corrections(fitted: DataFrame, end: int, model: ModelSettings = MODEL, trees: TreeSettings | None = None) -> DataFrame:
    """Corrections for the horizon after `end`: rows (k, m, h, correction, n_rows), each step learned from the ones before.

    `fitted` has k, m, residual and usable, as `forecast.residual_rows` gives them. A series that ends early is carried on to `end` first. With fewer usable rows than the
    model asks for, the correction is null; a series without any residual has no rows.
    """
    chosen = trees or TreeSettings()

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return _corrected(rows, model, chosen)

    rows = fitted.select(F.col("k").cast("string").alias("k"), F.col("m").cast("bigint").alias("m"), F.col("residual").cast("double").alias("residual"),
                         F.coalesce("usable", F.lit(False)).alias("usable"), F.lit(end).cast("bigint").alias("end"))
    return rows.groupBy("k").applyInPandas(of, CORRECTIONS)
