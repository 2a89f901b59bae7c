"""Boosted trees of a series beside a plain version, and what the penalties and missing values do."""

import itertools
import math

import numpy as np
import pytest

from tallyspan.config import ModelSettings
from tallyspan.operators.series_trees import Trees, TreeSettings, best_split, tree_corrections


def _leaf(total, penalty):
    return math.copysign(max(abs(total) - penalty, 0), total)


def _plain_split(x, g, s):
    """Gain of every cut, one by one."""
    best = 0
    for column, missing_left in itertools.product(range(x.shape[1]), (False, True)):
        seen = sorted({v for v in x[:, column] if not math.isnan(v)})
        for a, b in itertools.pairwise(seen):
            left = [gi for gi, v in zip(g, x[:, column]) if (missing_left if math.isnan(v) else v < (a + b) / 2)]
            right = [gi for gi, v in zip(g, x[:, column]) if not (missing_left if math.isnan(v) else v < (a + b) / 2)]
            if min(len(left), len(right)) >= s.least_rows:
                score = [_leaf(sum(z), s.size_penalty) ** 2 / (len(z) + s.square_penalty) for z in (left, right, g)]
                best = max(best, (score[0] + score[1] - score[2]) / 2)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_split_gains_what_the_best_of_all_cuts_gains(seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(25, 4)), 1)
    x[draw.random(x.shape) < 0.2] = np.nan
    g = draw.normal(size=25) * 4
    s = TreeSettings(least_rows=1 + seed % 3)
    found = best_split(x, g, s)
    assert found.gain == pytest.approx(_plain_split(x, g, s))
    v = x[:, found.column]
    left = np.where(np.isnan(v), found.missing_left, v < found.threshold)
    score = [_leaf(z.sum(), 1) ** 2 / (len(z) + 1) for z in (g[left], g[~left], g)]
    assert (score[0] + score[1] - score[2]) / 2 == pytest.approx(found.gain)


def test_nothing_to_split():
    s = TreeSettings()
    assert best_split(np.full((4, 2), np.nan), np.array([5.0, -5, 5, -5]), s) is None
    assert best_split(np.ones((4, 2)), np.array([5.0, -5, 5, -5]), s) is None


def test_trees_learn_and_penalties_hold_back():
    x = np.column_stack([np.arange(60) % 6, np.full(60, np.nan)]).astype(float)
    y = np.where(x[:, 0] < 3, 10.0, -10.0)
    few = Trees(x, y, 1, TreeSettings(count=60))
    assert few.predict([1.0, math.nan]) == pytest.approx(10, abs=0.3) and few.predict([5.0, 2.0]) == pytest.approx(-10, abs=0.3)
    assert Trees(x, y, 1, TreeSettings(count=5, size_penalty=1e9)).predict([1.0, 0.0]) == y.mean()
    again = Trees(x, y, 1, TreeSettings(count=60))
    assert again.predict([2.0, 0.0]) == few.predict([2.0, 0.0])


def test_moved_rows_are_predicted_alike():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(40, 3))
    x[draw.random(x.shape) < 0.3] = np.nan
    y = draw.normal(size=40) * 5
    trees = Trees(x, y, 3, TreeSettings(count=300, rows=1.0, columns=1.0, size_penalty=0.0))
    assert max(abs(trees.predict(list(row)) - v) for row, v in zip(x, y, strict=True)) < 0.5


def test_corrections_of_each_series(spark):
    rows = [("wave", m, 8.0 if m % 4 < 2 else -8.0, True) for m in range(60) if m != 20]
    rows += [("early", m, 8.0 if m % 4 < 2 else -8.0, m > 4) for m in range(55)]
    rows += [("few", 58, 1.0, True), ("few", 59, 2.0, True), ("none", 59, None, None)]
    fitted = spark.createDataFrame(rows, "k string, m int, residual double, usable boolean")
    model = ModelSettings(horizon=8, lags=4)
    found = {(r["k"], r["h"]): r for r in tree_corrections(fitted, 59, model, TreeSettings(count=80)).collect()}
    assert {k for k, _ in found} == {"wave", "early", "few"} and len(found) == 24
    for k in ("wave", "early"):
        for h in range(1, 9):
            r = found[k, h]
            assert r["m"] == 59 + h and r["correction"] == pytest.approx(8 if r["m"] % 4 < 2 else -8, abs=1.5)
    assert all(found["few", h]["correction"] is None and found["few", h]["n_rows"] == 2 for h in range(1, 9))
