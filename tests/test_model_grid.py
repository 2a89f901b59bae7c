"""The full grid of orders and of residual networks beside plain least squares."""

import numpy as np
import pytest

from tallyspan.operators import model_grid
from tallyspan.operators.model_grid import Grid

SEASON, TEST = 12, 12


def _rows():
    draw = np.random.default_rng(4)
    rows = []
    for k, holes in (("a", ()), ("b", (30, 31, 77))):
        y = 50 + 10 * np.sin(np.arange(132) * 2 * np.pi / 12) + np.cumsum(draw.normal(size=132)) + draw.normal(size=132)
        for m, v in enumerate(y):
            if m not in holes:
                part = "test" if m >= 120 else "validation" if m >= 108 else "train"
                rows.append((k, m, float(v), part))
    rows += [("short", m, 1.0, "train" if m < 20 else "validation") for m in range(25)]
    rows += [("unseen", 5, 1.0, "validation"), ("flat", 0, None, "train")]
    rows += [("flat", m, 7.0, "train" if m < 108 else "validation") for m in range(1, 120)]
    return rows


@pytest.fixture(scope="module")
def split(spark):
    return spark.createDataFrame(_rows(), "k string, m bigint, y double, split string").cache()


@pytest.fixture(scope="module")
def fitted(split):
    return split.sparkSession.createDataFrame(model_grid.fit_grid(split).collect(), model_grid.FITTED)


def _plain(k, order):
    """The same regression on whole columns, without sums."""
    p, d, q, sp, sd, sq = order
    y = np.full(108, np.nan)
    for key, m, v, part in _rows():
        if key == k and part == "train" and v is not None:
            y[m] = v

    def lag(x, i):
        return np.concatenate([np.full(i, np.nan), x[:-i]])

    def columns(d, sd):
        w = y - lag(y, 1) if d else y
        w = w - lag(w, 12) if sd else w
        first = np.column_stack([np.ones(108), lag(w, 1), lag(w, 2), lag(w, 3), lag(w, 12)])
        ok = np.isfinite(first).all(1) & np.isfinite(w)
        e = np.full(108, np.nan)
        e[ok] = w[ok] - first[ok] @ np.linalg.lstsq(first[ok], w[ok], rcond=None)[0]
        return w, np.column_stack([np.ones(108), lag(w, 1), lag(w, 2), lag(w, 12), lag(e, 1), lag(e, 2), lag(e, 12)])

    ok = np.ones(108, bool)
    for a in (0, 1):
        for b in (0, 1):
            w, x = columns(a, b)
            ok &= np.isfinite(x).all(1) & np.isfinite(w)
    w, x = columns(d, sd)
    at = ([0] if not d and not sd else []) + [1, 2][:p] + ([3] if sp else []) + [4, 5][:q] + ([6] if sq else [])
    rest = w[ok] - (x[ok][:, at] @ np.linalg.lstsq(x[ok][:, at], w[ok], rcond=None)[0] if at else 0)
    return int(ok.sum()), len(at) + 1, ok.sum() * np.log(rest @ rest / ok.sum()) + 2 * (len(at) + 1)


def test_every_order_is_fitted_as_by_plain_least_squares(fitted):
    rows = {(r["k"], r["candidate"]): r for r in fitted.collect()}
    assert len(rows) == 5 * 144
    grid = Grid()
    for k in ("a", "b"):
        for order in grid.orders():
            r = rows[k, grid.name(order)]
            n, parameters, aic = _plain(k, order)
            assert (r["n"], r["parameters"]) == (n, parameters) and r["aic"] == pytest.approx(aic, abs=1e-5)
            assert r["status"] in ("available", "unstable") and (r["forecast"] is None) == (r["status"] != "available")
            assert r["forecast"] is None or len(r["forecast"]) == 12 and r["last_m"] == 107
    assert {r["status"] for (k, _), r in rows.items() if k in ("short", "unseen")} == {"few_rows"}


def test_orders_without_regressors_repeat_what_differencing_says(fitted):
    values = {(k, m): v for k, m, v, part in _rows() if part == "train"}
    paths = {r["candidate"]: r["forecast"] for r in fitted.filter("k = 'a'").collect()}
    assert paths["(0,0,0)(0,1,0)12"] == pytest.approx([values["a", m] for m in range(96, 108)])
    drift = [values["a", 107] + values["a", 96 + h] - values["a", 95] for h in range(12)]
    assert paths["(0,1,0)(0,1,0)12"] == pytest.approx(drift)


def test_shortlist_has_the_ten_of_lowest_criterion_and_their_errors(split, fitted):
    listed = model_grid.shortlist(fitted, split).filter("k = 'b'").collect()
    best = sorted((round(r["aic"], 6), r["candidate"]) for r in fitted.filter("k = 'b' and status = 'available'").collect())[:10]
    assert sorted((r["aic"], r["candidate"]) for r in listed) == best and sorted(r["place"] for r in listed) == list(range(1, 11))
    held = [v for k, m, v, part in _rows() if k == "b" and part == "validation"]
    paths = {r["candidate"]: r["forecast"] for r in fitted.filter("k = 'b'").collect()}
    for r in listed:
        e = np.array(held) - np.maximum(0, paths[r["candidate"]])
        assert (r["rmse"], r["mae"]) == (pytest.approx(np.sqrt((e * e).mean()), abs=2e-6), pytest.approx(np.abs(e).mean(), abs=2e-6))


def test_residual_settings_have_every_seed_and_are_repeatable(split, spark):
    winners = spark.createDataFrame([("a", "(1,0,1)(1,0,0)12"), ("b", "(0,1,1)(0,1,0)12")], "k string, candidate string")
    corrected = model_grid.correct_grid(split, winners).collect()
    assert len(corrected) == 2 * 96 * 3 and corrected == model_grid.correct_grid(split, winners).collect()
    rows = spark.createDataFrame(corrected, model_grid.CORRECTED)
    scores = model_grid.residual_scores(rows, split).collect()
    assert len(scores) == 2 * 96 and {r["n_seeds"] for r in scores} == {3}
    # b has holes: a deep setting has too few examples and is refused with all its seeds.
    assert all((r["rmse"] is None) == (not r["all_ok"]) for r in scores)


def test_a_network_solves_its_ridge_regression():
    draw = np.random.default_rng(8)
    residuals = draw.normal(size=90)
    n, paths = model_grid._network(residuals, 4, 8, 2, (0.1, 1e9), 5)
    assert n == 86 and len(paths[0]) == 5
    assert np.abs(paths[1]).max() < 1e-6  # a heavy penalty leaves no correction
    assert model_grid._network(residuals[:9], 4, 8, 2, (0.1,), 5) == (5, [None])


def test_selection_names_a_model_or_the_reason(split):
    rows = {r["k"]: r for r in model_grid.select_models(split).collect()}
    assert set(rows) == {"a", "b", "short", "unseen", "flat"}
    for k in ("a", "b"):
        assert rows[k]["status"] == "selected" and rows[k]["lock_id"] and rows[k]["helps"] == (rows[k]["hybrid_rmse"] < rows[k]["base_rmse"])
    assert rows["short"]["status"] == rows["unseen"]["status"] == "no_candidate" and rows["short"]["lock_id"] is None
