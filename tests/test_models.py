"""Fitted detectors against the same computation in one place."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from ticklattice.operators import forest

START = dt.datetime(2024, 1, 1)


def test_forest_scores_follow_each_tree_from_its_root(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), [[9, 9, 9]]])
    m = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double, d double").repartition(4)
    nodes = forest.grow(m, ["a", "b", "d"], key="k", trees=12, sample=64)
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    assert len(trees) == 12
    scored = forest.score(m, nodes, ["a", "b", "d"], sample=64)
    got = {r["k"]: r["iforest_score"] for r in scored.collect()}
    for k in (*range(0, 300, 37), 300):
        total = 0.0
        for tree in trees.values():
            node = tree[0]
            while node["feature"] >= 0:
                node = tree[node["left"] if x[k][node["feature"]] < node["cut"] else node["right"]]
            total += node["depth"]
        assert got[k] == pytest.approx(2 ** (-total / 12 / forest.path_length(64)))
    assert max(got, key=got.get) == 300
    bounds = forest.score_bounds(scored)
    share = {r["k"]: r["iforest_share"] for r in forest.normalised(scored, bounds).collect()}
    assert min(share.values()) == 0 and share[300] == 1 and share[5] == pytest.approx((got[5] - bounds[0]) / (bounds[1] - bounds[0]))
    assert {r["iforest_share"] for r in forest.normalised(scored, (bounds[1], bounds[1])).collect()} == {0.0}
    assert {r["iforest_share"] for r in forest.normalised(scored, (-1.0, -0.5)).collect()} == {1.0}


def test_sequence_errors_equal_those_of_the_first_components(spark):
    rng = np.random.default_rng(2)
    closes = {"A": 100 + np.cumsum(rng.normal(0, 1, 90)), "B": 50 + 5 * np.sin(np.arange(80) / 5)}
    closes["B"][40] += 30
    rows = [(s, START + dt.timedelta(hours=k), float(v)) for s, x in closes.items() for k, v in enumerate(x)]
    got = {(r["symbol"], r["ts"]): (r["error"], r["is_anomaly"]) for r in forest.sequence_errors(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), n=12, parts=3).collect()}
    windows = {(s, START + dt.timedelta(hours=k)): x[k - 11 : k + 1] - x[k - 11 : k + 1].mean() for s, x in closes.items() for k in range(11, len(x))}
    v = np.array(list(windows.values()))
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :3]
    error = ((v - v @ axes @ axes.T) ** 2).mean(1)
    edge = np.quantile(error, 0.95)
    assert set(got) == set(windows)
    for key, e in zip(windows, error, strict=True):
        assert got[key][0] == pytest.approx(e, rel=1e-6, abs=1e-9)
        if abs(e - edge) > 1e-6:
            assert got[key][1] == (e > edge)


def test_stacking_is_the_logistic_fit_of_the_training_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 2))
    y = rng.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 4 * x[:, 1])))
    rows = [(k, float(a), float(b), bool(t), "train" if k < 300 else "test") for k, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    got = {r["k"]: r["stacked_score"] for r in forest.stack(spark.createDataFrame(rows, "k int, a double, b double, y boolean, split string"), ["a", "b"]).collect()}
    one, w = np.column_stack([x[:300], np.ones(300)]), np.zeros(3)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-one @ w))
        w = w + np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]), one.T @ (y[:300] - p))
    want = 1 / (1 + np.exp(-np.column_stack([x, np.ones(400)]) @ w))
    assert all(math.isclose(got[k], want[k], abs_tol=2e-3) for k in range(400))
