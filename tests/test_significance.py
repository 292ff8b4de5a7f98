"""Tests of significance against enumeration and fixed values; the bootstrap against its own draws."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from ticklattice.functions import probability
from ticklattice.operators import evaluate


def test_signed_rank_distribution_is_that_of_all_signs():
    for n in (1, 2, 5, 9):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in (0, 1, n, n * (n + 1) // 4):
            assert probability.signed_rank_tail(n, w) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
    # Published two-sided 5 % limits of the smaller rank sum.
    for n, limit in ((6, 0), (7, 2), (8, 3), (9, 5), (10, 8), (12, 13), (15, 25), (20, 52), (25, 89)):
        assert probability.signed_rank_tail(n, limit) <= 0.05 < probability.signed_rank_tail(n, limit + 1)


def test_sign_test():
    assert probability.sign_tail(0, 0) == 1.0 and probability.sign_tail(5, 10) == 1.0
    assert probability.sign_tail(1, 8) == pytest.approx(2 * 9 / 256)


@pytest.mark.parametrize("tied", [False, True])
def test_wilcoxon_equals_ranking_in_one_place(spark, tied):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0.3, 1, 40), rng.normal(0, 1, 40)
    if tied:
        a, b = np.round(a), np.round(b)
    rows = [(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(1.0, 1.0), (None, 2.0), (3.0, None), (math.nan, 1.0)]
    got = evaluate.wilcoxon(spark.createDataFrame(rows, "a double, b double").repartition(3), "a", "b").first()
    d = (a - b)[a != b]
    size = np.abs(d)
    rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    assert (got["n"], got["w_plus"], got["w_minus"]) == (len(d), rank[d > 0].sum(), rank[d < 0].sum())
    ties = sum(t**3 - t for t in np.unique(size, return_counts=True)[1])
    n = len(d)
    z = (got["w_plus"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert got["z"] == pytest.approx(z)
    want = math.erfc(abs(z) / math.sqrt(2)) if tied else probability.signed_rank_tail(n, min(got["w_plus"], got["w_minus"]))
    assert got["p_value"] == pytest.approx(want)
    none = evaluate.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), "a", "b").first()
    assert none["n"] == 0 and none["p_value"] is None


def test_bootstrap_weights_have_mean_one_and_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k, k % 5 == 0, k % 7 < 2) for k in range(3000)] + [(9000, None, True)], "trade_id long, y boolean, pred boolean")
    one = sorted(map(tuple, evaluate.bootstrap(rows.coalesce(1), 300).collect()))
    assert one == sorted(map(tuple, evaluate.bootstrap(rows.repartition(7), 300).collect()))
    y, pred = np.arange(3000) % 5 == 0, np.arange(3000) % 7 < 2
    tp, fp, fn = (y & pred).sum(), (~y & pred).sum(), (y & ~pred).sum()
    sure = {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn)}
    n = {"precision": tp + fp, "recall": tp + fn, "f1": tp + (fp + fn) / 2}
    for metric, low, high in one:
        assert low < sure[metric] < high
        width = 2 * 1.96 * math.sqrt(sure[metric] * (1 - sure[metric]) / n[metric])
        assert 0.6 * width < high - low < 1.5 * width


def test_mann_whitney_of_more_rows_than_longs_hold_products_of(spark, monkeypatch):
    """2e6 true and 5e6 other rows: n1 * n2 * (n1 + n2 + 1) is beyond the longs."""
    counts = spark.createDataFrame([(2.0, 1_500_000, 1_000_000, 1_500_000, 1_000_000), (1.0, 500_000, 4_000_000, 2_000_000, 5_000_000)], "score double, pos long, neg long, tp long, fp long")
    monkeypatch.setattr(evaluate, "by_score", lambda rows: counts)
    got = evaluate.mann_whitney(None).first()
    u, n1, n2 = 1.5e6 * 1e6 / 2 + 4e6 * 1.5e6 + 4e6 * 5e5 / 2, 2_000_000, 5_000_000
    assert (got["u"], got["n1"], got["n2"]) == (u, n1, n2)
    assert got["z"] == pytest.approx((u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)) and 0 <= got["p_value"] <= 1
