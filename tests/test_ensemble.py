"""Nearest neighbours against a full comparison; weights and selection of detectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.operators import ensemble, neighbours


@pytest.mark.parametrize(("pivots", "block"), [(1, 7), (40, 16), (256, 4096)])
def test_neighbours_equal_a_full_comparison(spark, monkeypatch, pivots, block):
    """Clusters, repeated points, a far query, nulls; few points a block and few queries a share."""
    monkeypatch.setattr(neighbours, "SHARE", 50)
    rng = np.random.default_rng(5)
    points = np.concatenate([np.round(rng.normal(m, 1, (60, 2)), 1) for m in (0, 20, 50)] + [np.full((40, 2), 3.0)])
    queries = np.concatenate([rng.normal(10, 20, (150, 2)), [[1e6, -1e6], [3.0, 3.0]]])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "point_id long, a double, b double")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(queries)] + [(900, None, 1.0)], "query_id long, a double, b double")
    got = neighbours.nearest(q.repartition(3), p.repartition(4), ["a", "b"], 5, pivots=pivots, block=block).collect()
    d = ((queries[:, 0, None] - points[:, 0]) ** 2) + ((queries[:, 1, None] - points[:, 1]) ** 2)
    want = {(i, r): (int(j), d[i, j]) for i in range(len(queries)) for r, j in enumerate(np.lexsort((np.arange(len(points)), d[i]))[:5], 1)}
    assert {(r["query_id"], r["rank"]): (r["point_id"], r["distance"]) for r in got} == want
    assert neighbours.nearest(q, p.limit(0), ["a", "b"], 5).count() == 0
    assert neighbours.nearest(q.limit(1), p.limit(2), ["a", "b"], 5).count() == 2


def test_a_detector_is_trusted_where_it_was_right(spark):
    """One is right on the left, the other on the right; the split between validation and judged rows is kept."""
    rows = [(k, k + 1, float(x), bool(y), (x < 0) == y, (x >= 0) == y) for k, (x, y) in enumerate((x, y) for x in np.linspace(-10, 10, 200) for y in (True, False))]
    df = spark.createDataFrame([(k, n, x, y, y if a else not y, y if b else not y) for k, n, x, y, a, b in [(r[0], r[1], r[2], r[3], r[2] < 0, r[2] >= 0) for r in rows]], "trade_id long, position long, x double, y boolean, one boolean, two boolean")
    weights = ensemble.auto_weights(df, ["one", "two"])
    assert sum(weights.values()) == pytest.approx(1)
    judged = spark.createDataFrame([(1000, -8.0, True, False), (1001, 8.0, True, False), (1002, None, True, False)], "trade_id long, x double, one boolean, two boolean")
    got = {r["trade_id"]: (r["dynamic_score"], r["n_selected"]) for r in ensemble.select(judged, df, ["one", "two"], ["x"], weights, k=9).collect()}
    assert got[1000] == (1.0, 1) and got[1001] == (0.0, 1) and got[1002] == (pytest.approx(weights["one"]), 2)
    alone = {r["trade_id"]: r["n_selected"] for r in ensemble.select(judged, df.limit(0), ["one", "two"], ["x"], weights).collect()}
    assert set(alone.values()) == {2}
    assert ensemble.auto_weights(df.limit(0), ["one", "two"]) == {"one": 0.5, "two": 0.5}


def test_weights_are_mean_f1_of_parts(spark):
    df = spark.createDataFrame([(k, k + 51, k % 3 == 0, k % 2 == 0, False) for k in range(60)], "trade_id long, position long, y boolean, one boolean, none boolean")
    f1 = []
    for part in (range(20), range(20, 40), range(40, 60)):
        tp = sum(k % 6 == 0 for k in part)
        f1.append(2 * tp / (sum(k % 2 == 0 for k in part) + sum(k % 3 == 0 for k in part)))
    one = np.mean(f1)
    assert ensemble.auto_weights(df.withColumn("x", F.lit(1)), ["one", "none"])["one"] == pytest.approx(one / (one + 0.1))


def test_repeated_points_and_rows_are_searched_once(spark, monkeypatch):
    """Of 3000 points at 6 places no more than k of a place are kept, and 500 rows at 5 places make 5 queries."""
    sizes, written = {}, neighbours.folders.written

    def spy(df, name):
        out = written(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(neighbours.folders, "written", spy)
    points = spark.createDataFrame([(k, k + 1, float(k % 6), k % 2 == 0, k % 3 == 0) for k in range(3000)], "trade_id long, position long, x double, y boolean, one boolean")
    rows = spark.createDataFrame([(5000 + k, float(k % 5), k % 2 == 0) for k in range(500)], "trade_id long, x double, one boolean")
    got = ensemble.select(rows, points, ["one"], ["x"], {"one": 1.0}, k=7).collect()
    assert len(got) == 500 and sizes["points"] == 42 and sizes["regions"] == 5
    near = neighbours.nearest(rows.limit(1).withColumnRenamed("trade_id", "query_id"), points.withColumnRenamed("trade_id", "point_id"), ["x"], 7).orderBy("rank").collect()
    assert len({r["distance"] for r in near}) == 1 and [r["point_id"] for r in near] == list(range(near[0]["point_id"], near[0]["point_id"] + 42, 6))
