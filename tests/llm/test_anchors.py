"""Vector codes against brute force; trees on clustered points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ticklattice.llm import anchors


def brute(vectors: np.ndarray, parts: int, entries: int, rounds: int):
    split = vectors.reshape(len(vectors), parts, -1)
    books = split[:entries].swapaxes(0, 1).copy()

    def near():
        return np.stack([((split[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        code = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = split[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    code = near()
    error = sum(((split[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    return books, code, error


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, shard int, error double").repartition(3)


def test_equals_brute_force_with_ties_repeats_and_short_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(700):
        v = rng.normal(size=12) if k % 3 else np.round(rng.normal(size=12))
        rows.append([k if k % 50 else k // 2, v.astype(np.float32).tolist(), None if k % 7 == 0 else k % 4, "x", 1, 0.5])
    for k in range(200):  # one vector, very often
        rows.append([2000 + k, [0.25] * 12, 1, "x", 1, 0.5])
    rows += [[3000, [1.0, -1.0], 2, "x", 1, 0.5], [3001, [], 2, "x", 1, 0.5], [None, [0.5] * 12, 2, "x", 1, 0.5]]
    bad = [[1, None, 1, "x", 1, 0.5], [2, [float("nan")] * 12, 1, "x", 1, 0.5], [3, [float("inf")] * 12, 1, "x", 1, 0.5], [4, [None] * 12, 1, "x", 1, 0.5]]
    coded, books = anchors.compress(table(spark, rows + bad), parts=4, entries=9, shard=150)
    found = anchors.with_label_error(coded).collect()

    whole = [np.pad(np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64), (0, 12 - len(r[1]))) for r in rows]
    by = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k].tolist()))
    want_books, code, error = brute(np.array([whole[k] for k in by]), 4, 9, 2)
    assert books.tolist() == want_books.tolist()
    labels = {}
    for k, e in zip(by, error.tolist(), strict=True):
        labels[rows[k][2]] = labels.get(rows[k][2], 0) + e
    want = [(rows[k][0], rows[k][2], c.astype(np.uint8).tobytes().hex(), e, labels[rows[k][2]]) for k, c, e in zip(by, code, error.tolist(), strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert anchors.digest(books) == anchors.digest(want_books)


def test_empty_and_few(spark):
    coded, books = anchors.compress(table(spark, [[1, None, None, "x", 1, 0.5]]))
    assert coded.count() == 0 and books.size == 0
    coded, books = anchors.compress(table(spark, [[7, [0.5] * 16, None, "x", 1, 0.5]]))
    assert anchors.with_label_error(coded).collect()[0][:] == (7, None, "00" * 16, 0, 0)


def test_a_ball_holds_its_points_and_their_sum():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-500, 500, (400, 3)), np.repeat([[3, 3, 3]], 300, axis=0)])
    tree = anchors.grow(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for a, b, center, radius, total in zip(tree.first, tree.last, tree.center, tree.radius, tree.total, strict=True):
        own = points[tree.order[a:b]]
        assert total.tolist() == own.sum(0).tolist() and (np.sqrt(((own - center) ** 2).sum(1)) <= radius + 1e-9).all()


def test_caches_settle_clustered_points():
    rng = np.random.default_rng(3)
    middles = rng.integers(-20000, 20000, (40, 4))
    points = np.repeat(middles, 100, axis=0) + rng.integers(-60, 60, (4000, 4))
    tree = anchors.grow(points)
    count, sums, code, cached = anchors.assign(tree, points, middles, each=True)
    assert code.tolist() == ((points[:, None] - middles) ** 2).sum(2).argmin(1).tolist()
    assert cached > 0.9 and count.sum() == len(points) and sums.sum(0).tolist() == points.sum(0).tolist()


def test_large_components_are_refused(spark):
    rows = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    try:
        anchors.compress(rows.withColumn("x", F.lit(1)))
    except Exception as e:  # noqa: BLE001 (Spark wraps what a task raises)
        assert "too large" in str(e)
    else:
        raise AssertionError("accepted")
