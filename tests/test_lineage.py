"""Reachability against breadth-first search."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import pytest

from ticklattice.operators import lineage


def graph(nodes, degree, seed):
    rng = random.Random(seed)
    return {(rng.randrange(k), k) for k in range(1, nodes) for _ in range(rng.randrange(degree + 1))}


def search(edges, root, depth):
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    seen, front = {root: 0}, [root]
    for d in range(1, depth + 1):
        front = [b for a in front for b in out[a] if b not in seen and not seen.update({b: d})]
    return seen


def test_named_roots_reach_what_a_search_does(spark):
    edges = graph(200, 2, 1) | {(5, 3), (3, 5)}  # a circle too
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    roots = spark.createDataFrame([(0,), (3,), (0,), (150,), (999,), (None,)], "node long")
    got = {(r["root"], r["node"]): r["distance"] for r in lineage.reachable(df, roots, 4).collect()}
    assert got == {(r, n): d for r in (0, 3, 150, 999) for n, d in search(edges, r, 4).items() if d}
    assert lineage.reachable(df.limit(0), roots, 4).count() == 0


@pytest.mark.parametrize("size", [32, 128])
def test_counts_of_all_nodes_by_sketches(spark, size):
    """Exact below the size; beyond, the error stays about one in its root."""
    edges = graph(1200, 3, 2)
    accesses = {k: k % 7 for k in range(1200)}
    rows = [(b, "computed", [a]) for a, b in edges] + [(k, "accessed", []) for k, n in accesses.items() for _ in range(n)] + [(k, "computed", []) for k in accesses]
    events = spark.createDataFrame(rows, "feature_id long, kind string, dependencies array<long>").selectExpr("*", "timestamp'2024-01-01' as ts")
    got = {r["feature_id"]: r for r in lineage.impact(events, 6, size=size).collect()}
    assert set(got) == set(accesses)
    errors = []
    for k in accesses:
        found = set(search(edges, k, 6)) - {k}
        assert got[k]["is_exact"] == (len(found) + 1 < size)
        if got[k]["is_exact"]:
            assert got[k]["dependents"] == len(found)
            assert got[k]["impact"] == pytest.approx(min((accesses[k] + sum(accesses[n] for n in found)) / 100, 10.0))
        else:
            errors.append(got[k]["dependents"] / len(found) - 1)
    assert len(errors) > 20 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 2 / size**0.5


def test_counts_of_all_nodes_are_exact_beyond_a_sketch(spark):
    """Circles, nodes that reach more than a sketch holds, and events of no feature."""
    edges = graph(900, 3, 4) | {(5, 3), (3, 5), (899, 0)}
    accesses = {k: k % 7 for k in range(900)}
    rows = [(b, "computed", [a]) for a, b in edges] + [(k, "accessed", []) for k, n in accesses.items() for _ in range(n)] + [(k, "computed", []) for k in accesses]
    events = spark.createDataFrame([*rows, (None, "accessed", [])], "feature_id long, kind string, dependencies array<long>").selectExpr("*", "timestamp'2024-01-01' as ts")
    got = {r["feature_id"]: (r["dependents"], r["impact"], r["is_exact"]) for r in lineage.impact_of_all(events, 6).collect()}
    assert got.pop(None) == (0, 0.01, True)
    found = {k: set(search(edges, k, 6)) - {k} for k in accesses}
    assert max(map(len, found.values())) > lineage.SKETCH
    assert got == {k: (len(f), pytest.approx(min((accesses[k] + sum(accesses[n] for n in f)) / 100, 10.0)), True) for k, f in found.items()}


@pytest.mark.parametrize("sizes", [{}, {"width": 64, "sources": 100, "sent": 3000}])
def test_counts_of_all_nodes_leave_no_pairs_on_disk(spark, sizes):
    """In one part and in many; an event counts once, whatever it was made from, and unknown nodes are nobody's."""
    edges = graph(500, 4, 7) | {(499, 0), (3, 3)} | {(k, 450) for k in range(450)}  # a circle, a loop, and a list that is cut
    rows = [(b, "computed", [a]) for a, b in edges] + [(k, "accessed", []) for k in range(500)]
    rows += [(7, "accessed", [1, 2, None, 2]), (8, "accessed", None), (9, "accessed", [None]), (5, "computed", [5000])]
    edges |= {(1, 7), (2, 7)}
    accesses = {k: 1 + (k in (7, 8, 9)) for k in range(500)}
    events = spark.createDataFrame(rows, "feature_id long, kind string, dependencies array<long>").selectExpr("*", "timestamp'2024-01-01' as ts")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("words-*"))
    for depth in (0, 1, 5):
        got = {r["feature_id"]: (r["dependents"], r["impact"]) for r in lineage.impact_of_all(events, depth, **sizes).collect()}
        found = {k: set(search(edges, k, depth)) - {k} for k in accesses}
        assert got == {k: (len(f), pytest.approx(min((accesses[k] + sum(accesses[n] for n in f)) / 100, 10.0))) for k, f in found.items()}
    assert set(shared.glob("words-*")) == before
    assert [tuple(r)[1:] for r in lineage.impact_of_all(events.limit(1).selectExpr("null::long as feature_id", "'accessed' as kind", "dependencies", "ts"), 5, **sizes).collect()] == [(0, 0.01, True)]
