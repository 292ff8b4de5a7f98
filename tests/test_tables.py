"""Keyed tables of micro-batches: what a batch reads and writes, batches that run again, and old parts."""

from __future__ import annotations

from pathlib import Path

from ticklattice.operators.asof import latest
from ticklattice.streaming import tables

SCHEMA = "k long, v long, note string"


def size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("part-*.parquet"))


def test_a_batch_costs_as_much_after_many_batches(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["k"], parts=16)
    newest = lambda both: latest(both, ["k"], ["v"])
    want = {k: 0 for k in range(400)}
    table.update(spark.createDataFrame([(k, 0, "x" * 50) for k in want], SCHEMA), 0, newest)
    whole = size(tmp_path / "t" / "0")
    for b in range(1, 13):
        key = 7 * b % 400
        want[key] = b
        table.update(spark.createDataFrame([(key, b, "y"), (key, b - 1, "z")], SCHEMA), b, newest)
        # One part of sixteen is read and written, whatever came before.
        assert len(table.manifest()) == 16 and sum(x == b for x in table.manifest().values()) == 1
        assert size(tmp_path / "t" / str(b)) < whole / 4
    assert {r["k"]: r["v"] for r in table.read(SCHEMA).collect()} == want
    # A batch that runs again starts from the one before it.
    table.update(spark.createDataFrame([(84, 12, "again")], SCHEMA), 12, newest)
    assert {r["k"]: r["v"] for r in table.read(SCHEMA).collect()} == want
    assert {r["k"]: r["v"] for r in table.read(SCHEMA, before=1).collect()} == dict.fromkeys(want, 0)
    table.expire(keep=1)
    assert {r["k"]: r["v"] for r in table.read(SCHEMA).collect()} == want and table.batches() == [12]
    kept = [p for p in (tmp_path / "t").glob("*/__part=*")]
    assert len(kept) == 16


def test_an_empty_table_and_batch(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["k"])
    assert table.read(SCHEMA).count() == 0 and table.manifest() == {}
    table.update(spark.createDataFrame([], SCHEMA), 0, lambda both: both)
    assert table.read(SCHEMA).count() == 0
    table.update(spark.createDataFrame([(None, 1, None), (None, 2, None)], SCHEMA), 1, lambda both: tables.last_rows(both, "k", ("v",), 1))
    assert [tuple(r) for r in table.read(SCHEMA).collect()] == [(None, 2, None)]
