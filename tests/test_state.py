"""Keyed state of a stream: timers of silent symbols, late bars, and the state read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests import oracle
from ticklattice import registry
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.streaming import jobs, state

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BARS = "symbol string, ts timestamp, close double, high double, low double"


def bar(symbol, minute, close):
    return symbol, START + dt.timedelta(minutes=minute), close, close + 1, close - 1


def test_timers_late_bars_and_state_read_back(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("bars", "out", "checkpoint"))
    batches = [
        [bar("A", 0, 10.0), bar("A", 2, 12.0), bar("A", 1, 11.0), bar("B", 0, 5.0), ("A", None, 1.0, 2.0, 3.0)],
        # Within the watermark but not after the last bar: counted.  No close: counted.
        [bar("A", 3, 9.0), bar("A", 2, 99.0), ("A", START + dt.timedelta(minutes=4), None, 1.0, 1.0)],
        [bar("A", 500, 20.0)],
        [bar("A", 501, 21.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "10 minutes")
        state.run(stream, out, checkpoint, idle_s=3600)
    found = spark.read.schema(state.OUT).parquet(out).orderBy("symbol", "ts", "kind").collect()
    minute = lambda r: int((r["ts"].astimezone(dt.timezone.utc) - START).total_seconds() // 60)
    assert [(r["symbol"], minute(r), r["kind"]) for r in found if r["symbol"] == "B"] == [("B", 0, "bar"), ("B", 0, "idle")]
    kinds = [(minute(r), r["kind"]) for r in found if r["symbol"] == "A"]
    assert kinds[:4] == [(0, "bar"), (1, "bar"), (2, "bar"), (3, "bar")] and (500, "bar") in kinds and (501, "bar") in kinds
    assert max(r["late"] for r in found if r["symbol"] == "A") == 2
    assert all(r["garch_vol"] is None for r in found)
    # The same values as the batch operator over the bars that count.
    counted = spark.createDataFrame([bar("A", m, x) for m, x in ((0, 10.0), (1, 11.0), (2, 12.0), (3, 9.0))], BARS).withColumns({"open": F.col("close"), "volume": F.lit(1)})
    want = [r["macd"] for r in I.with_macd(counted).orderBy("ts").collect()]
    got = [r["macd"] for r in found if r["symbol"] == "A" and r["kind"] == "bar"][:4]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    held = {r["symbol"]: r for r in state.read_state(spark, checkpoint).collect()}
    assert set(held) == {"A"} and held["A"]["close"] == 21.0


def test_layers_count_trades_that_silver_doubts(spark, tmp_path):
    """A price of 0 is outside of what silver takes for good; the bars of the query are those of all trades."""
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    rows = [(k, at(k), k % 3, "view" if k % 2 else "click", 0.0 if k == 7 else 5.25 + k, f'{{"k": {k}}}') for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    oracle.check(registry.queries()["st8_layers"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), registry.oracle_sql()["st8_layers"])


def test_steps_of_a_micro_batch_read_what_the_one_before_wrote(spark, tmp_path, monkeypatch):
    """Each step reads its rows several times, so steps over steps ran the first one many times over."""
    plans = []
    for name in ("decayed_sums", "running_sums"):
        step = getattr(jobs.scan, name)
        monkeypatch.setattr(jobs.scan, name, lambda df, *a, step=step, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or step(df, *a, **k))
    rows = spark.createDataFrame([("A", START + dt.timedelta(minutes=k), k, 1.0 + k % 3, 2) for k in range(40)], "symbol string, ts timestamp, trade_id long, price double, size long")
    run = jobs.indicator_state(f"file://{tmp_path}")
    run(rows.limit(20), 0), run(rows.filter("trade_id >= 20"), 1)
    assert len(plans) == 4 and not any("Window" in p or "Join" in p for p in plans)
    out = spark.read.parquet(f"file://{tmp_path}/out").orderBy("trade_id").collect()
    assert len(out) == 40 and out[-1]["obv"] == sum((2 if k % 3 else -2) for k in range(1, 40))
