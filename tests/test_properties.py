"""Properties and closed forms that SQL on the given tables doesn't show."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklattice.functions import frames, quantiles
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.functions import rolling as R
from ticklattice.functions import scan
from ticklattice.operators import anomaly, asof, bars, cleaning, drift, evaluate, forest, portfolio, validation
from ticklattice.sources import feeds, fixtures, sinks
from ticklattice.streaming import jobs

START = dt.datetime(2024, 1, 1)


def series(spark, values, symbol="A", step=3600):
    rows = [(symbol, START + dt.timedelta(seconds=step * k), float(v), float(v) + 1, float(v) - 1, float(v), 10) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").select(name).collect()]


@pytest.mark.parametrize("block", [70, 128, 1000])
def test_framed_windows_equal_those_over_whole_series(spark, block):
    """Blocks shorter than, as long as, and longer than the series; two symbols; nothing lost at the seams."""
    values = np.random.default_rng(4).normal(100, 5, 400)
    bars = series(spark, values).union(series(spark, values[::-1], "B", step=50_000)).union(series(spark, values[:3], None))
    made = {"mean": I.sma(n=50), "ahead": F.lead("close", 9).over(I.order()), "rsi": I.rsi()}
    want = bars.select("symbol", "ts", *[v.alias(k) for k, v in made.items()]).orderBy("symbol", "ts").collect()
    got = frames.framed(bars, lambda b: b.select("symbol", "ts", *[v.alias(k) for k, v in made.items()]), before=64, after=9, block=block)
    assert got.columns == ["symbol", "ts", *made] and got.orderBy("symbol", "ts").collect() == want
    with pytest.raises(ValueError):
        frames.framed(bars, lambda b: b, before=64, block=10)


def test_decayed_sums_of_uneven_parts_equal_the_recurrence(spark):
    """Parts of one row and of many, spans short and long."""
    rng = np.random.default_rng(5)
    step = np.concatenate([np.full(300, 600), rng.integers(1, 2_000_000, 200), np.full(600, 1800)])
    rows = [("A", START + dt.timedelta(seconds=int(s)), float(v), k) for k, (s, v) in enumerate(zip(np.cumsum(step), rng.normal(0, 1, len(step)), strict=True))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, id long")
    decays = {"short": 0.5, "mid": 0.9, "long": 0.999}
    got = scan.decayed_sums(frame, {k: (F.col("x"), d) for k, d in decays.items()}, tie="id").orderBy("id").collect()
    for name, d in decays.items():
        y, want = 0.0, []
        for r in rows:
            y = d * y + r[2]
            want.append(y)
        assert np.allclose([r[name] for r in got], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("adjust", [True, False])
def test_ema_of_a_long_series_equals_pandas(spark, adjust):
    values = np.random.default_rng(1).normal(100, 5, 700)
    got = column(scan.ema(series(spark, values), {"e": (F.col("close"), 12)}, adjust=adjust), "e")
    assert np.allclose(got, pd.Series(values).ewm(span=12, adjust=adjust).mean(), rtol=1e-9)


def test_running_sums_cross_parts(spark):
    values = list(range(500))
    got = column(scan.running_sums(series(spark, values), {"s": F.col("close")}), "s")
    assert got == list(np.cumsum(values))


def test_garch_equals_its_recurrence(spark):
    r = np.random.default_rng(2).normal(0, 0.02, 300)
    rows = series(spark, np.ones(300)).withColumn("ret", F.element_at(F.array(*map(F.lit, map(float, r))), F.row_number().over(I.order())))
    got = column(R.with_garch(rows, "ret"), "garch_vol")
    v = [np.var(r, ddof=1)]
    for x in r[:-1]:
        v.append(0.05 * v[0] + 0.1 * x * x + 0.85 * v[-1])
    assert np.allclose(got, np.sqrt(v), rtol=1e-9)


def test_psar_follows_a_trend(spark):
    up = column(I.psar(series(spark, range(10, 60))), "psar")
    low = np.arange(10, 60) - 1
    assert all(s <= x for s, x in zip(up, low, strict=True)) and up == sorted(up)


def test_rsi_bounds_and_flat_series(spark):
    rows = series(spark, np.random.default_rng(3).normal(50, 3, 60))
    got = [x for x in column(rows.withColumn("r", I.rsi()), "r") if x is not None]
    assert len(got) == 60 - 14 and all(0 <= x <= 100 for x in got)
    flat = series(spark, [5.0] * 20)
    assert set(column(flat.withColumn("r", I.rsi()), "r")) == {None}
    assert set(column(flat.withColumn("r", I.rsi(variant="dash")), "r")) == {None, 0.0}
    assert set(column(flat.withColumn("p", I.bollinger(n=5)["bb_position"]), "p")) == {None, 0.5}


def test_rollup_equals_direct_bars(spark, sf_dir):
    direct = bars.ohlcv(fixtures.trades(spark, sf_dir), "1 day").select("symbol", "window_start", "open", "high", "low", "close", "volume", "trade_count")
    coarse = bars.rollup(fixtures.bars(spark, sf_dir), F.date_trunc("day", "ts").cast("timestamp_ntz")).drop("vwap")
    assert direct.exceptAll(coarse.select(*direct.columns)).count() == 0
    b = fixtures.bars(spark, sf_dir)
    assert b.filter("low > open or low > close or high < open or high < close or vwap < low - 1e-9 or vwap > high + 1e-9").count() == 0


def test_no_drift_between_equals(spark):
    rows = spark.range(400).select(F.lit("x").alias("feature_id"), (F.col("id") % 2 == 0).alias("is_new"), F.floor(F.col("id") / 2).cast("double").alias("value"))
    got = drift.report(rows).first()
    assert got["ks"] == 0 and got["psi"] == 0 and got["wasserstein"] == 0 and not got["has_drift"] and got["ks_p"] == 1
    moved = rows.withColumn("value", F.when(F.col("is_new"), F.col("value") + 150).otherwise(F.col("value")))
    assert drift.report(moved).first()["severity"] == "high"


def test_as_of_ties_staleness_and_parts(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    spine = spark.createDataFrame([("A", at(0), 1), ("A", at(10), 2), ("A", at(60 * 24 * 20), 3), ("B", at(5), 4)], "symbol string, ts timestamp_ntz, k int")
    values = spark.createDataFrame([("A", at(10), 7.0), ("A", at(9), 6.0)], "symbol string, ts timestamp_ntz, v double")
    for part in (None, "7 days"):
        got = {r["k"]: r["v"] for r in asof.as_of(spine, values, columns=["v"], part=part).collect()}
        assert got == {1: None, 2: 7.0, 3: 7.0, 4: None}
    fresh = {r["k"]: r["v"] for r in asof.as_of(spine, values, columns=["v"], within="60 minutes").collect()}
    assert fresh == {1: None, 2: 7.0, 3: None, 4: None}


def test_bitemporal_ignores_what_was_not_known(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    spine = spark.createDataFrame([("A", at(10)), ("A", at(100))], "entity_id string, ts timestamp_ntz")
    known = spark.createDataFrame([("A", at(1), at(2), 1.0), ("A", at(5), at(50), 5.0), ("A", at(3), at(90), 3.0)], "entity_id string, event_ts timestamp_ntz, ingested timestamp_ntz, value double")
    assert [r["value"] for r in asof.bitemporal(spine, known).orderBy("ts").collect()] == [1.0, 5.0]


def test_auc_of_perfect_and_tied_scores(spark):
    rows = spark.createDataFrame([(i, float(i), i >= 5) for i in range(10)], "trade_id long, score double, y boolean")
    assert evaluate.ranking(rows).first()["roc_auc"] == 1.0
    assert evaluate.ranking(rows.withColumn("score", F.lit(1.0))).first()["roc_auc"] == 0.5
    assert evaluate.best_threshold(rows).first()["threshold"] == 5.0


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (600, 2)))] + [(600, 9.0, -9.0)]
    m = spark.createDataFrame(rows, "k long, a double, b double")
    got = forest.score(m, forest.grow(m, ["a", "b"], key="k"), ["a", "b"]).orderBy(F.desc("iforest_score")).first()
    assert got["k"] == 600 and 0.5 < got["iforest_score"] < 1


def test_fifo_lots(spark):
    at = lambda k: START + dt.timedelta(days=k)
    t = spark.createDataFrame([(1, 1, "BUY", 10.0, 2.0, at(0), 1), (1, 1, "BUY", 5.0, 4.0, at(1), 2), (1, 1, "SELL", 12.0, 5.0, at(2), 3)], "user long, symbol long, type string, qty double, price double, date timestamp_ntz, tx_id long")
    lots = portfolio.tax_lots(t, "2024-06-01").collect()
    assert [(r["tx_id"], r["left"], r["cost"], r["term"]) for r in lots] == [(2, 3.0, 12.0, "short")]


def test_repairs_and_severity(spark):
    b = spark.createDataFrame([("A", START, 5.0, 4.0, 6.0, 7.0, -3)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume int")
    r = cleaning.repair_bars(b).first()
    assert (r["high"], r["low"], r["volume"]) == (7.0, 4.0, 0)
    q = spark.createDataFrame([("A", 2.0, 1.0, 1.0), ("", 0.0, 1.0, 0.0), ("A", 1.0, 1.0, 5.0), ("A", 1.0, 1.05, 5.0)], "symbol string, bid double, ask double, bid_size double")
    assert [r["quality"] for r in validation.severity_report(q).collect()] == ["LOW", "QUESTIONABLE", "MEDIUM", "HIGH"]


def test_csv_error_budget_types_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,symbol,open,high,low,close,volume\n2024-01-01 00:00:00,A,1,2,0.5,1.5,10\n2024-01-01 00:01:00,A,x,2,0.5,1.5,10\n")
    schema = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume long"
    good, bad = feeds.read_csv(spark, str(tmp_path), schema)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        feeds.read_csv(spark, str(tmp_path), schema, most_bad=0)
    assert feeds.classify_header(["open", "high", "low", "close", "volume"]) == "bar"
    assert feeds.classify_header(["bid_price", "ask_price"]) == "quote" and feeds.classify_header(["x"]) == "unknown"


def test_sinks_round_trip(spark, tmp_path, sf_dir):
    t = fixtures.trades(spark, sf_dir)
    f = t.select(F.lit("f").alias("feature_id"), F.col("symbol").alias("entity_id"), F.col("ts").alias("event_ts"), F.col("price").alias("value"))
    sinks.write_features(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).filter("feature_id = 'f'").count() == t.count()
    sinks.compact(t, str(tmp_path / "c"), files=2, keep_from="2024-01-10")
    assert spark.read.parquet(str(tmp_path / "c")).count() == t.filter("ts >= '2024-01-10'").count()
    sinks.export(t.limit(3), str(tmp_path / "e"), "json")
    assert spark.read.json(str(tmp_path / "e")).count() == 3


def test_conform_flags_and_nulls(spark):
    rows = spark.createDataFrame([("1", "x"), (None, "2")], "a string, b string")
    got = [r["conform_errors"] for r in validation.conform(rows, {"a": ("int", False), "b": ("int", True), "c": ("string", True)}).collect()]
    assert got == [["b"], ["a"]]


def test_stream_tail_over_several_batches(spark, tmp_path):
    """Row frames see earlier batches: two files, one per trigger, give what one table gives."""
    from pyspark.sql import Window

    src, w = tmp_path / "src", Window.partitionBy("symbol").orderBy("ts", "trade_id").rowsBetween(-2, 0)
    rows = series(spark, range(20)).withColumn("trade_id", F.col("close").cast("long")).select("symbol", "ts", "trade_id", F.col("close").alias("price"))
    rows.filter("price < 10").coalesce(1).write.parquet(str(src))
    rows.filter("price >= 10").coalesce(1).write.mode("append").parquet(str(src))
    files = sorted(src.glob("*.parquet"), key=lambda p: rows.sparkSession.read.parquet(str(p)).agg(F.min("price")).first()[0])
    import os

    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + k * 100, 1_700_000_000 + k * 100))
    stream = jobs.table_stream(spark, str(src), "symbol string, ts timestamp_ntz, trade_id long, price double", files=1)
    run = jobs.with_tail(lambda d: d.withColumn("m", F.avg("price").over(w)), str(tmp_path / "out"), rows=3, inputs=["symbol", "ts", "trade_id", "price"])
    jobs.each_batch(stream, run, str(tmp_path / "ck"))
    got = {r["trade_id"]: r["m"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: float(np.mean(range(max(0, k - 2), k + 1))) for k in range(20)}


def test_annual_factor():
    assert math.isclose(I.ANNUAL**2, 252)


def test_csv_stream_takes_each_file_once(spark, tmp_path):
    src, schema = tmp_path / "in", "symbol string, price double"
    src.mkdir()
    (src / "a.csv").write_text("symbol,price\nA,1\nB,2\n")
    take = lambda: jobs.append(jobs.csv_stream(spark, str(src), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    take()
    (src / "b.csv").write_text("symbol,price\nC,3\n")
    take()
    take()
    assert sorted(r["symbol"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import os
    import time

    src = tmp_path / "late"
    at = lambda h: START + dt.timedelta(hours=h)
    for k, rows in enumerate([[("A", at(0), 1), ("A", at(10), 2)], [("A", at(11), 5)], [("A", at(1), 3), ("A", at(20), 4)]]):
        spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id long").coalesce(1).write.mode("append").parquet(str(src))
        new = max(src.glob("*.parquet"), key=os.path.getmtime)
        os.utime(new, (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))
    progress = jobs.Progress()
    spark.streams.addListener(progress)
    stream = jobs.table_stream(spark, str(src), "symbol string, ts timestamp_ntz, trade_id long", files=1, late="1 hour")
    counted = stream.groupBy("symbol", F.window("ts", "1 hour")).count().select("symbol", F.col("window.start").alias("s"), "count")
    jobs.append(counted, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    for _ in range(50):
        if sum(r[3] for r in progress.rows):
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert sum(r[2] for r in progress.rows) == 5 and sum(r[3] for r in progress.rows) == 1
    assert progress.table(spark).count() >= 3


def test_dead_letters_and_upserts_by_batch(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("A", START, 1.0), ("A", START, -1.0), ("B", START, 2.0)], "symbol string, ts timestamp_ntz, price double").coalesce(1).write.parquet(str(src))
    stream = jobs.table_stream(spark, str(src), "symbol string, ts timestamp_ntz, price double")
    jobs.each_batch(stream, jobs.keep_latest(str(tmp_path / "k"), ["symbol"], "price"), str(tmp_path / "c1"))
    assert sorted((r["symbol"], r["price"]) for r in spark.read.parquet(str(tmp_path / "k" / "0")).collect()) == [("A", 1.0), ("B", 2.0)]


def test_quantiles_are_exact_for_skewed_repeated_and_missing_values(spark):
    generator = np.random.default_rng(5)
    columns = {"skewed": np.exp(generator.normal(0, 6, 3000)), "ties": generator.integers(0, 3, 3000).astype(float), "one": np.full(3000, 2.5), "none": np.full(3000, np.nan)}
    columns["skewed"][::7] = np.nan
    rows = [tuple(None if np.isnan(v) and k % 14 else float(v) for v in row) for k, row in enumerate(zip(*columns.values(), strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in columns))
    probs = [0.0, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = quantiles.quantiles(df, {n: n for n in columns}, probs)
    assert got.pop("none") == [None] * len(probs)
    for n, values in got.items():
        assert np.allclose(values, np.nanquantile(columns[n], probs), rtol=1e-12)
    assert quantiles.quantiles(df.limit(0), {"x": "one"}, probs) == {"x": [None] * len(probs)}


def test_parameters_of_a_matrix_see_every_feature_and_survive_constants(spark):
    rows = [(k, float(k % 5), 1.0, 100.0 if k == 7 else float(k % 3)) for k in range(40)]
    m = spark.createDataFrame(rows, "k long, a double, b double, last double")
    names = ["a", "b", "last"]
    top = anomaly.score_params(m, anomaly.fit_params(m, names), names).orderBy(F.desc("z_score")).first()
    assert top["k"] == 7 and top["z_score"] > 5 and top["iqr_score"] > 10
    pairs = {(r["a"], r["b"]): r["corr"] for r in evaluate.correlations(m, names).collect()}
    assert len(pairs) == 3 and pairs["a", "b"] is None and abs(pairs["a", "last"]) < 1


def test_indicator_state_is_carried_across_batches(spark, tmp_path):
    draw = random.Random(3)
    schema = "symbol string, ts timestamp, trade_id long, price double, size long"
    rows = [(draw.choice("AB"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randint(0, 40) + 41 * (k // 60)), k, float(draw.randint(1, 9)), draw.randint(1, 50)) for k in range(180)]
    rows.sort(key=lambda r: (r[1], r[2]))
    run, cuts = jobs.indicator_state(str(tmp_path / "state")), [0, 61, 61, 130, 180]  # one batch is empty
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = spark.createDataFrame(rows[lo:hi], schema)
        run(batch, k)
    run(batch, k)  # a batch that runs again changes nothing
    state, want = {}, {}
    for symbol, _, trade_id, price, size in rows:
        ema, obv, last = state.get(symbol, (price, 0.0, price))
        if symbol in state:
            ema, obv = ema * 11 / 13 + price * 2 / 13, obv + size * ((price > last) - (price < last))
        state[symbol] = (ema, obv, price)
        want[trade_id] = (ema, obv)
    got = {r["trade_id"]: (r["ema"], r["obv"]) for r in spark.read.parquet(str(tmp_path / "state" / "out")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_silver_parses_each_message_once(spark, sf_dir):
    """Its filter stays behind the parse: pushed before it, the messages would be made and parsed again for each flag."""
    from ticklattice.plans import q_feeds

    plan = q_feeds.silver(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("from_json" in line or "StructsToJson" in line for line in filters)
