"""Operators over long series, cut into small parts, against loops over the whole series."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from ticklattice import registry
from ticklattice.functions import frames, quantiles, relay, scan, sliding
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.operators import cleaning

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=int(seconds))


def test_rows_that_repeat_at_block_edges_come_once(spark):
    """Groups of four equal (symbol, ts, tie), null ts and ties, null keys; with and without what marks a block's own rows."""
    rows = [("A", at(60 * (k // 4)), 7, float(k)) for k in range(400)] + [("A", None, 1, float(1000 + k)) for k in range(60)]
    rows += [(None, at(k), None, float(2000 + k)) for k in range(130)] + [("B", at(5), k, 3000.0 + k) for k in range(3)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, tie int, x double").repartition(5)
    for build in (lambda r: r.withColumn("y", F.col("x") + 1), lambda r: r.select("symbol", "ts", "tie", "x", (F.col("x") + 1).alias("y"))):
        got = frames.framed(df, build, tie="tie", before=20, after=10, block=50)
        assert got.columns == ["symbol", "ts", "tie", "x", "y"]
        assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted(rows, key=repr)
    assert frames.framed(df.limit(0), lambda r: r, block=600).count() == 0


def test_places_are_those_of_the_order(spark):
    rng = np.random.default_rng(1)
    rows = [("A", at(s), int(k)) for k, s in enumerate(np.cumsum(rng.integers(0, 3, 900) * rng.choice([1, 5000], 900)))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int").repartition(7)
    got = frames.numbered(df, tie="id", block=100).orderBy("id").collect()
    assert [r["__n"] for r in got] == list(range(900))


def sar(high, low, variant):
    """The recurrence in one loop, written out for both directions."""
    out, up, speed = [], True, 0.02
    value, extreme = (low[0], high[0]) if variant == "clamped" else (high[0], low[0])
    for k in range(len(high)):
        if k:
            value = value + speed * (extreme - value)
            if variant == "clamped":
                two = range(max(0, k - 2), k)
                value = min(value, *[low[j] for j in two]) if up else max(value, *[high[j] for j in two])
                if up and low[k] < value:
                    up, value, speed, extreme = False, extreme, 0.02, low[k]
                elif not up and high[k] > value:
                    up, value, speed, extreme = True, extreme, 0.02, high[k]
                elif up and high[k] > extreme:
                    extreme, speed = high[k], min(0.2, speed + 0.02)
                elif not up and low[k] < extreme:
                    extreme, speed = low[k], min(0.2, speed + 0.02)
            else:
                if up and high[k] > extreme:
                    extreme, speed = high[k], min(speed + 0.02, 0.2)
                if not up and low[k] < extreme:
                    extreme, speed = low[k], min(speed + 0.02, 0.2)
                if up and low[k] <= value:
                    up, value, speed, extreme = False, extreme, 0.02, low[k]
                elif not up and high[k] >= value:
                    up, value, speed, extreme = True, extreme, 0.02, high[k]
        out.append(value)
    return out


@pytest.mark.parametrize("variant", ["clamped", "plain"])
@pytest.mark.parametrize("warm", [1, 16])
def test_parabolic_sar_by_blocks_equals_the_loop(spark, variant, warm):
    """A walk with turns, a long trend without any, and a short series; few rows to guess from, so that guesses fail."""
    rng = np.random.default_rng(8)
    walk = np.round(100 + np.cumsum(rng.normal(0, 1, 700)), 2)
    series = {"A": (walk + 1, walk - 1), "B": (np.arange(500.0) + 2, np.arange(500.0)), None: (walk[:20] + 1, walk[:20] - 1)}
    rows = [(k, at(60 * j), float(h), float(x)) for k, (high, low) in series.items() for j, (h, x) in enumerate(zip(high, low, strict=True))]
    gap = ("A", at(60 * 100.5), None, 3.0)
    df = spark.createDataFrame([*rows, gap], "symbol string, ts timestamp_ntz, high double, low double").repartition(6)
    got = {(r["symbol"], r["ts"]): r["psar"] for r in I.psar(df, variant=variant, block=64, warm=warm).collect()}
    assert len(got) == len(rows) + 1 and got.pop(gap[:2]) is None
    for k, (high, low) in series.items():
        assert [got[k, at(60 * j)] for j in range(len(high))] == sar(high.tolist(), low.tolist(), variant)
    assert {(r["symbol"], r["ts"]): r["psar"] for r in I.psar(df.na.drop(subset=["high"]), variant=variant).collect()} == got


def test_known_values_cross_empty_parts(spark):
    rng = np.random.default_rng(3)
    values = [float(v) if rng.random() < 0.05 else None for v in rng.integers(0, 100, 600)]
    values[100:420] = [None] * 320
    rows = [("A", at(40 * k), k, v) for k, v in enumerate(values)] + [("B", at(k), k, None) for k in range(80)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id int, price double").repartition(4)
    got = scan.known(df, "price", tie="trade_id", rows=30).filter("symbol = 'A'").orderBy("trade_id").collect()
    for k, r in enumerate(got):
        back = next(((j, values[j]) for j in range(k, -1, -1) if values[j] is not None), None)
        ahead = next(((j, values[j]) for j in range(k, 600) if values[j] is not None), None)
        assert (r["__n"], r["__back"] and tuple(r["__back"]), r["__ahead"] and tuple(r["__ahead"])) == (k, back, ahead)
    filled = cleaning.fill_nearest(df, "price").filter("symbol = 'B'")
    assert filled.filter("forward is null and backward is null and linear is null").count() == 80


def test_known_values_of_several_columns_without_frames_to_the_end(spark):
    """A frame to the end of a part is gone through anew for each row: a part of 65,536 rows took two thousand million steps."""
    rows = [("A", at(40 * k), k, k if k % 7 == 0 else None, k if k % 11 == 5 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id int, x int, y int").repartition(3)
    both = scan.known(df, "x", "y", tie="trade_id", rows=30)
    for found in (both, scan.known(df, "x", tie="trade_id")):
        assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    value = lambda s: None if s is None else s["x"]
    nearest = lambda ks, ok: next((k for k in ks if ok(k)), None)
    for r in both.collect():
        k = r["trade_id"]
        for x, ok in (("x", lambda j: j % 7 == 0), ("y", lambda j: j % 11 == 5)):
            assert (value(r[f"__back_{x}"]), value(r[f"__ahead_{x}"])) == (nearest(range(k, -1, -1), ok), nearest(range(k, 300), ok))


def test_quantiles_by_key_with_large_keys_equal_those_in_one_place(spark):
    rng = np.random.default_rng(6)
    rows = [("A", float(v)) for v in rng.normal(0, 1e6, 900)] + [("B", float(v)) for v in rng.integers(-3, 3, 700)]
    rows += [("C", 1.5), ("C", -0.0), ("C", 0.0), ("D", None), (None, 4.0), (None, 5.0), ("A", math.nan), ("A", 5e-324), ("A", -1e308)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probs = {"low": 0.05, "mid": 0.5, "high": 0.99}
    got = {r[0]: r[1:] for r in quantiles.by_key(df, "k", "x", probs, large=500).collect()}
    for k in ("A", "B", "C", "D", None):
        x = [v for key, v in rows if key == k and v is not None and not math.isnan(v)]
        want = np.quantile(x, list(probs.values())) if x else [None] * 3
        assert got[k] == pytest.approx(tuple(want), rel=1e-12, nan_ok=True) if x else got[k] == (None, None, None)
    assert set(got) == {"A", "B", "C", "D", None}


def test_an_ordered_window_equals_sorting(spark):
    rng = np.random.default_rng(9)
    window, held = sliding.Ordered(), []
    for step in range(6000):
        x = float(rng.integers(0, 900))
        window.add(x), held.append(x)
        if len(held) > 1500:
            window.remove(held.pop(0))
        if step % 97 == 0:
            s = sorted(held)
            assert window.size == len(s) and [window[k] for k in (0, len(s) // 2, len(s) - 1)] == [s[0], s[len(s) // 2], s[-1]]
            assert window.counts(x) == (sum(v < x for v in s), s.count(x))
            assert window.quantile(0.37) == pytest.approx(np.quantile(s, 0.37))
    assert len(window.blocks) > 1 and sliding.Ordered().quantile(0.5) is None


def test_sliding_quantiles_and_ranks_with_gaps(spark):
    rng = np.random.default_rng(10)
    values = [None if rng.random() < 0.2 else math.nan if rng.random() < 0.1 else float(rng.integers(0, 9)) for _ in range(300)]
    rows = [(k, START, i, v) for k in ("A", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, x double").repartition(3)
    made = {"q": ("quantile", "x", 11, 0.3), "r": ("rank", "x", 11)}
    got = {(r["symbol"], r["id"]): (r["q"], r["r"]) for r in sliding.ordered(df, made, order=("ts", "id")).collect()}
    good = lambda v: v is not None and v == v
    for i, v in enumerate(values):
        inside = [w for w in values[max(0, i - 10) : i + 1] if good(w)]
        q = np.quantile(inside, 0.3) if inside else None
        others = [w for w in values[max(0, i - 10) : i] if good(w)]
        same = others.count(v)
        r = None if not good(v) else 50.0 if not others else (2 * sum(w < v for w in others) + same + (same > 0)) * 50.0 / len(others)
        for k in ("A", None):
            assert got[k, i] == (q if q is None else pytest.approx(q), r if r is None else pytest.approx(r))


FRAMES = """ti3_wma ti4_rsi ti6_bollinger ti7_stochastic ti8_atr ti9_adx ti10_cci ti12_momentum_roc ti15_ichimoku ti18_psar ti22_cmf ti27_all_indicators
rs1_rolling_statistics rs3_percentile_rank rs4_entropy rs6_j7_beta rs9_vol_of_vol rs14_distribution rs15_autocorrelation rs16_ljung_box rs19_feature_set
ti2_ema ti5_macd ti13_ti14_ti20_ti21_cumulative ti17_keltner rs8_garch
ad1_ad4_detectors ad5_outlier_3sigma ad6_correlation_breaks ad10_series_detectors dc1_dc3_fills dc2_linear_fill dc5_outliers_iqr dc10_dc11_clean_ticks
ti25_patterns rs21_streaks ad11_seasonal_residuals ml6_rolling_metrics pr2_risk ml11_mask_effect rs20_preparation fs3_training_table
j8_coverage j9_detection_delay dq2_dq3_dq4_dq6_assess st11_alerts st11_indicator_alerts""".split()


@pytest.mark.parametrize("name", FRAMES)
def test_registered_frames_by_small_blocks_equal_sql(spark, sf_dir, monkeypatch, name):
    """Series of the smallest tables are longer than these blocks, so every query runs in several."""
    monkeypatch.setattr(frames, "BLOCK", 128)
    monkeypatch.setattr(frames, "BEFORE", 125)
    monkeypatch.setattr(relay, "BLOCK", 128)
    monkeypatch.setattr(scan, "CHUNK", 16)
    monkeypatch.setattr(scan, "CHUNKS", 3)
    framed = frames.framed
    monkeypatch.setattr(frames, "framed", lambda df, build, **how: framed(df, build, **({"before": 125, "after": 64, "block": 128} | how)))
    oracle.check(registry.queries()[name](spark, sf_dir), oracle.connect(sf_dir), registry.oracle_sql()[name])


@pytest.mark.parametrize("rows", [40, 100_000])
def test_decayed_sums_over_many_chunks_and_parts(spark, monkeypatch, rows):
    """Three levels of carries, decays at both ends, a large old value that still shows, ties and a null ts."""
    monkeypatch.setattr(scan, "CHUNK", 16)
    monkeypatch.setattr(scan, "CHUNKS", 3)
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, 500)
    x[3] = 1e30
    data = [("A", None if k == 0 else at(60 * (k // 2)), k, float(v)) for k, v in enumerate(x)] + [(None, at(k), k, 1.0) for k in range(70)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, id int, x double").repartition(5)
    decays = {"none": 0.0, "short": 0.5, "long": 0.99, "sum": 1.0}
    got = scan.decayed_sums(df, {k: (F.col("x"), d) for k, d in decays.items()}, tie="id", rows=rows).collect()
    one = sorted((r for r in got if r["symbol"] == "A"), key=lambda r: r["id"])
    assert [r["__n"] for r in one] == list(range(500))
    for name, d in decays.items():
        y, want = 0.0, []
        for v in x:
            y = d * y + v
            want.append(y)
        assert np.allclose([r[name] for r in one], want, rtol=1e-9, atol=1e-9)
    assert sorted(r["sum"] for r in got if r["symbol"] is None) == list(range(1, 71))
    summed = scan.running_sums(df.filter("id <> 3"), {"s": F.col("x")}, tie="id", rows=rows).filter("symbol = 'A'").orderBy("id").collect()
    assert np.allclose([r["s"] for r in summed], np.cumsum(np.delete(x, 3)))
    ones = scan.ema(df, {"e": (F.col("x"), 1)}, tie="id", rows=rows).filter("symbol = 'A'").collect()
    assert all(r["e"] == r["x"] for r in ones)
    with pytest.raises(ValueError, match="decay"):
        scan.decayed_sums(df, {"y": (F.col("x"), 1.5)})


def test_the_cleaning_chain_reads_its_source_once(spark):
    """Numbering and quantiles ran the whole chain before them anew; what they read is written first."""
    ticks = spark.range(200).selectExpr("' a.us' as symbol", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "id as trade_id", "string(id) as size", "if(id % 9 = 0, null, double(id)) as price", "timestamp'2024-01-01' as ingested")
    found = cleaning.clean_ticks(ticks)
    assert "Range (" in ticks._jdf.queryExecution().optimizedPlan().toString() and "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["trade_id"]: r for r in found.collect()}
    assert len(rows) == 200 and rows[9]["price"] == pytest.approx(163 / 17) and rows[9]["data_cleaned"] and not rows[10]["data_cleaned"]
