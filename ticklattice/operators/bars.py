"""Bars and windowed metrics of trades and quotes: one tumbling-window aggregation each, combined map-side.

The same functions serve streams with a watermark, where ``exact=False`` takes approximate quantiles and distinct counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.functions import folders

TIMEFRAMES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def bar_states(trades: DataFrame, duration: str, *, key: str = "symbol", ts: str = "ts", tie: str = "trade_id") -> DataFrame:
    """What a bar per key and window needs and what a coarser one can be made from: first, last and extreme prices, sums, and the
    prices' count, mean and sum of squares about it.  First and last are by (ts, tie), so nothing depends on the order of rows."""
    order = F.struct(ts, tie)
    out = trades.groupBy(key, F.window(ts, duration).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.count("price").alias("priced"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count("price")).alias("squares"),
        F.sum(F.col("price") * F.col("size")).alias("value_traded"),
    )
    return out.select(key, "w.*", *[x for x in out.columns if x not in (key, "w")])


def coarser_states(states: DataFrame, duration: str, *, key: str = "symbol") -> DataFrame:
    """States of windows that hold whole windows of ``states``; squares are merged pair by pair about the common mean.

    A window gathers as many small rows as it holds finer windows.
    """
    parts = F.sort_array(F.collect_list(F.when(F.col("priced") > 0, F.struct("start", F.col("priced").alias("n"), "mean", "squares"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def merge(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        squares = a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), squares.alias("squares"))

    out = states.groupBy(key, F.window("start", duration).alias("w")).agg(
        F.min_by("open", "start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.sum("value_traded").alias("value_traded"), parts.alias("parts"),
    )
    all_ = F.aggregate("parts", zero, merge)
    out = out.withColumn("all", F.when(F.size("parts") > 0, all_))
    return out.select(
        key, "w.*", "open", "high", "low", "close", "volume", "trade_count", F.coalesce("all.n", F.lit(0)).alias("priced"), F.col("all.mean").alias("mean"),
        F.col("all.squares").alias("squares"), "value_traded",
    )


def bars_of(states: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Open, high, low, close, volume, count, mean, deviation, traded value, vwap, change and range of each state."""
    return states.select(
        key, F.col("start").alias("window_start"), F.col("end").alias("window_end"), "open", "high", "low", "close", "volume", "trade_count",
        F.col("mean").alias("avg_price"), F.when(F.col("priced") > 1, F.sqrt(F.col("squares") / (F.col("priced") - 1))).alias("price_stddev"), "value_traded",
        F.try_divide("value_traded", "volume").alias("vwap"), _share(F.col("close") - F.col("open"), F.col("open")).alias("change_pct"),
        (F.col("high") - F.col("low")).alias("range"), _share(F.col("high") - F.col("low"), F.col("low")).alias("range_pct"),
    )


def ohlcv(trades: DataFrame, duration: str, *, key: str = "symbol", ts: str = "ts", tie: str = "trade_id") -> DataFrame:
    """Bars per key and window, in one aggregation combined map-side."""
    return bars_of(bar_states(trades, duration, key=key, ts=ts, tie=tie), key=key)


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(duration: str) -> int:
    n, unit = duration.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def ohlcv_timeframes(trades: DataFrame, timeframes: dict[str, str] | None = None) -> DataFrame:
    """Bars of several timeframes in one table, tagged by ``timeframe``, from one scan and one shuffle of the trades.

    The finest timeframe's states are written; those that it divides are made from that table, any other from the trades.
    """
    finest, *rest = sorted((timeframes or TIMEFRAMES).items(), key=lambda x: _seconds(x[1]))
    states = folders.written(bar_states(trades, finest[1]), "bar-states")
    made = [(finest[0], states)]
    for name, d in rest:
        made.append((name, bar_states(trades, d) if _seconds(d) % _seconds(finest[1]) else coarser_states(states, d)))
    return reduce(DataFrame.unionByName, [bars_of(x).withColumn("timeframe", F.lit(name)) for name, x in made])


def ohlcv_seconds(trades: DataFrame, seconds: tuple[int, ...] = (60, 300, 900, 3600)) -> DataFrame:
    """Epoch-aligned bars of several lengths from one scan: each trade meets every length once."""
    start = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, floor(unix_micros(cast(ts as timestamp)) / 1000000 / s) * s)")
    rows = trades.withColumn("s", F.explode(F.array(*map(F.lit, seconds)))).withColumn("window_start", start)
    order = F.struct("ts", "trade_id")
    return rows.groupBy("symbol", "window_start", F.concat(F.col("s").cast("string"), F.lit("s")).alias("timeframe")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )


def rollup(bars: DataFrame, start: Column) -> DataFrame:
    """Coarser bars from finer ones (symbol, ts, open ... vwap, trade_count); vwap comes from sums, not from vwaps."""
    return bars.groupBy("symbol", start.alias("window_start")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
        F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )


def quote_metrics(quotes: DataFrame, duration: str, *, tight_bps: float = 10.0) -> DataFrame:
    """Bid, ask, spread and mid statistics per symbol and window; a quote with bid <= 0 has no spread."""
    mid = (F.col("bid") + F.col("ask")) / 2
    bps = F.when(F.col("bid") > 0, F.try_divide(F.col("ask") - F.col("bid"), mid) * 10000)
    rows = quotes.select("symbol", "ts", "quote_id", "bid", "ask", mid.alias("mid"), bps.alias("bps"))
    order = F.struct("ts", "quote_id")
    aggs = [f(c).alias(f"{c}_{n}") for c in ("bid", "ask") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
    aggs += [F.max_by(c, order).alias(f"{c}_last") for c in ("bid", "ask")]
    aggs += [f("bps").alias(f"spread_bps_{n}") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min), ("stddev", F.stddev))]
    aggs += [F.avg("mid").alias("mid_avg"), F.stddev("mid").alias("mid_stddev"), F.count(F.lit(1)).alias("quote_count"), F.count_if(F.col("bps") <= tight_bps).alias("tight_spread_count")]
    out = rows.groupBy("symbol", F.window("ts", duration).alias("w")).agg(*aggs)
    return out.withColumn("tight_spread_pct", _share(F.col("tight_spread_count"), F.col("quote_count"))).withColumn("window_start", F.col("w.start")).drop("w")


def trade_metrics(trades: DataFrame, duration: str, *, exact: bool = True) -> DataFrame:
    """Sizes, prices, medians, vwap and trades per second per symbol and window."""
    quantile = (lambda c, p: F.percentile(c, F.lit(p))) if exact else (lambda c, p: F.percentile_approx(c, p))
    out = trades.groupBy("symbol", F.window("ts", duration).alias("w")).agg(
        F.sum("size").alias("total_volume"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"),
        F.stddev("size").alias("size_stddev"), F.sum(F.col("price") * F.col("size")).alias("dollar_volume"), F.avg("price").alias("avg_price"),
        F.stddev("price").alias("price_stddev"), F.count(F.lit(1)).alias("trade_count"), quantile("size", 0.5).alias("median_size"),
        quantile("size", 0.9).alias("p90_size"), quantile("price", 0.5).alias("median_price"),
    )
    seconds = F.unix_micros(F.col("w.end").cast("timestamp")) / 1e6 - F.unix_micros(F.col("w.start").cast("timestamp")) / 1e6
    return (
        out.withColumn("vwap", F.try_divide("dollar_volume", "total_volume")).withColumn("trades_per_second", F.col("trade_count") / seconds)
        .withColumn("window_start", F.col("w.start")).drop("w")
    )


def market_statistics(records: DataFrame, duration: str, *, exact: bool = True) -> DataFrame:
    """Counts by topic, active symbols, quality and latency per window of ``records`` (ts, symbol, topic, quality, latency_s).

    Quality and latency are averaged in millionths: integers, whose sums don't depend on the order of the rows.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    mean = lambda x: F.sum(F.round(F.col(x) * 1e6).cast("long")) / (F.count(x) * F.lit(1e6))
    out = records.groupBy(F.window("ts", duration).alias("w")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("topic") == "quotes").alias("quotes"), F.count_if(F.col("topic") == "trades").alias("trades"),
        distinct("symbol").alias("active_symbols"), mean("quality").alias("avg_quality"), F.count_if(F.col("quality") >= 0.8).alias("high_quality"),
        mean("latency_s").alias("avg_latency_s"),
    )
    return out.withColumn("high_quality_pct", _share(F.col("high_quality"), F.col("records"))).withColumn("window_start", F.col("w.start")).drop("w")
