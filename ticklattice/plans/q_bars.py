"""Bars and windowed metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.operators import bars as B
from ticklattice.plans import Queries
from ticklattice.sources import fixtures as X

Q = Queries()
_ORDER = "(ts, trade_id)"


def _ohlcv_sql(interval: str, extra: str = "") -> str:
    return f"""
    select symbol, time_bucket(interval '{interval}', ts) as window_start, time_bucket(interval '{interval}', ts) + interval '{interval}' as window_end,
           arg_min(price, {_ORDER}) as open, max(price) as high, min(price) as low, arg_max(price, {_ORDER}) as close,
           cast(sum(size) as bigint) as volume, count(*) as trade_count, avg(price) as avg_price, stddev(price) as price_stddev,
           sum(price * size) as value_traded, sum(price * size) / nullif(sum(size), 0) as vwap,
           (arg_max(price, {_ORDER}) - arg_min(price, {_ORDER})) / nullif(arg_min(price, {_ORDER}), 0) * 100 as change_pct,
           max(price) - min(price) as range, (max(price) - min(price)) / nullif(min(price), 0) * 100 as range_pct {extra}
    from trades group by 1, 2"""


@Q.add("a1_ohlcv_1d", f"with {X.TRADES} {_ohlcv_sql('1 day')}")
def a1(spark, d):
    return B.ohlcv(X.trades(spark, d), "1 day")


@Q.add("a1_ohlcv_timeframes", f"with {X.TRADES} " + " union all ".join(_ohlcv_sql(v, f", '{k}' as timeframe") for k, v in B.TIMEFRAMES.items()))
def a1_all(spark, d):
    return B.ohlcv_timeframes(X.trades(spark, d))


@Q.add("a2_ohlcv_seconds", f"""with {X.TRADES}
select symbol, to_timestamp(floor(epoch(ts) / s) * s)::timestamp as window_start, s || 's' as timeframe, arg_min(price, {_ORDER}) as open, max(price) as high,
       min(price) as low, arg_max(price, {_ORDER}) as close, cast(sum(size) as bigint) as volume, count(*) as trade_count
from trades, (values (60), (300), (900), (3600)) v(s) group by 1, 2, 3""")  # fmt: skip
def a2(spark, d):
    return B.ohlcv_seconds(X.trades(spark, d))


_BPS = "case when bid > 0 then (ask - bid) / nullif((bid + ask) / 2, 0) * 10000 end"


@Q.add("a3_quote_metrics", f"""with {X.QUOTES}, q as (select *, (bid + ask) / 2 as mid, {_BPS} as bps from quotes)
select symbol, time_bucket(interval '30 days', ts, timestamp '1970-01-01') as window_start, avg(bid) as bid_avg, max(bid) as bid_max, min(bid) as bid_min,
       avg(ask) as ask_avg, max(ask) as ask_max, min(ask) as ask_min, arg_max(bid, (ts, quote_id)) as bid_last, arg_max(ask, (ts, quote_id)) as ask_last,
       avg(bps) as spread_bps_avg, max(bps) as spread_bps_max, min(bps) as spread_bps_min, stddev(bps) as spread_bps_stddev,
       avg(mid) as mid_avg, stddev(mid) as mid_stddev, count(*) as quote_count, count(*) filter (bps <= 10) as tight_spread_count,
       count(*) filter (bps <= 10) * 100.0 / count(*) as tight_spread_pct
from q group by 1, 2""")  # fmt: skip
def a3(spark, d):
    return B.quote_metrics(X.quotes(spark, d), "30 days")


@Q.add("a4_trade_metrics", f"""with {X.TRADES}
select symbol, time_bucket(interval '1 hour', ts) as window_start, cast(sum(size) as bigint) as total_volume, avg(size) as avg_size, max(size) as max_size,
       min(size) as min_size, stddev(size) as size_stddev, sum(price * size) as dollar_volume, avg(price) as avg_price, stddev(price) as price_stddev,
       count(*) as trade_count, quantile_cont(size, 0.5) as median_size, quantile_cont(size, 0.9) as p90_size, quantile_cont(price, 0.5) as median_price,
       sum(price * size) / nullif(sum(size), 0) as vwap, count(*) / 3600.0 as trades_per_second
from trades group by 1, 2""")  # fmt: skip
def a4(spark, d):
    return B.trade_metrics(X.trades(spark, d), "1 hour")


def records(spark, d):
    """Trades and quotes as one feed, with a quality and a latency that follow from their ids."""
    t = X.trades(spark, d).select("symbol", "ts", F.lit("trades").alias("topic"), F.col("trade_id").alias("id"))
    q = X.quotes(spark, d).select("symbol", "ts", F.lit("quotes").alias("topic"), F.col("quote_id").alias("id"))
    return t.union(q).select("symbol", "ts", "topic", ((F.col("id") % 11) / 10).alias("quality"), (F.col("id") % 7).cast("double").alias("latency_s"))


RECORDS = f"""{X.TRADES}, {X.QUOTES}, records as (
    select symbol, ts, topic, (id % 11) / 10 as quality, cast(id % 7 as double) as latency_s from (
        select symbol, ts, 'trades' as topic, trade_id as id from trades union all select symbol, ts, 'quotes', quote_id from quotes))"""


_MEAN = "cast(sum(cast(round({0} * 1e6) as bigint)) as double) / (count({0}) * 1e6)"


@Q.add("a5_market_statistics", f"""with {RECORDS}
select time_bucket(interval '1 day', ts) as window_start, count(*) as records, count(*) filter (topic = 'quotes') as quotes,
       count(*) filter (topic = 'trades') as trades, count(distinct symbol) as active_symbols, {_MEAN.format("quality")} as avg_quality,
       count(*) filter (quality >= 0.8) as high_quality, {_MEAN.format("latency_s")} as avg_latency_s, count(*) filter (quality >= 0.8) * 100.0 / count(*) as high_quality_pct
from records group by 1""")  # fmt: skip
def a5(spark, d):
    return B.market_statistics(records(spark, d), "1 day")


_ROLL = """arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, cast(sum(volume) as bigint) as volume,
       cast(sum(trade_count) as bigint) as trade_count, sum(vwap * volume) / nullif(sum(volume), 0) as vwap from bars group by 1, 2"""


@Q.add("a6_rollup_1d", f"with {X.bars_sql()} select symbol, date_trunc('day', ts)::timestamp as window_start, {_ROLL}")
def a6(spark, d):
    return B.rollup(X.bars(spark, d), F.date_trunc("day", "ts").cast("timestamp_ntz"))


@Q.add("a6_rollup_week", f"with {X.bars_sql('1 day')} select symbol, date_trunc('week', ts)::timestamp as window_start, {_ROLL}")
def a6_week(spark, d):
    return B.rollup(X.bars(spark, d, "1 day"), F.date_trunc("week", "ts").cast("timestamp_ntz"))


@Q.add("st3_sliding_windows", f"""with {X.TRADES}, w as (
    select symbol, unnest([time_bucket(interval '15 minutes', ts) - to_minutes(cast(15 * k as integer)) for k in range(4)]) as window_start, ts, price, size from trades)
select symbol, window_start, count(*) as trade_count, sum(size)::bigint as volume, avg(price) as avg_price from w group by 1, 2""")  # fmt: skip
def sliding(spark, d):
    t = X.trades(spark, d).groupBy("symbol", F.window("ts", "1 hour", "15 minutes").alias("w"))
    return t.agg(F.count(F.lit(1)).alias("trade_count"), F.sum("size").alias("volume"), F.avg("price").alias("avg_price")).select(
        "symbol", F.col("w.start").alias("window_start"), "trade_count", "volume", "avg_price"
    )


@Q.add("st3_session_windows", f"""with {X.TRADES}, s as (
    select *, sum(n) over (partition by symbol order by ts, trade_id rows unbounded preceding) as session from (
        select *, case when ts - lag(ts) over (partition by symbol order by ts, trade_id) < interval '30 minutes' then 0 else 1 end as n from trades))
select symbol, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as trade_count, sum(size)::bigint as volume
from s group by symbol, session""")  # fmt: skip
def sessions(spark, d):
    t = X.trades(spark, d).groupBy("symbol", F.session_window("ts", "30 minutes").alias("w"))
    return t.agg(F.count(F.lit(1)).alias("trade_count"), F.sum("size").alias("volume")).select(
        "symbol", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "trade_count", "volume"
    )
