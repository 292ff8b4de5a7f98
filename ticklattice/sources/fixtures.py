"""Market tables derived from the given tables, as DataFrames and as SQL common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, size, trade_id): each event is a trade."""
    return table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"), F.col("event_id").alias("trade_id"),
    )


TRADES = """trades as (
    select upper(event_type) as symbol, ts, value as price, cast(json_extract_string(props, '$.k') as bigint) as size,
           event_id as trade_id
    from events)"""


def trades_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with one symbol per event type and user: many short series."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"), F.col("event_id").alias("trade_id"),
    )


TRADES_FINE = """trades_fine as (
    select event_type || '_' || user_id as symbol, ts, value as price,
           cast(json_extract_string(props, '$.k') as bigint) as size, event_id as trade_id
    from events)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, bid, ask, bid_size, ask_size, quote_id): line items as quotes of their supplier."""
    ask = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (ask * (1 - F.col("l_discount"))).alias("bid"), ask.alias("ask"),
        F.col("l_quantity").alias("bid_size"), F.col("l_quantity").alias("ask_size"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("quote_id"),
    )


QUOTES = """quotes as (
    select cast(l_suppkey as varchar) as symbol, cast(l_shipdate as timestamp) as ts,
           l_extendedprice / l_quantity * (1 - l_discount) as bid, l_extendedprice / l_quantity as ask,
           l_quantity as bid_size, l_quantity as ask_size, cast(l_orderkey * 10 + l_linenumber as bigint) as quote_id
    from lineitem)"""


def dirty_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as untyped strings with planted faults, each seventh one twice with a later ingestion time."""
    e = F.col("trade_id")
    raw = trades(spark, sf_dir).select(
        F.concat(F.lit(" "), F.lower("symbol"), F.lit(".US")).alias("symbol"), "ts", e.alias("trade_id"), F.col("size").cast("string").alias("size"),
        F.when(e % 17 == 0, None).when(e % 101 == 0, F.col("price") * 100).when(e % 53 == 0, -F.col("price")).otherwise(F.col("price")).alias("price"),
    )
    return raw.withColumn("copy", F.explode(F.expr("if(trade_id % 7 = 0, array(0, 1), array(0))"))).withColumn(
        "ingested", F.expr("ts + make_dt_interval(0, 0, 1 + copy, 0)")
    )


DIRTY = (
    TRADES
    + """, dirty as (
    select ' ' || lower(symbol) || '.US' as symbol, ts, trade_id, cast(size as varchar) as size,
           case when trade_id % 17 = 0 then null when trade_id % 101 = 0 then price * 100
                when trade_id % 53 = 0 then -price else price end as price,
           copy, ts + to_minutes(cast(1 + copy as integer)) as ingested
    from trades, (values (0), (1)) c(copy)
    where copy = 0 or trade_id % 7 = 0)"""
)


def bars(spark: SparkSession, sf_dir: str, duration: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, vwap, trade_count): bars of the trades."""
    from ticklattice.operators.bars import ohlcv

    return ohlcv(trades(spark, sf_dir), duration).select(
        "symbol", F.col("window_start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trade_count"
    )


def bars_sql(interval: str = "1 hour") -> str:
    return f"""{TRADES}, bars as (
    select symbol, time_bucket(interval '{interval}', ts) as ts, arg_min(price, (ts, trade_id)) as open, max(price) as high,
           min(price) as low, arg_max(price, (ts, trade_id)) as close, cast(sum(size) as bigint) as volume,
           sum(price * size) / nullif(sum(size), 0) as vwap, count(*) as trade_count
    from trades group by 1, 2)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, symbol, type, qty, price, date, tx_id): line items as transactions of the order's customer."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("symbol"), F.expr("if(l_returnflag = 'R', 'SELL', 'BUY')").alias("type"),
        F.col("l_quantity").cast("double").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("tx_id"),
    )


TRANSACTIONS = """transactions as (
    select o_custkey as user_id, l_partkey as symbol, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as type,
           cast(l_quantity as double) as qty, l_extendedprice / l_quantity as price, cast(l_shipdate as timestamp) as date,
           cast(l_orderkey * 10 + l_linenumber as bigint) as tx_id
    from lineitem join orders on l_orderkey = o_orderkey)"""
