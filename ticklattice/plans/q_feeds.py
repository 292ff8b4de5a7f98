"""Feeds, layers, scalar functions and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.operators import lineage as L
from ticklattice.plans import Queries
from ticklattice.sources import feeds as S
from ticklattice.sources import fixtures as X

Q = Queries()
c = F.col


AT = "2024-02-02 03:04:05"


def _raw(spark, d):
    """Messages as a source gives them: a partition by key, and the time of arrival."""
    part = F.pmod(F.length("key"), F.lit(3)).alias("partition")
    return S.messages(X.trades(spark, d), X.quotes(spark, d)).select("*", part, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("kafka_timestamp"))


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@Q.add("pf1_pf4_bronze", f"""with {X.TRADES}, {X.QUOTES}, u as (select 'trades' as topic, symbol, ts, trade_id as id from trades union all select 'quotes', symbol, ts, null from quotes)
select topic, symbol, trade_id, has_valid_symbol, has_valid_timestamp, quality_score, is_high_quality, year, month, day, hour,
  cast(length(symbol) % 3 as integer) as partition, timestamp '2024-02-01' as kafka_timestamp, timestamp '{AT}' as ingestion_timestamp, 'intake' as ingestion_job from (select topic, symbol, cast(id as varchar) as trade_id, true as has_valid_symbol, true as has_valid_timestamp,
  1.0::double as quality_score, true as is_high_quality, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour from u)""")
def bronze(spark, d):
    return S.bronze(_raw(spark, d), job="intake", ingested=_at()).select(
        "topic", "symbol", "trade_id", "has_valid_symbol", "has_valid_timestamp", "quality_score", "is_high_quality", "year", "month", "day", "hour", "partition", "kafka_timestamp",
        "ingestion_timestamp", "ingestion_job",
    )


@Q.add("pf5_pf12_silver", f"""with {X.TRADES}, {X.QUOTES}, u as (select 'trades' as topic, symbol, date_trunc('second', ts)::timestamp as ts, price, null::double as bid, null::double as ask, size as volume from trades
  union all select 'quotes', symbol, ts, null, bid, ask, null from quotes),
f as (select *, (bid + ask) / 2 as mid_price, ask - bid as spread, case when bid > 0 then (ask - bid) / nullif((bid + ask) / 2, 0) * 10000 end as spread_bps from u)
select topic, symbol, ts, round(price, 6) as price, volume, cast(hour(ts) as integer) as hour_of_day, cast(dayofweek(ts) + 1 as integer) as day_of_week, hour(ts) between 9 and 16 as is_market_hours,
  (cast(coalesce(coalesce(price, mid_price) between 0.01 and 100000, false) as integer) + 1 + cast(coalesce(spread_bps <= 1000, true) as integer)) / 3 as overall_score,
  cast(length(symbol) % 3 as integer) as partition, timestamp '{AT}' as silver_processed_timestamp, 'refine' as silver_job_id, '2.0' as data_version, 64 as id_length from f""")
def silver(spark, d):
    s = S.silver(S.bronze(_raw(spark, d)), job="refine", processed=_at(), version="2.0").withColumn("id_length", F.length("record_id"))
    return s.select("partition", "silver_processed_timestamp", "silver_job_id", "data_version", "id_length", "topic", "symbol", "ts", F.round("price", 6).alias("price"), "volume", "hour_of_day", "day_of_week", "is_market_hours", "overall_score")


@Q.add("pf7_quote_fields", f"with {X.QUOTES} select quote_id, (bid + ask) / 2 as mid, ask - bid as spread, case when bid > 0 then (ask - bid) / nullif((bid + ask) / 2, 0) * 10000 end as spread_bps from quotes")
def quote_fields(spark, d):
    mid = (c("bid") + c("ask")) / 2
    return X.quotes(spark, d).select("quote_id", mid.alias("mid"), (c("ask") - c("bid")).alias("spread"), F.when(c("bid") > 0, F.try_divide(c("ask") - c("bid"), mid) * 10000).alias("spread_bps"))


@Q.add("pf8_bar_fields", f"with {X.bars_sql()} select symbol, ts, high - low as range, close - open as change, (close - open) / nullif(open, 0) * 100 as change_pct from bars")
def bar_fields(spark, d):
    return X.bars(spark, d).select("symbol", "ts", (c("high") - c("low")).alias("range"), (c("close") - c("open")).alias("change"), (F.try_divide(c("close") - c("open"), c("open")) * 100).alias("change_pct"))


@Q.add("pf10_market_session", f"with {X.TRADES} select case when isodow(ts) >= 6 then 'closed' when hour(ts) >= 9 and hour(ts) < 16 then 'regular' when hour(ts) >= 4 and hour(ts) < 9 then 'pre_market' else 'after_hours' end as session, count(*) as n from trades group by 1")
def session(spark, d):
    return X.trades(spark, d).groupBy(S.market_session(c("ts")).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@Q.add("pf11_utc", f"with {X.TRADES} select trade_id, timezone('America/New_York', ts) at time zone 'UTC' as ts_utc from trades")
def utc(spark, d):
    return X.trades(spark, d).select("trade_id", F.to_utc_timestamp(c("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("ts_utc"))


@Q.add("pf14_entity_filter", f"with {X.TRADES_FINE} select symbol, trade_id from trades_fine where symbol in (select symbol from trades_fine group by 1 having count(*) >= 3)")
def entity_filter(spark, d):
    t = X.trades_fine(spark, d)
    return t.join(t.groupBy("symbol").count().filter("count >= 3"), "symbol", "left_semi").select("symbol", "trade_id")


@Q.add("src5_date_patterns", """select pattern, case pattern when 'yyyy-MM-dd' then (select count(*) from orders) else 0 end as parsed, (select count(*) from orders) as total from
 (values ('yyyy-MM-dd HH:mm:ss'), ('yyyy-MM-dd''T''HH:mm:ss'), ('yyyy-MM-dd'), ('MM/dd/yyyy HH:mm:ss'), ('MM/dd/yyyy'), ('dd/MM/yyyy'), ('yyyyMMdd'), ('dd-MM-yyyy')) v(pattern)""")
def date_patterns(spark, d):
    return S.detect_date_pattern(X.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("when_text")), "when_text")


@Q.add("src4_infer_types", "select * from (values ('id', 'integer'), ('price', 'decimal'), ('day', 'datetime'), ('flag', 'boolean'), ('name', 'string')) v(\"column\", type)")
def infer(spark, d):
    e = X.table(spark, d, "events")
    return S.infer_types(e.select(c("event_id").cast("string").alias("id"), c("value").cast("string").alias("price"), c("ts").cast("string").alias("day"), (c("value") > 50).cast("string").alias("flag"), c("event_type").alias("name")))


@Q.add("src7_aliases", f"with {X.TRADES} select trade_id, price, size, symbol, ts from trades")
def aliases(spark, d):
    t = X.trades(spark, d).withColumnsRenamed({"price": "Trade_Price", "size": "quantity", "symbol": "Ticker", "ts": "datetime"})
    assert S.classify_header(t.columns) == "trade"
    return S.with_aliases(t).select("trade_id", "price", "size", "symbol", "ts")


def _daily(spark, d):
    return X.bars(spark, d, "1 day")


@Q.add("src10_array_payload", f"with {X.bars_sql('1 day')} select symbol, ts, round(open, 2) as open, round(high, 2) as high, round(low, 2) as low, round(close, 2) as close, volume from bars")
def array_payload(spark, d):
    b = _daily(spark, d).withColumn("timestamp", F.unix_timestamp(c("ts").cast("timestamp")))
    lists = b.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("timestamp", "open", "high", "low", "close", "volume"))).alias("b"))
    payload = F.to_json(F.struct(*[c("b")[k].alias(k) for k in ("timestamp", "open", "high", "low", "close", "volume")]))
    return S.flatten_arrays(lists.select("symbol", payload.alias("payload")))


@Q.add("src10_map_payload", f"with {X.bars_sql('1 day')} select symbol, ts, open, close from bars")
def map_payload(spark, d):
    b = _daily(spark, d)
    bar = F.create_map(F.lit("1. open"), c("open").cast("string"), F.lit("4. close"), c("close").cast("string"))
    m = b.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), bar))).alias("m"))
    return S.flatten_map(m.select("symbol", F.to_json("m").alias("payload")))


@Q.add("src11_tick_payload", f"with {X.TRADES} select symbol, date_trunc('millisecond', ts)::timestamp as ts, price, size from trades where trade_id % 2 = 0")
def tick_payload(spark, d):
    t = X.trades(spark, d)
    data = F.struct(F.when(c("trade_id") % 2 == 0, "T").otherwise("Q").alias("ev"), c("symbol").alias("s"), c("price").alias("p"), c("size").alias("v"), F.unix_millis(c("ts").cast("timestamp")).alias("t"))
    p = t.groupBy(F.to_date("ts"), "symbol").agg(F.collect_list(data).alias("data"))
    return S.flatten_ticks(p.select(F.to_json(F.struct("data")).alias("payload")))


@Q.add("src12_interval_scan", f"with {X.TRADES} select symbol, ts, trade_id, price from trades where ts between timestamp '2024-01-05' and timestamp '2024-01-08' and symbol = 'VIEW'")
def interval_scan(spark, d):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return X.trades(spark, d).filter(c("ts").between(ts("2024-01-05"), ts("2024-01-08")) & (c("symbol") == "VIEW")).select("symbol", "ts", "trade_id", "price")


@Q.add("src13_envelope_round_trip", f"with {X.TRADES} select symbol, price, size, trade_id from trades")
def envelope(spark, d):
    j = X.trades(spark, d).select(F.to_json(F.struct("symbol", "price", "size", "trade_id")).alias("value"))
    return j.select(F.from_json("value", "symbol string, price double, size bigint, trade_id bigint").alias("m")).select("m.*")


@Q.add("snk2_messages_by_topic", f"with {X.TRADES}, {X.QUOTES} select 'trades' as topic, symbol as key, count(*) as n from trades group by 2 union all select 'quotes', symbol, count(*) from quotes group by 2")
def messages(spark, d):
    return _raw(spark, d).groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"))


@Q.add("snk3_dead_letters", f"with {X.DIRTY} select 'ok' as side, count(*) filter (price > 0) as n from dirty union all select 'dead', count(*) filter (not coalesce(price > 0, false)) from dirty")
def dead_letters(spark, d):
    good, dead = S.split_dead_letters(X.dirty_trades(spark, d), c("price") > 0)
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(good, "ok").unionByName(count(dead, "dead"))


@Q.add("snk9_change_feed", f"with {X.TRADES} select trade_id, cast(floor(trade_id / 1000) as bigint) as _batch_id from trades where floor(trade_id / 1000) > 5")
def change_feed(spark, d):
    return S.changes_since(X.trades(spark, d).select("trade_id", F.floor(c("trade_id") / 1000).alias("_batch_id")), 5)


@Q.add("so2_tagged_union", f"""with {X.TRADES}, {X.QUOTES} select 'trades' as aggregation_type, symbol, count(*) as n, sum(size)::bigint as volume, null::double as mean_spread from trades group by 2
union all select 'quotes', symbol, count(*), null, avg(ask - bid) from quotes group by 2""")
def tagged_union(spark, d):
    t = X.trades(spark, d).groupBy(F.lit("trades").alias("aggregation_type"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    q = X.quotes(spark, d).groupBy(F.lit("quotes").alias("aggregation_type"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(c("ask") - c("bid")).alias("mean_spread"))
    return t.unionByName(q, allowMissingColumns=True)


@Q.add("sc3_sc5_sc6_scalars", f"""with {X.TRADES} select trade_id, regexp_replace('a  b   ' || symbol, '\\s+', ' ', 'g') as spaces, cast(year(ts) as integer) as year, cast(week(ts) as integer) as week, floor(epoch(ts))::bigint % 3600 as second_of_hour, sqrt(price) as root, ln(price + 1) as log1,
  exp(price / 100) as e, round(price, 1) as r1, least(greatest(price, 10), 90) as clipped from trades""")
def scalars(spark, d):
    p = c("price")
    return X.trades(spark, d).select(
        "trade_id", F.regexp_replace(F.concat(F.lit("a  b   "), "symbol"), r"\s+", " ").alias("spaces"), F.year("ts").alias("year"), F.weekofyear("ts").alias("week"), (F.unix_timestamp(c("ts").cast("timestamp")) % 3600).alias("second_of_hour"),
        F.sqrt(p).alias("root"), F.log1p(p).alias("log1"), F.exp(p / 100).alias("e"), F.round(p, 1).alias("r1"), F.least(F.greatest(p, F.lit(10.0)), F.lit(90.0)).alias("clipped"),
    )


@Q.add("sc4_patterns", f"with {X.TRADES} select symbol, regexp_matches(symbol, '^[A-Z]{{1,10}}$') as plain, regexp_matches(symbol, '^[A-Z0-9._-]+$') as wide, count(*) as n from trades group by 1")
def patterns(spark, d):
    return X.trades(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).select("symbol", c("symbol").rlike("^[A-Z]{1,10}$").alias("plain"), c("symbol").rlike("^[A-Z0-9._-]+$").alias("wide"), "n")


@Q.add("sc7_sc9_json_map", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, 1::bigint as keys, json_extract_string(props, '$.missing') as missing from events""")
def json_map(spark, d):
    e = X.table(spark, d, "events").select("event_id", "props", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", c("m")["k"].alias("k"), F.size(F.map_keys("m")).cast("long").alias("keys"), F.get_json_object("props", "$.missing").alias("missing"))


@Q.add("sc10_signature", "select event_type, sha256(event_type || '|' || count(*)) as signature from events group by 1")
def signature(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.sha2(F.concat_ws("|", "event_type", c("n").cast("string")), 256).alias("signature"))


@Q.add("sc11_null_logic", f"with {X.DIRTY} select trade_id, copy, coalesce(price, 0) as filled, nullif(size, '0') as size_or_null, price is null as missing from dirty")
def null_logic(spark, d):
    return X.dirty_trades(spark, d).select("trade_id", "copy", F.coalesce(F.nanvl("price", F.lit(None).cast("double")), F.lit(0.0)).alias("filled"), F.nullif(c("size"), F.lit("0")).alias("size_or_null"), c("price").isNull().alias("missing"))


# Lineage: users stand for features; an event's feature was made from that of the event before it, if that has a smaller id.


def events(spark, d):
    e = X.table(spark, d, "events").select("event_id", c("user_id").alias("feature_id"), "event_type", "ts")
    before = e.select((c("event_id") + 1).alias("event_id"), c("feature_id").alias("prior"))
    kind = F.when(c("event_type").isin("view", "click"), "accessed").otherwise("computed").alias("kind")
    made_from = F.when(c("prior") < c("feature_id"), F.array("prior")).otherwise(F.array().cast("array<bigint>")).alias("dependencies")
    return e.join(before, "event_id", "left").select("feature_id", kind, "ts", made_from)


EVENTS = """ev as (select e.user_id as feature_id, case when e.event_type in ('view', 'click') then 'accessed' else 'computed' end as kind, e.ts, p.user_id as dep
  from events e left join events p on p.event_id = e.event_id - 1 and p.user_id < e.user_id),
eg as (select distinct dep as src, feature_id as dst from ev where dep is not null)"""


@Q.add("ln0_edges", f"with {EVENTS} select * from eg")
def lineage_edges(spark, d):
    return L.edges(events(spark, d))


@Q.add("ln1_rollup", f"with {EVENTS} select feature_id, count(*) filter (kind = 'computed') as computations, count(*) filter (kind = 'accessed') as accesses, max(ts) filter (kind = 'computed') as last_computed, max(ts) filter (kind = 'accessed') as last_accessed from ev group by 1")
def lineage_rollup(spark, d):
    return L.rollup(events(spark, d))


def _reach(roots: str, depth: int) -> str:
    return f"""with recursive {EVENTS}, rc as (select feature_id as root, feature_id as node, 0 as distance from ({roots})
  union select root, dst, distance + 1 from rc join eg on node = src where distance < {depth})"""


@Q.add("j11_reachable", _reach("select feature_id from ev where kind = 'computed' group by 1 order by max(ts) desc, feature_id limit 10", 4)
       + " select root, node, min(distance) as distance from rc where distance > 0 and root <> node group by 1, 2")
def reachable(spark, d):
    """What depends on the ten features that were computed last."""
    e = events(spark, d)
    last = L.rollup(e).filter("last_computed is not null").orderBy(F.desc("last_computed"), "feature_id").limit(10)
    return L.reachable(L.edges(e), last.select(c("feature_id").alias("node")), 4)


@Q.add("ln2_impact", f"""{_reach("select distinct feature_id from ev", 5)}, d as (select distinct root, node from rc where distance > 0 and root <> node), u as (select feature_id, count(*) filter (kind = 'accessed') as a from ev group by 1),
b as (select root, count(*) as dependents, sum(a) as below from d join u on node = feature_id group by 1)
select u.feature_id, coalesce(dependents, 0) as dependents, least((a + coalesce(below, 0)) / 100, 10.0) as impact, true as is_exact from u left join b on root = u.feature_id""")
def impact(spark, d):
    return L.impact_of_all(events(spark, d), 5)
