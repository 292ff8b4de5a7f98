"""Cleaning, validation, data quality and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.operators import cleaning as C
from ticklattice.operators import validation as V
from ticklattice.plans import Queries
from ticklattice.sources import fixtures as X

Q = Queries()
SYM = "upper(regexp_replace(regexp_replace(trim(symbol), '(?i)\\.US$', ''), '[^A-Za-z0-9]', '', 'g'))"


def _numeric_dirty(spark, d):
    """Dirty trades, once each, with typed size."""
    return X.dirty_trades(spark, d).filter("copy = 0").select(C.clean_symbol(F.col("symbol")).alias("symbol"), "ts", "trade_id", "price", F.col("size").cast("long").alias("size"), "ingested")


ND = X.DIRTY + f", nd as (select {SYM} as symbol, ts, trade_id, price, cast(size as bigint) as size, ingested from dirty where copy = 0)"


@Q.add("pf6_sc1_sc2_typed", f"with {X.DIRTY} select {SYM} as symbol, ts, trade_id, cast(price as decimal(18,8)) as price_decimal, try_cast(regexp_replace(size, '[^0-9.-]', '', 'g') as bigint) as size_long, ingested from dirty")
def typed(spark, d):
    return C.typed(X.dirty_trades(spark, d))


@Q.add("sl1_keep_latest", f"with {X.DIRTY} select symbol, ts, trade_id, price, ingested from dirty qualify row_number() over (partition by symbol, ts, trade_id order by ingested desc) = 1")
def keep_latest(spark, d):
    return C.keep_latest(X.dirty_trades(spark, d), ["symbol", "ts", "trade_id"], ["ingested"]).select("symbol", "ts", "trade_id", "price", "ingested")


@Q.add("sl9_exact_duplicates", f"""with {X.DIRTY}, h as (select trade_id, copy, md5(symbol || '|' || trade_id || '|' || coalesce(size, '')) as content_hash from dirty)
select *, row_number() over (partition by content_hash order by copy) > 1 as is_duplicate from h""")
def duplicates(spark, d):
    return C.flag_exact_duplicates(X.dirty_trades(spark, d), ["symbol", "trade_id", "size"], "copy").select("trade_id", "copy", "content_hash", "is_duplicate")


O = "partition by symbol order by ts, trade_id"  # noqa: E741


@Q.add("dc1_dc3_fills", f"""with {ND} select symbol, ts, trade_id, coalesce(price, avg(price) over ({O} rows between 10 preceding and 10 following)) as centred,
last_value(price ignore nulls) over ({O} rows unbounded preceding) as forward, first_value(price ignore nulls) over ({O} rows between current row and unbounded following) as backward from nd""")
def fills(spark, d):
    return C.fill_nearest(C.fill_centred_mean(_numeric_dirty(spark, d), "price"), "price").select("symbol", "ts", "trade_id", "centred", "forward", "backward")


@Q.add("dc2_linear_fill", f"""with {ND}, r as (select *, row_number() over ({O}) as r, case when price is not null then row_number() over ({O}) end as k from nd),
n as (select *, last_value(price ignore nulls) over b as a, last_value(k ignore nulls) over b as i, first_value(price ignore nulls) over f as bb, first_value(k ignore nulls) over f as j from r
  window b as ({O} rows unbounded preceding), f as ({O} rows between current row and unbounded following))
select symbol, ts, trade_id, case when price is not null then price when a is null then bb when bb is null then a else a + (bb - a) * (r - i) / (j - i) end as price_linear from n""")
def linear(spark, d):
    return C.fill_nearest(_numeric_dirty(spark, d), "price").select("symbol", "ts", "trade_id", F.col("linear").alias("price_linear"))


@Q.add("dc4_j1_statistic_fill", f"""with {ND}, s as (select symbol, quantile_cont(price, 0.5) as med, avg(price) as mean from nd group by 1)
select symbol, ts, trade_id, coalesce(price, med) as price_median, coalesce(price, mean) as price_mean from nd join s using (symbol)""")
def statistic_fill(spark, d):
    return C.fill_statistics(_numeric_dirty(spark, d), "price").select("symbol", "ts", "trade_id", "price_median", "price_mean")


@Q.add("dc5_outliers_iqr", f"""with {ND}, s as (select symbol, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from nd group by 1),
j as (select nd.*, q1 - (q3 - q1) * 1.5 as lo, q3 + (q3 - q1) * 1.5 as hi, avg(price) over ({O} rows between 5 preceding and 5 following) as around from nd join s using (symbol)),
o as (select *, coalesce(price < lo or price > hi, false) as is_outlier from j)
select symbol, ts, trade_id, is_outlier, case when price is not null then least(greatest(price, lo), hi) end as capped, case when not is_outlier then price end as nulled,
       case when is_outlier then around else price end as smoothed from o""")
def iqr(spark, d):
    return C.outliers_iqr(_numeric_dirty(spark, d), "price").select("symbol", "ts", "trade_id", "is_outlier", "capped", "nulled", "smoothed")


@Q.add("dc6_outliers_z", f"""with {ND}, s as (select symbol, avg(price) as m, stddev_samp(price) as sd from nd group by 1)
select symbol, ts, trade_id, coalesce(price < m - 3 * sd or price > m + 3 * sd, false) as is_outlier, case when price is not null then least(greatest(price, m - 3 * sd), m + 3 * sd) end as capped from nd join s using (symbol)""")
def zscore(spark, d):
    return C.outliers_z(_numeric_dirty(spark, d), "price").select("symbol", "ts", "trade_id", "is_outlier", "capped")


@Q.add("dc7_outliers_global", f"""with {ND}, s as (select quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3, avg(price) as m, stddev_samp(price) as sd, quantile_cont(price, 0.5) as med from nd),
t as (select quantile_cont(abs(price - med), 0.5) as mad from nd, s)
select symbol, ts, trade_id, coalesce(price < q1 - (q3 - q1) * 1.5 or price > q3 + (q3 - q1) * 1.5, false) as is_iqr, coalesce(abs((price - m) / nullif(sd, 0)) > 3, false) as is_z,
       coalesce(abs((price - med) * 0.6745 / nullif(mad, 0)) > 3.5, false) as is_modified_z from nd, s, t""")
def outliers_global(spark, d):
    return C.outliers_global(_numeric_dirty(spark, d), "price").select("symbol", "ts", "trade_id", "is_iqr", "is_z", "is_modified_z")


@Q.add("dc8_dc9_repair_ticks", f"with {ND} select symbol, ts, trade_id, round(case when price > 0 then price end, 4) as price_fixed, greatest(size, 0) as size_fixed from nd")
def repair_ticks(spark, d):
    return C.repair_ticks(_numeric_dirty(spark, d)).select("symbol", "ts", "trade_id", "price_fixed", "size_fixed")


@Q.add("dc8_repair_bars", f"with {X.bars_sql()} select symbol, ts, open, greatest(open, close, low, high) as high, least(open, close, low, high) as low, close, greatest(volume, 0) as volume from bars")
def repair_bars(spark, d):
    b = X.bars(spark, d)
    return C.repair_bars(b)


@Q.add("dc10_dc11_clean_ticks", f"""with {X.DIRTY}, t as (
    select {SYM} as symbol, ts, trade_id, cast(price as decimal(18,8))::double as price, try_cast(size as bigint) as size from dirty
    qualify row_number() over (partition by symbol, ts, trade_id order by ingested desc) = 1),
r as (select symbol, ts, trade_id, round(case when price > 0 then price end, 4) as price, greatest(size, 0) as size from t),
f as (select symbol, ts, trade_id, size, price is null as was_filled, coalesce(price, avg(price) over ({O} rows between 10 preceding and 10 following)) as price from r),
s as (select symbol, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from f group by 1),
j as (select f.*, q1 - (q3 - q1) * 1.5 as lo, q3 + (q3 - q1) * 1.5 as hi from f join s using (symbol))
select symbol, ts, trade_id, size, least(greatest(price, lo), hi) as price, cast(coalesce(price < lo or price > hi, false) as integer) as outliers_detected,
       coalesce(price < lo or price > hi, false) or was_filled as data_cleaned from j""")
def clean(spark, d):
    return C.clean_ticks(X.dirty_trades(spark, d))


_QR = {"has_symbol": "symbol is not null and length(symbol) > 0", "has_ts": "ts is not null", "price_range": "bid between 0.01 and 100000 and ask between 0.01 and 100000",
       "ask_above_bid": "ask >= bid", "spread_ok": "(ask - bid) / nullif((ask + bid) / 2, 0) * 10000 <= 1000", "size_ok": "bid_size between 1 and 1000000000"}
_TR = {"has_symbol": "symbol is not null and regexp_matches(symbol, '^[A-Z0-9._-]+$')", "has_ts": "ts is not null", "price_range": "price between 0.01 and 100000", "size_range": "size between 1 and 1000000000"}
_BR = {"has_symbol": "symbol is not null", "price_range": "close between 0.01 and 100000", "volume_range": "volume between 0 and 1000000000000",
       "ohlc": "high >= greatest(open, close, low) and low <= least(open, close, high)"}


def _valid(rules: dict, source: str) -> str:
    flags = ", ".join(f"coalesce({v}, false) as is_valid_{k}" for k, v in rules.items())
    total = " + ".join(f"cast(is_valid_{k} as integer)" for k in rules)
    return f"v0 as (select *, {flags} from {source}), v as (select *, {total} as rules_passed, ({total}) / {len(rules)} as validation_score, ({total}) / {len(rules)} >= 0.8 as is_valid from v0)"


_FLAGS = lambda r: ", ".join(f"is_valid_{k}" for k in r)


@Q.add("dv1_dv2_validate_quotes", f"with {X.QUOTES}, {_valid(_QR, 'quotes')} select quote_id, {_FLAGS(_QR)}, rules_passed, validation_score, is_valid from v")
def validate_quotes(spark, d):
    return V.validate(X.quotes(spark, d), "quotes").select("quote_id", *[f"is_valid_{k}" for k in _QR], "rules_passed", "validation_score", "is_valid")


@Q.add("dv1_dv2_validate_trades", f"with {ND}, {_valid(_TR, 'nd')} select trade_id, {_FLAGS(_TR)}, rules_passed, validation_score, is_valid from v")
def validate_trades(spark, d):
    return V.validate(_numeric_dirty(spark, d), "trades").select("trade_id", *[f"is_valid_{k}" for k in _TR], "rules_passed", "validation_score", "is_valid")


@Q.add("dv3_validate_bars", f"with {X.bars_sql()}, {_valid(_BR, 'bars')} select symbol, ts, {_FLAGS(_BR)}, rules_passed, validation_score, is_valid from v")
def validate_bars(spark, d):
    return V.validate(X.bars(spark, d), "bars").select("symbol", "ts", *[f"is_valid_{k}" for k in _BR], "rules_passed", "validation_score", "is_valid")


@Q.add("a14_validation_summary", f"with {ND}, {_valid(_TR, 'nd')} " + " union all ".join(
    f"select 'is_valid{s}' as rule, count(*) filter (is_valid{s}) as passed, count(*) as total, count(*) filter (is_valid{s}) / count(*) as pass_rate from v" for s in [*(f"_{k}" for k in _TR), ""]))
def validation_summary(spark, d):
    return V.summary(V.validate(_numeric_dirty(spark, d), "trades"), "trades")


_E = "cast(bid <= 0 as integer) + cast(bid > ask as integer) + cast(bid_size <= 0 as integer) + cast(symbol is null or length(symbol) = 0 as integer)"
_WN = "cast(bid = ask as integer) + cast(coalesce((ask - bid) / nullif(bid, 0) > 0.1, false) as integer)"
_REPORT = f"""{X.QUOTES}, e as (select *, {_E} as errors, {_WN} as warnings from quotes),
r as (select *, case when errors > 1 then 'QUESTIONABLE' when errors = 1 then 'LOW' when warnings > 0 then 'MEDIUM' else 'HIGH' end as quality from e)"""


@Q.add("dv4_severity_report", f"with {_REPORT} select quote_id, errors, warnings, quality from r")
def severity(spark, d):
    return V.severity_report(X.quotes(spark, d)).select("quote_id", "errors", "warnings", "quality")


@Q.add("dv5_quality_gate", f"with {_REPORT} select quote_id, quality from r where quality in ('HIGH')")
def gate(spark, d):
    return V.quality_gate(V.severity_report(X.quotes(spark, d)), "HIGH").select("quote_id", "quality")


@Q.add("a15_quality_statistics", f"with {_REPORT} select symbol, count(*) as n, cast(sum(errors) as bigint) as errors, cast(sum(warnings) as bigint) as warnings, avg(errors) as mean_errors, avg(warnings) as mean_warnings from r group by rollup (symbol)")
def quality_statistics(spark, d):
    return V.severity_report(X.quotes(spark, d)).rollup("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.avg("errors").alias("mean_errors"), F.avg("warnings").alias("mean_warnings")
    ).select("symbol", "n", "errors", "warnings", "mean_errors", "mean_warnings")


def _books(spark, d):
    """Books per symbol and hour: its five lowest prices as asks, its five highest as bids."""
    t = X.trades(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sort_array(F.collect_list(F.struct("price", "trade_id", "size"))).alias("a"))
    return t.select("symbol", "ts", F.slice("a", 1, 5).alias("asks"), F.slice(F.reverse("a"), 1, 5).alias("bids"))


@Q.add("sc8_order_book", f"""with {X.TRADES}, b as (select symbol, date_trunc('hour', ts)::timestamp as ts, list_sort(array_agg({{'price': price, 'trade_id': trade_id, 'size': size}})) as a from trades group by 1, 2),
k as (select symbol, ts, a[1:5] as asks, list_reverse(a)[1:5] as bids from b)
select symbol, ts, list_max(list_transform(bids, lambda x: x.price)) as best_bid, list_min(list_transform(asks, lambda x: x.price)) as best_ask,
       list_min(list_transform(asks, lambda x: x.price)) - list_max(list_transform(bids, lambda x: x.price)) as spread, true as bids_sorted, true as asks_sorted,
       cast(list_sum(list_transform(bids, lambda x: x.size)) as bigint) as bid_depth, cast(list_sum(list_transform(asks, lambda x: x.size)) as bigint) as ask_depth from k""")
def order_book(spark, d):
    return V.order_book_checks(_books(spark, d))


@Q.add("a18_dq1_completeness", f"with {ND} " + " union all ".join(f"select '{k}' as \"column\", count(*) filter ({k} is null) as nulls, count(*) as total, 1 - count(*) filter ({k} is null) / count(*) as completeness from nd" for k in ("symbol", "ts", "price", "size")))
def completeness(spark, d):
    return V.completeness(_numeric_dirty(spark, d), ["symbol", "ts", "price", "size"])


@Q.add("a19_dq5_uniqueness", f"with {X.DIRTY} " + " union all ".join(f"select '{n}' as \"column\", count(distinct {e}) as distinct_values, count(*) as total, count(distinct {e}) / count(*) as uniqueness from dirty"
       for n, e in (("key", "(symbol, ts, trade_id)"), ("symbol", "symbol"), ("trade_id", "trade_id"), ("ts", "ts"))))
def uniqueness(spark, d):
    return V.uniqueness(X.dirty_trades(spark, d), ["symbol", "ts", "trade_id"], ["symbol", "trade_id", "ts"])


@Q.add("dq2_dq3_dq4_dq6_assess", f"""with {X.DIRTY}, n as (select {SYM} as symbol, ts, trade_id, price, cast(size as bigint) as size, ingested from dirty),
o as (select *, ts >= lag(ts) over (partition by symbol order by trade_id, ingested) as in_order, epoch(ingested) - epoch(ts) as latency from n),
a as (select avg((cast(symbol is not null as integer) + cast(ts is not null as integer) + cast(price is not null as integer)) / 3) as completeness,
  (avg(cast(coalesce(price > 0, false) as double)) + avg(cast(coalesce(size >= 0, false) as double)) + avg(cast(coalesce(regexp_matches(symbol, '^[A-Z]{{1,10}}$'), false) as double))) / 3 as accuracy,
  avg(cast(coalesce(in_order, true) as double)) as consistency, avg(greatest(0.0, least(1.0, 1 - (latency - 300) / 300))) as timeliness, avg(cast(latency > 600 as double) * 100) as late_pct,
  count(distinct (symbol, ts, trade_id)) / count(*) as uniqueness from o),
b as (select *, (completeness + accuracy + consistency + timeliness + uniqueness) / 5 as overall from a)
select *, case when overall >= 0.95 then 'A' when overall >= 0.85 then 'B' when overall >= 0.75 then 'C' when overall >= 0.65 then 'D' else 'F' end as grade,
  concat_ws(',', case when completeness < 0.8 then 'completeness' end, case when accuracy < 0.8 then 'accuracy' end, case when consistency < 0.8 then 'consistency' end,
  case when timeliness < 0.8 then 'timeliness' end, case when uniqueness < 0.8 then 'uniqueness' end) as recommendations from b""")
def assess(spark, d):
    t = X.dirty_trades(spark, d).select(C.clean_symbol(F.col("symbol")).alias("symbol"), "ts", "trade_id", "price", F.col("size").cast("long").alias("size"), "ingested")
    return V.assess(t)


_RULES = [("price_positive", "price", "price > 0"), ("size_in_range", "size", "size between 1 and 99"), ("symbol_pattern", "symbol", "symbol rlike '^[A-Z]+$'")]


@Q.add("fv2_custom_rules", f"with {ND} " + " union all ".join(
    f"select '{n}' as rule, count(*) filter (not coalesce({c}, false)) as failed, count(*) as total, 1 - count(*) filter (not coalesce({c}, false)) / count(*) as pass_rate from nd"
    for n, c in (("price_positive", "price > 0"), ("size_in_range", "size between 1 and 99"), ("symbol_pattern", "regexp_matches(symbol, '^[A-Z]+$')"))))
def rules(spark, d):
    return V.check_rules(_numeric_dirty(spark, d), _RULES)


@Q.add("dv6_conform", f"""with {X.DIRTY} select trade_id, cast(price as double) as price, try_cast(size as bigint) as size, cast(null as varchar) as venue,
  list_filter([case when price is null then 'price' end], lambda x: x is not null) as conform_errors from dirty""")
def conform(spark, d):
    rows = X.dirty_trades(spark, d)
    return V.conform(rows, {"trade_id": ("long", False), "price": ("double", False), "size": ("long", True), "venue": ("string", True)})


@Q.add("mv1_bar_report", f"""with {X.bars_sql()} select symbol, count(*) as bars, count(*) filter (high < greatest(open, close)) as high_errors, count(*) filter (low > least(open, close)) as low_errors,
count(*) filter (volume < 0) as negative_volume, count(*) filter (close <= 0) as bad_prices, var_samp(close) as close_variance from bars group by 1""")
def bar_report(spark, d):
    return X.bars(spark, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_errors"), F.count_if(F.col("low") > F.least("open", "close")).alias("low_errors"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("close") <= 0).alias("bad_prices"), F.var_samp("close").alias("close_variance"),
    )
