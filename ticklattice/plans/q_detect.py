"""Anomalies, drift, as-of reads and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.operators import anomaly as A
from ticklattice.operators import asof as J
from ticklattice.operators import drift as D
from ticklattice.operators import validation as V
from ticklattice.functions import frames
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.plans import Queries
from ticklattice.plans.q_indicators import W, _full, _w
from ticklattice.plans.q_rolling import MARKET, _returns, with_market
from ticklattice.sources import fixtures as X

Q = Queries()
O = "partition by symbol order by ts, trade_id"  # noqa: E741
W100, W50, W10 = (f"({O} rows between {n} preceding and current row)" for n in (100, 50, 10))
_DETECT = f"""{X.TRADES}, s as (select *, abs((price - avg(price) over {W100}) / nullif(stddev_samp(price) over {W100}, 0)) as z, quantile_cont(price, 0.25) over {W100} as q1, quantile_cont(price, 0.75) over {W100} as q3,
  (price - lag(price) over ({O})) / nullif(lag(price) over ({O}), 0) as mv, abs((size - avg(size) over {W50}) / nullif(stddev_samp(size) over {W50}, 0)) as vz, size / nullif(avg(size) over {W50}, 0) as vr,
  sign(price - lag(price) over ({O})) as sg from trades),
t as (select *, lag(sg) over ({O}) as psg, q1 - (q3 - q1) * 1.5 as lo, q3 + (q3 - q1) * 1.5 as hi from s),
u as (select *, cast(sum(case when sg = psg and sg <> 0 then 1 else 0 end) over {W10} as bigint) as same from t),
f as (select *, coalesce(z > 3, false) as is_zscore, coalesce(price < lo or price > hi, false) as is_iqr, coalesce(abs(mv) > 0.05, false) as is_spike,
  coalesce(vz > 3, false) or coalesce(vr > 5, false) or coalesce(vr < 0.1, false) as is_volume, same >= 8 as is_pattern from u),
g as (select symbol, ts, trade_id, is_zscore, is_iqr, is_spike, is_volume, is_pattern, least(case when is_zscore then coalesce(z / 3, 0) else 0 end, 1.0) as anomaly_score_zscore,
  least(case when is_iqr then coalesce(greatest(lo - price, price - hi, 0) / nullif(q3 - q1, 0), 0) else 0 end, 1.0) as anomaly_score_iqr,
  least(case when is_spike then coalesce(abs(mv) / 0.05, 0) else 0 end, 1.0) as anomaly_score_spike, least(case when is_volume then coalesce(vz / 3, 0) else 0 end, 1.0) as anomaly_score_volume,
  least(case when is_pattern then same / 11.0 else 0 end, 1.0) as anomaly_score_pattern from f)"""
_COLS = ["symbol", "ts", "trade_id", *[f"is_{m}" for m in A.METHODS], *[f"anomaly_score_{m}" for m in A.METHODS]]


@Q.add("ad1_ad4_detectors", f"with {_DETECT} select * from g")
def detectors(spark, d):
    return A.detect(X.trades(spark, d)).select(*_COLS)


@Q.add("ad7_ad8_classified", f"""with {_DETECT}, h as (select *, (anomaly_score_zscore + anomaly_score_iqr + anomaly_score_spike + anomaly_score_volume + anomaly_score_pattern) / 5 as composite_score,
  greatest(anomaly_score_zscore, anomaly_score_iqr, anomaly_score_spike, anomaly_score_volume, anomaly_score_pattern) as max_score,
  cast(is_zscore as integer) + cast(is_iqr as integer) + cast(is_spike as integer) + cast(is_volume as integer) + cast(is_pattern as integer) as methods_fired from g)
select symbol, ts, trade_id, composite_score, max_score, methods_fired, case when max_score >= 0.8 then 'CRITICAL' when max_score >= 0.6 then 'WARNING' when max_score > 0 then 'INFO' end as severity,
  case when is_spike then 'price_spike' when is_volume then 'volume' when is_pattern then 'pattern' when is_zscore or is_iqr then 'statistical' end as primary_type from h""")
def classified(spark, d):
    return A.classify(A.detect(X.trades(spark, d))).select("symbol", "ts", "trade_id", "composite_score", "max_score", "methods_fired", "severity", "primary_type")


@Q.add("ad5_outlier_3sigma", f"with {X.TRADES} select trade_id, coalesce(abs(price - avg(price) over w) > stddev_samp(price) over w * 3, false) as is_outlier from trades window w as ({O} rows between 49 preceding and current row)")
def sigma(spark, d):
    return A.outlier_3sigma(X.trades(spark, d)).select("trade_id", "is_outlier")


@Q.add("ad6_correlation_breaks", f"""with {X.bars_sql()}{MARKET}, k as (select symbol, ts, {_full("ret", 20, f"corr(ret, market) over {_w(20)}")} as market_corr from j),
z as (select *, (market_corr - avg(market_corr) over f) / nullif(stddev_samp(market_corr) over f, 0) as corr_z from k window f as ({W} rows between 100 preceding and 1 preceding))
select *, coalesce(abs(corr_z) > 3, false) as is_corr_break from z""")
def correlation_breaks(spark, d):
    return frames.framed(with_market(_returns(spark, d)), A.correlation_breaks).select("symbol", "ts", "market_corr", "corr_z", "is_corr_break")


#: Components of the given embeddings, all of them.
DIMENSIONS = 64
FEATURES = [f"f{k}" for k in range(DIMENSIONS)]


def matrix(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(DIMENSIONS)])


MATRIX = "matrix as (select vec_id, label, " + ", ".join(f"cast(embedding[{k + 1}] as double) as f{k}" for k in range(DIMENSIONS)) + " from embeddings)"
LONG = f"long as (select vec_id, cast(i as integer) as k, cast(embedding[i + 1] as double) as x from embeddings, range({DIMENSIONS}) r(i))"
_P = ", ".join(f"avg({f}) as {f}_m, stddev_pop({f}) as {f}_s, quantile_cont({f}, 0.5) as {f}_med, quantile_cont({f}, 0.25) as {f}_q1, quantile_cont({f}, 0.75) as {f}_q3" for f in FEATURES)


@Q.add("ad9_matrix_scores", f"""with {MATRIX}, p as (select {_P} from matrix), m as (select {", ".join(f"quantile_cont(abs({f} - {f}_med), 0.5) as {f}_mad" for f in FEATURES)} from matrix, p)
select vec_id, greatest({", ".join(f"abs(({f} - {f}_m) / nullif({f}_s, 0))" for f in FEATURES)}) as z_score, greatest({", ".join(f"abs(({f} - {f}_med) * 0.6745 / nullif({f}_mad, 0))" for f in FEATURES)}) as modified_z,
  greatest({", ".join(f"greatest({f}_q1 - {f}, {f} - {f}_q3, 0) / nullif({f}_q3 - {f}_q1, 0)" for f in FEATURES)}) as iqr_score from matrix, p, m""")
def matrix_scores(spark, d):
    m = matrix(spark, d)
    return A.score_params(m, A.fit_params(m, FEATURES), FEATURES).select("vec_id", "z_score", "modified_z", "iqr_score")


@Q.add("ad10_series_detectors", f"""with {X.bars_sql()}, a as (select *, count(close) over w >= 10 as ok, avg(close) over w as m, stddev_samp(close) over w as s, array_agg(close) over ({W} rows between 2 preceding and 2 following) as near
  from bars window w as {_w(20)}),
b as (select *, list_sort(near)[cast(floor((len(near) + 1) / 2) as integer)] as med from a), e as (select *, list_sort(list_transform(near, lambda v: abs(v - med)))[cast(floor((len(near) + 1) / 2) as integer)] as mad from b)
select symbol, ts, coalesce(ok and abs(close - m) > s * 3, false) as is_ma, coalesce(ok and (close > m + 2 * s or close < m - 2 * s), false) as is_bollinger, coalesce(abs(close - med) > mad * 1.4826 * 3, false) as is_hampel from e""")
def series(spark, d):
    return frames.framed(X.bars(spark, d), A.series_detectors)


@Q.add("ad11_seasonal_residuals", f"""with {X.bars_sql()}, a as (select symbol, ts, close, avg(close) over ({W} rows between 12 preceding and 12 following) as trend, (row_number() over ({W}) - 1) % 24 as place from bars),
b as (select *, close - trend as dt from a), e as (select *, avg(dt) over (partition by symbol, place) - avg(dt) over (partition by symbol) as seasonal from b), f as (select *, dt - seasonal as residual from e)
select symbol, ts, close, trend, cast(place as integer) as place, seasonal, residual, coalesce(abs(residual - avg(residual) over (partition by symbol)) > stddev_samp(residual) over (partition by symbol) * 3, false) as is_seasonal from f""")
def seasonal(spark, d):
    return A.seasonal_residuals(X.bars(spark, d))


@Q.add("ad12_ad15_combine", f"""with {_DETECT}, v as (select trade_id, is_zscore::int::double as a, is_iqr::int::double as b, is_spike::int::double as c from g), x as (select *, (a * 2 + b + c) / 4 as wv from v)
select trade_id, (a + b + c) / 3 as mean_vote, (a + b + c) * 2 > 3 as majority, wv as weighted_vote, wv >= 0.5 as weighted_majority, coalesce(a * 0.5 / nullif(wv, 0), 0) as part_is_zscore,
  coalesce(b * 0.25 / nullif(wv, 0), 0) as part_is_iqr, coalesce(c * 0.25 / nullif(wv, 0), 0) as part_is_spike from x""")
def combined(spark, d):
    rows = A.detect(X.trades(spark, d)).select("trade_id", "is_zscore", "is_iqr", "is_spike")
    return A.combine(rows, ["is_zscore", "is_iqr", "is_spike"], {"is_zscore": 2.0, "is_iqr": 1.0, "is_spike": 1.0}).drop("is_zscore", "is_iqr", "is_spike")


# Features: a long table of two indicators of the daily bars, ingested an hour after their time.


def features(spark, d):
    b = X.bars(spark, d, "1 day").select("symbol", "ts", I.sma(n=5).alias("sma_5"), I.rsi(n=5).alias("rsi_5"), F.col("volume").cast("double").alias("volume"))
    long = b.unpivot(["symbol", "ts"], ["sma_5", "rsi_5", "volume"], "feature_id", "value")
    return long.select("feature_id", F.col("symbol").alias("entity_id"), F.col("ts").alias("event_ts"), F.expr("ts + interval 1 hour").alias("ingested"), "value")


_RSI5 = _full("delta", 5, f"case when avg(case when delta < 0 then -delta when delta is not null then 0 end) over {_w(5)} = 0 and avg(case when delta > 0 then delta when delta is not null then 0 end) over {_w(5)} > 0 then 100 else 100 - 100 / (1 + avg(case when delta > 0 then delta when delta is not null then 0 end) over {_w(5)} / nullif(avg(case when delta < 0 then -delta when delta is not null then 0 end) over {_w(5)}, 0)) end")
FEATS = f"""{X.bars_sql("1 day")}, bd as (select *, close - lag(close) over ({W}) as delta from bars),
wide as (select symbol, ts, avg(close) over {_w(5)} as sma_5, {_RSI5} as rsi_5, cast(volume as double) as volume from bd),
feats as (select feature_id, symbol as entity_id, ts as event_ts, ts + interval 1 hour as ingested, value from (
  select 'sma_5' as feature_id, symbol, ts, sma_5 as value from wide union all select 'rsi_5', symbol, ts, rsi_5 from wide union all select 'volume', symbol, ts, volume from wide))"""


@Q.add("fs1_long_features", f"with {FEATS} select * from feats")
def long_features(spark, d):
    return features(spark, d)


@Q.add("j3_fs2_feature_matrix", f"with {FEATS} select entity_id, event_ts, max(value) filter (feature_id = 'rsi_5') as rsi_5, max(value) filter (feature_id = 'sma_5') as sma_5, max(value) filter (feature_id = 'volume') as volume from feats group by 1, 2")
def feature_matrix(spark, d):
    return features(spark, d).groupBy("entity_id", "event_ts").pivot("feature_id", ["rsi_5", "sma_5", "volume"]).agg(F.max("value"))


@Q.add("sl2_latest_features", f"with {FEATS} select feature_id, entity_id, event_ts, ingested, value from feats qualify row_number() over (partition by feature_id, entity_id order by event_ts desc, ingested desc) = 1")
def latest_features(spark, d):
    return J.latest(features(spark, d), ["feature_id", "entity_id"], ["event_ts", "ingested"])


def _spine(spark, d):
    return X.trades(spark, d).select("symbol", "ts", "trade_id", "price")


@Q.add("j4_as_of_join", f"with {X.bars_sql()}, j as (select t.symbol, t.ts, t.trade_id, b.ts as value_ts, b.close from trades t asof left join bars b on t.symbol = b.symbol and t.ts >= b.ts) select * from j")
def as_of(spark, d):
    return J.as_of(_spine(spark, d), X.bars(spark, d), columns=["close"], part="7 days").select("symbol", "ts", "trade_id", "value_ts", "close")


@Q.add("j5_staleness_bounded", f"""with {X.bars_sql()}, j as (select t.symbol, t.ts, t.trade_id, b.ts as bts, b.close from trades t asof left join (select symbol, ts + interval 1 hour as ts, close from bars) b on t.symbol = b.symbol and t.ts >= b.ts)
select symbol, ts, trade_id, case when ts - bts <= interval 60 minutes then close else 0.0 end as close from j""")
def stale(spark, d):
    closed = X.bars(spark, d).select("symbol", F.expr("ts + interval 1 hour").alias("ts"), "close")
    return J.as_of(_spine(spark, d), closed, columns=["close"], within="60 minutes").select("symbol", "ts", "trade_id", F.coalesce("close", F.lit(0.0)).alias("close"))


@Q.add("j4_bitemporal", f"""with {FEATS}, s as (select symbol as entity_id, ts, trade_id from trades), v as (select * from feats where feature_id = 'volume'),
m as (select s.trade_id, max(struct_pack(a := v.event_ts, b := v.value)) as best from s left join v on s.entity_id = v.entity_id and v.event_ts <= s.ts and v.ingested <= s.ts group by 1)
select s.entity_id, s.ts, s.trade_id, best.a as event_ts, best.b as value from s join m using (trade_id)""")
def bitemporal(spark, d):
    spine = X.trades(spark, d).select(F.col("symbol").alias("entity_id"), "ts", "trade_id")
    return J.bitemporal(spine, features(spark, d).filter("feature_id = 'volume'").drop("feature_id"))


@Q.add("j10_failed_entities", f"with {FEATS} select distinct symbol from trades where symbol not in (select entity_id from feats where feature_id = 'rsi_5' and value > 60)")
def failed(spark, d):
    good = features(spark, d).filter("feature_id = 'rsi_5' and value > 60").select(F.col("entity_id").alias("symbol"))
    return X.trades(spark, d).select("symbol").distinct().join(good, "symbol", "left_anti")


@Q.add("snk5_upsert", f"""with {X.bars_sql("1 day")}, n as (select symbol, ts + interval 1 day as ts, close * 2 as close from bars), o as (select symbol, ts, close from bars)
select * from n union all select * from o where not exists (select 1 from n where n.symbol = o.symbol and n.ts = o.ts)""")
def upsert(spark, d):
    old = X.bars(spark, d, "1 day").select("symbol", "ts", "close")
    return J.upsert(old, old.select("symbol", F.expr("ts + interval 1 day").alias("ts"), (F.col("close") * 2).alias("close")), ["symbol", "ts"])


@Q.add("snk5_insert_absent", f"""with {X.bars_sql("1 day")}, n as (select symbol, ts + interval 1 day as ts, close * 2 as close from bars), o as (select symbol, ts, close from bars)
select * from o union all select * from n where not exists (select 1 from o where n.symbol = o.symbol and n.ts = o.ts)""")
def insert_absent(spark, d):
    old = X.bars(spark, d, "1 day").select("symbol", "ts", "close")
    return J.insert_absent(old, old.select("symbol", F.expr("ts + interval 1 day").alias("ts"), (F.col("close") * 2).alias("close")), ["symbol", "ts"])


@Q.add("snk6_delete_where", f"with {FEATS} select * from feats where not coalesce(value > 50, false)")
def delete_where(spark, d):
    return J.delete_where(features(spark, d), "value > 50")


CUR = "case when symbol in ('VIEW', 'CLICK') then 'USD' when symbol = 'ERROR' then 'EUR' else 'GBP' end"


@Q.add("j12_currency", f"""with {X.TRADES}, p as (select symbol, ts, trade_id, price, {CUR} as currency from trades),
r as (select case when symbol = 'VIEW' then 'EUR' else 'GBP' end as currency, ts, arg_max(1 + price / 100, trade_id) as rate from trades where symbol in ('VIEW', 'CLICK') group by 1, 2)
select p.symbol, p.ts, p.trade_id, p.price, p.currency, p.price * case when p.currency = 'USD' then 1.0 else r.rate end as price_base from p asof left join r on p.currency = r.currency and p.ts >= r.ts""")
def currency(spark, d):
    t = X.trades(spark, d)
    prices = t.select("symbol", "ts", "trade_id", "price", F.expr(CUR).alias("currency"))
    rates = t.filter("symbol in ('VIEW', 'CLICK')").groupBy(F.expr("case when symbol = 'VIEW' then 'EUR' else 'GBP' end").alias("currency"), "ts").agg(F.max_by(1 + F.col("price") / 100, "trade_id").alias("rate"))
    return J.convert_currency(prices, rates)


def drift_rows(spark, d):
    """First 20 days against the rest, of three features of the trades."""
    t = X.trades(spark, d).select((F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")).alias("is_new"), "price", F.col("size").cast("double").alias("size"), (F.col("price") * F.col("size")).alias("value_traded"))
    return t.unpivot(["is_new"], ["price", "size", "value_traded"], "feature_id", "value")


DRIFT = f"""{X.TRADES}, dr as (select feature_id, is_new, value from (select ts >= timestamp '2024-01-21' as is_new, price, cast(size as double) as size, price * size as value_traded from trades)
  unpivot (value for feature_id in (price, size, value_traded)))"""
_DIST = f"""{DRIFT}, k as (select feature_id, value, count(*) filter (not is_new) as o, count(*) filter (is_new) as n from dr group by 1, 2),
r as (select *, sum(o) over w / sum(o) over a as fo, sum(n) over w / sum(n) over a as fn, lead(value) over (partition by feature_id order by value) - value as dx from k
  window w as (partition by feature_id order by value rows unbounded preceding), a as (partition by feature_id)),
ks as (select feature_id, cast(sum(o) as bigint) as n_old, cast(sum(n) as bigint) as n_new, max(abs(fo - fn)) as ks, sum(abs(fo - fn) * dx) as wasserstein,
  sum(abs(fo - fn) * dx) / nullif(max(value) filter (o > 0) - min(value) filter (o > 0), 0) as wasserstein_norm from r group by 1)"""


@Q.add("dr1_dr4_distances", f"with {_DIST} select * from ks")
def distances(spark, d):
    return D.distances(drift_rows(spark, d)).drop("ks_p")


@Q.add("dr2_dr3_binned_tests", f"""with {DRIFT}, e as (select feature_id, min(value) as lo, max(value) as hi from dr where not is_new group by 1),
b as (select dr.feature_id, case when value between lo and hi then least(floor((value - lo) / nullif(hi - lo, 0) * 10), 9) end as bin, count(*) filter (not is_new) as o, count(*) filter (is_new) as n from dr join e using (feature_id) group by 1, 2),
t as (select *, sum(o) over (partition by feature_id) as no, sum(n) over (partition by feature_id) as nn from b),
p as (select *, greatest(o / no, 1e-6) as p, greatest(n / nn, 1e-6) as q, o * nn / no as ex from t where bin is not null)
select feature_id, sum((q - p) * ln(q / p)) as psi, sum(case when ex > 0 then (n - ex) ** 2 / ex end) as chi_square, sqrt(sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)) as js_distance from p group by 1""")
def binned(spark, d):
    return D.binned_tests(drift_rows(spark, d))


_KS_X = "(sqrt(n_old * n_new / (n_old + n_new)) + 0.12 + 0.11 / sqrt(n_old * n_new / (n_old + n_new))) * ks"


@Q.add("dr5_drift_report", f"""with a as ({Q.sql["dr1_dr4_distances"]}), b as ({Q.sql["dr2_dr3_binned_tests"]}),
k as (select *, case when {_KS_X} < 0.2 then 1.0 else greatest(0.0, least(1.0, list_sum(list_transform(range(1, 21), lambda k: 2 * pow(-1, k - 1) * exp(-2.0 * k * k * ({_KS_X}) * ({_KS_X})))))) end as ks_p
  from a join b using (feature_id) where n_old >= 10 and n_new >= 10),
s as (select *, case when psi >= 0.25 and ks_p < 0.01 then 'high' when psi >= 0.1 or ks_p < 0.05 then 'medium' else 'none' end as severity from k)
select *, severity <> 'none' as has_drift from s""")
def drift_report(spark, d):
    return D.report(drift_rows(spark, d))


@Q.add("fv1_feature_checks", f"""with {FEATS}, q as (select feature_id, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from feats group by 1)
select feature_id, count(*) as n, count(value) / count(*) as completeness, var_samp(value) as variance, avg(cast(coalesce(value < q1 - (q3 - q1) * 1.5 or value > q3 + (q3 - q1) * 1.5, false) as double)) as outlier_ratio,
  count(distinct value) / count(*) as distinct_ratio, min(value) as least, max(value) as most,
  count(value) / count(*) >= 0.95 and var_samp(value) > 0 and avg(cast(coalesce(value < q1 - (q3 - q1) * 1.5 or value > q3 + (q3 - q1) * 1.5, false) as double)) <= 0.05 as passes from feats join q using (feature_id) group by 1""")
def feature_checks(spark, d):
    return V.check_features(features(spark, d))


@Q.add("a11_feature_statistics", f"with {FEATS} select feature_id, count(value) as n, min(event_ts) as first_ts, max(event_ts) as last_ts, avg(value) as mean, stddev_samp(value) as std, min(value) as least, quantile_cont(value, 0.5) as median, max(value) as most from feats group by 1")
def feature_statistics(spark, d):
    return features(spark, d).groupBy("feature_id").agg(
        F.count("value").alias("n"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("most"),
    )
