"""Rolling statistics over hourly bars of the trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.functions import frames
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.functions import rolling as R
from ticklattice.plans import Queries
from ticklattice.plans.q_indicators import BARS, W, _full, _w
from ticklattice.sources import fixtures as X

Q = Queries()
LAG = f"lag(close) over ({W})"
RET = f", x as (select *, close / nullif({LAG}, 0) - 1 as ret, ln(close / nullif({LAG}, 0)) as log_ret from bars)"


def _bars(spark, d, **columns):
    return frames.columns(X.bars(spark, d), "symbol", "ts", **columns)


def _built(spark, d, build, columns):
    return frames.framed(X.bars(spark, d), build).select("symbol", "ts", *columns)


def _returns(spark, d):
    return frames.columns(X.bars(spark, d), "symbol", "ts", "open", "high", "low", "close", "volume", **R.returns())


def _stat(s: str, x: str, w: str) -> str:
    return {
        "mean": f"avg({x}) over {w}", "std": f"stddev_samp({x}) over {w}", "var": f"var_samp({x}) over {w}", "min": f"min({x}) over {w}", "max": f"max({x}) over {w}",
        "sum": f"sum({x}) over {w}", "median": f"quantile_cont({x}, 0.5) over {w}", "q25": f"quantile_cont({x}, 0.25) over {w}", "q75": f"quantile_cont({x}, 0.75) over {w}",
        "skew": f"case when count({x}) over {w} >= 3 and var_pop({x}) over {w} > 0 then skewness({x}) over {w} end",
        "kurt": f"case when count({x}) over {w} >= 4 and var_pop({x}) over {w} > 0 then kurtosis({x}) over {w} end",
    }[s]


@Q.add("rs1_rolling_statistics", f"with {BARS} select symbol, ts, " + ", ".join(f"{_stat(s, 'close', _w(n))} as {s}_{n}" for n in (5, 20) for s in R.ALL_STATS) + " from bars")
def rs1(spark, d):
    return _built(spark, d, lambda bars: R.with_rolling_statistics(bars, "close"), [f"{s}_{n}" for n in (5, 20) for s in R.ALL_STATS])


@Q.add("rs2_z_score", f"with {BARS} select symbol, ts, (close - avg(close) over {_w(20)}) / nullif(stddev_samp(close) over {_w(20)}, 0) as z_20 from bars")
def rs2(spark, d):
    return _bars(spark, d, z_20=R.z_score("close", 20))


@Q.add("rs3_percentile_rank", f"""with {BARS}, x as (select *, array_agg(close) over {_w(20)} as a from bars),
y as (select symbol, ts, len(a) - 1 as n, len(list_filter(a[1:len(a) - 1], lambda v: v < close)) as lo, len(list_filter(a[1:len(a) - 1], lambda v: v = close)) as eq from x)
select symbol, ts, case when n = 0 then 50.0 else (lo * 2 + eq + case when eq > 0 then 1 else 0 end) * 50.0 / n end as rank_20 from y""")
def rs3(spark, d):
    return _built(spark, d, lambda bars: R.with_percentile_rank(bars, "close", 20, "rank_20"), ["rank_20"])


@Q.add("rs4_entropy", f"""with {BARS}, x as (select symbol, ts, array_agg(close) over {_w(20)} as a, min(close) over {_w(20)} as lo, max(close) over {_w(20)} as hi from bars),
y as (select *, list_transform(a, lambda v: case when hi > lo then least(floor((v - lo) / ((hi - lo) / 10)), 9) else 0 end) as b from x)
select symbol, ts, case when len(a) >= 20 then -list_sum(list_transform(range(0, 10), lambda k: case when len(list_filter(b, lambda z: z = k)) > 0 then
  len(list_filter(b, lambda z: z = k)) / len(b) * log2(len(list_filter(b, lambda z: z = k)) / len(b)) else 0.0 end)) end as entropy_20 from y""")
def rs4(spark, d):
    return _bars(spark, d, entropy_20=R.entropy("close", 20))


@Q.add("rs5_correlation", f"with {BARS} select symbol, ts, corr(close, volume) over {_w(20)} as corr_20 from bars")
def rs5(spark, d):
    return _bars(spark, d, corr_20=R.correlation("close", "volume", 20))


MARKET = RET + ", m as (select ts, avg(ret) as market from x group by ts), j as (select x.*, market from x join m using (ts))"


def with_market(returns):
    """J7: each return beside the mean return of all symbols at its time."""
    market = returns.groupBy(F.col("ts").alias("mts")).agg(F.avg("ret").alias("market"))
    return returns.join(market, F.col("ts") == F.col("mts")).drop("mts")


@Q.add("rs6_j7_beta", f"""with {BARS}{MARKET} select symbol, ts, market, {_full("ret", 20, f"covar_samp(ret, market) over {_w(20)} / nullif(var_samp(market) over {_w(20)}, 0)")} as beta_20,
{_full("ret", 20, f"covar_samp(ret, market) over {_w(20)} / nullif(var_samp(market) over {_w(20)}, 0) * 20.0 / 19.0").replace("20.0 / 19.0", f"(count(market) over {_w(20)}) / nullif(count(market) over {_w(20)} - 1, 0)")} as beta_mixed from j""")
def rs6(spark, d):
    beta = {"beta_20": R.beta("ret", "market", 20), "beta_mixed": R.beta("ret", "market", 20, "mixed")}
    return frames.columns(with_market(_returns(spark, d)), "symbol", "ts", "market", **beta)


@Q.add("rs7_rs10_volatility", f"""with {BARS}{RET}, y as (select *, ln(high / nullif(low, 0)) ** 2 as p from x)
select symbol, ts, {_full("ret", 20, f"stddev_samp(ret) over {_w(20)} * sqrt(252)")} as vol_20, {_full("p", 20, f"sqrt(avg(p) over {_w(20)} / (4 * ln(2)) * 252)")} as parkinson_20 from y""")
def rs7(spark, d):
    return frames.columns(_returns(spark, d), "symbol", "ts", vol_20=R.realized_volatility("ret", 20), parkinson_20=R.parkinson(20))


@Q.add("rs8_garch", f"""with {BARS}{RET}, v as (select *, var_samp(ret) over (partition by symbol) as var, lag(ret) over ({W}) as prior, row_number() over ({W}) as r from x),
t as (select symbol, ts, case when r = 1 then var else {1 - 0.1 - 0.85!r} * var + 0.1 * coalesce(prior ** 2, 0) end as term from v),
a as (select symbol, ts, array_agg(cast(term as double)) over ({W} rows unbounded preceding) as terms from t)
select symbol, ts, sqrt(list_reduce(terms, lambda acc, v: acc * cast(0.85 as double) + v)) as garch_vol from a""")
def rs8(spark, d):
    return R.with_garch(_returns(spark, d), "ret").select("symbol", "ts", "garch_vol")


@Q.add("rs9_vol_of_vol", f"""with {BARS}{RET}, y as (select symbol, ts, {_full("ret", 20, f"stddev_samp(ret) over {_w(20)} * sqrt(252)")} as vol from x)
select symbol, ts, {_full("vol", 20, f"stddev_samp(vol) over {_w(20)}")} as vol_of_vol from y""")
def rs9(spark, d):
    def twice(returns):
        vol = returns.select("symbol", "ts", R.realized_volatility("ret", 20).alias("vol"))
        return vol.select("symbol", "ts", I.full("vol", 20, F.stddev_samp("vol").over(I.rows(20))).alias("vol_of_vol"))

    return frames.framed(_returns(spark, d), twice)


@Q.add("rs11_momentum_family", f"with {BARS} select symbol, ts, " + ", ".join(
    f"close - lag(close, {p}) over ({W}) as diff_{p}, (close - lag(close, {p}) over ({W})) / nullif(lag(close, {p}) over ({W}), 0) as pct_{p}, ln(close / nullif(lag(close, {p}) over ({W}), 0)) as log_{p}" for p in (5, 10)) + " from bars")
def rs11(spark, d):
    return _bars(spark, d, **R.momentum_family("close"))


@Q.add("rs12_mean_reversion", f"with {BARS} select symbol, ts, (close - avg(close) over {_w(20)}) / nullif(avg(close) over {_w(20)}, 0) as ma_gap_20 from bars")
def rs12(spark, d):
    return _bars(spark, d, ma_gap_20=F.try_divide(F.col("close") - I.sma(n=20), I.sma(n=20)))


_N = f"count(close) over {_w(20)} >= 5"


@Q.add("rs13_moments", f"""with {BARS}, x as (select *, array_agg(close) over {_w(20)} as a, avg(close) over {_w(20)} as m from bars)
select symbol, ts, case when {_N} then {_stat("skew", "close", _w(20))} end as skew_20, case when {_N} then {_stat("kurt", "close", _w(20))} end as kurt_20,
       case when len(a) >= 5 and list_max(a) > list_min(a) then list_avg(list_transform(a, lambda v: (v - m) ** 3)) end as m3_20,
       case when len(a) >= 5 and list_max(a) > list_min(a) then list_avg(list_transform(a, lambda v: (v - m) ** 4)) end as m4_20 from x""")
def rs13(spark, d):
    return _bars(spark, d, **R.moments("close", 20))


@Q.add("rs14_distribution", f"""with {BARS} select symbol, ts, """ + ", ".join(f"case when count(close) over {_w(50)} >= 10 then {v} end as {k}" for k, v in {
    "mean": _stat("mean", "close", _w(50)), "std": _stat("std", "close", _w(50)), "skew": _stat("skew", "close", _w(50)), "kurt": _stat("kurt", "close", _w(50)),
    "iqr": f"quantile_cont(close, 0.75) over {_w(50)} - quantile_cont(close, 0.25) over {_w(50)}", "tail_range": f"quantile_cont(close, 0.95) over {_w(50)} - quantile_cont(close, 0.05) over {_w(50)}",
    "cv": f"stddev_samp(close) over {_w(50)} / nullif(avg(close) over {_w(50)}, 0)"}.items()) + " from bars")
def rs14(spark, d):
    return _built(spark, d, lambda bars: R.with_distribution(bars, "close"), ["mean", "std", "skew", "kurt", "iqr", "tail_range", "cv"])


def _acf(k: int) -> str:
    return _full("close", 50, f"corr(close, l{k}) over ({W} rows between {49 - k} preceding and current row)")


_LAGS = ", x as (select *, " + ", ".join(f"lag(close, {k}) over ({W}) as l{k}" for k in range(1, 6)) + " from bars)"


@Q.add("rs15_autocorrelation", f"with {BARS}{_LAGS} select symbol, ts, {_acf(1)} as acf_1, {_acf(5)} as acf_5 from x")
def rs15(spark, d):
    return frames.framed(X.bars(spark, d), lambda bars: R.with_autocorrelations(bars, "close")).select("symbol", "ts", "acf_1", "acf_5")


@Q.add("rs16_ljung_box", f"with {BARS}{_LAGS} select symbol, ts, (" + " + ".join(f"({_acf(k)}) ** 2 / {50 - k}" for k in range(1, 6)) + ") * 50 * 52 as ljung_box from x")
def rs16(spark, d):
    return frames.framed(X.bars(spark, d), lambda bars: R.with_ljung_box(bars, "close")).select("symbol", "ts", "ljung_box")


@Q.add("rs17_lag_features", f"with {BARS} select symbol, ts, " + ", ".join(
    f"lag(close, {k}) over ({W}) as lag_{k}, close - lag(close, {k}) over ({W}) as diff_{k}, close / nullif(lag(close, {k}) over ({W}), 0) - 1 as pct_{k}" for k in (1, 2, 3)) + " from bars")
def rs17(spark, d):
    return _bars(spark, d, **R.lag_features("close"))


@Q.add("rs18_returns", f"with {BARS}{RET} select symbol, ts, ret, log_ret, close / first_value(close) over ({W}) - 1 as cum_ret from x")
def rs18(spark, d):
    return R.with_cumulative_return(_returns(spark, d)).select("symbol", "ts", "ret", "log_ret", "cum_ret")


_R19 = ", ".join(f"case when count(ret) over {_w(20)} >= 5 then {_stat(k, 'ret', _w(20))} end as ret_{k}_20" for k in ("mean", "std", "skew", "kurt", "q25", "q75"))


@Q.add("rs19_feature_set", f"""with {BARS}{RET}, r as (select *, {_R19} from x)
select symbol, ts, r.open, r.high, r.low, r.close, r.volume, r.vwap, r.trade_count, r.ret, r.log_ret, ret_mean_20, ret_std_20, ret_skew_20, ret_kurt_20, ret_q25_20, ret_q75_20,
  z_20, rank_20, vol_20, parkinson_20, ma_gap_20, diff_5, pct_5, log_5, diff_10, pct_10, log_10,
  entropy_20, skew_20, kurt_20, m3_20, m4_20, iqr as iqr_50, tail_range as tail_range_50, acf_1, acf_5, ljung_box from r """ + " ".join(
    f"join ({Q.sql[n]}) q{k} using (symbol, ts)" for k, n in enumerate(("rs2_z_score", "rs3_percentile_rank", "rs7_rs10_volatility", "rs12_mean_reversion", "rs11_momentum_family",
                                                                          "rs4_entropy", "rs13_moments", "rs14_distribution", "rs15_autocorrelation", "rs16_ljung_box"))))
def rs19(spark, d):
    return frames.framed(X.bars(spark, d), R.feature_set)


@Q.add("rs21_streaks", f"""with {BARS}, x as (select symbol, ts, sign(close - {LAG}) as s, row_number() over ({W}) as r from bars),
y as (select *, r - row_number() over (partition by symbol, s order by ts) as island from x)
select symbol, ts, cast(case when s is not null and s <> 0 then row_number() over (partition by symbol, s, island order by ts) else 0 end as integer) as streak,
       cast(sum(case when s <> 0 then 1 else 0 end) over {_w(11)} as bigint) as moves from y""")
def rs21(spark, d):
    return R.with_streaks(X.bars(spark, d)).select("symbol", "ts", "streak", "moves")
