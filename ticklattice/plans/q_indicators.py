"""Technical indicators over hourly bars of the trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.functions import frames
from ticklattice.functions import indicators as I  # noqa: E741
from ticklattice.plans import Queries
from ticklattice.sources import fixtures as X

Q = Queries()
BARS = X.bars_sql()
W = "partition by symbol order by ts"


def _w(n: int) -> str:
    return f"({W} rows between {n - 1} preceding and current row)"


def _full(x: str, n: int, value: str) -> str:
    return f"case when count({x}) over {_w(n)} >= {n} then {value} end"


def _select(spark, d, **columns):
    return frames.columns(X.bars(spark, d), "symbol", "ts", **columns)


def _sql(body: str, ctes: str = "") -> str:
    return f"with {BARS}{ctes} select symbol, ts, {body} from " + ("bars" if not ctes else "x")


SMA_N = (5, 10, 20, 50, 100, 200)


@Q.add("ti1_sma", _sql(", ".join(f"avg(close) over {_w(n)} as sma_{n}" for n in SMA_N) + ", " + _full("close", 20, f"avg(close) over {_w(20)}") + " as sma_20_full"))
def ti1(spark, d):
    return _select(spark, d, **{f"sma_{n}": I.sma(n=n) for n in SMA_N}, sma_20_full=I.sma(n=20, variant="dash"))


def _ewm(n: int, x: str = "close", adjust: bool = True) -> str:
    a = 2 / (n + 1)
    if adjust:
        return f"list_sum(list_transform(a_{x}, lambda v, i: v * pow({1 - a!r}, len(a_{x}) - i))) / list_sum(list_transform(a_{x}, lambda v, i: pow({1 - a!r}, len(a_{x}) - i)))"
    return f"list_reduce(a_{x}, lambda acc, v: acc * {1 - a!r} + v * {a!r})"


_ARR = f", x as (select *, array_agg(close) over ({W} rows between 400 preceding and current row) as a_close from bars)"
_ALL = f", x as (select *, array_agg(close) over ({W} rows unbounded preceding) as a_close from bars)"


@Q.add("ti2_ema", f"with {BARS}{_ALL} select symbol, ts, {_ewm(12)} as ema_12, {_ewm(26)} as ema_26 from x")
def ti2(spark, d):
    return I.with_ema(X.bars(spark, d)).select("symbol", "ts", "ema_12", "ema_26")


@Q.add("ti2_ema_recursive", f"with {BARS}{_ALL} select symbol, ts, {_ewm(12, adjust=False)} as ema_12 from x")
def ti2_dash(spark, d):
    return I.with_ema(X.bars(spark, d), (12,), adjust=False).select("symbol", "ts", "ema_12")


_WMA = "list_sum(list_transform(array_agg(close) over {w}, lambda v, i: v * i)) / 210.0"


@Q.add("ti3_wma", _sql(_full("close", 20, _WMA.format(w=_w(20))) + " as wma_20"))
def ti3(spark, d):
    return _select(spark, d, wma_20=I.wma(n=20))


_DELTA = f", x as (select *, close - lag(close) over ({W}) as delta, lag(close) over ({W}) as pc, lag(high) over ({W}) as ph, lag(low) over ({W}) as pl from bars)"
_GAIN = f"avg(case when delta > 0 then delta when delta is not null then 0 end) over {_w(14)}"
_LOSS = f"avg(case when delta < 0 then -delta when delta is not null then 0 end) over {_w(14)}"


def _rsi(zero: str) -> str:
    return _full("delta", 14, f"case {zero} else 100 - 100 / (1 + {_GAIN} / nullif({_LOSS}, 0)) end")


@Q.add("ti4_rsi", _sql(
    _rsi(f"when {_LOSS} = 0 and {_GAIN} > 0 then 100") + " as rsi_ml, " + _rsi(f"when {_LOSS} = 0 then 100 - 100 / 101.0") + " as rsi_etl, "
    + _rsi(f"when {_LOSS} = 0 then 0") + " as rsi_dash", _DELTA))
def ti4(spark, d):
    return _select(spark, d, rsi_ml=I.rsi(), rsi_etl=I.rsi(variant="etl"), rsi_dash=I.rsi(variant="dash"))


@Q.add("ti5_macd", f"""with {BARS}{_ALL}, m as (select symbol, ts, {_ewm(12)} - ({_ewm(26)}) as macd from x),
x2 as (select *, array_agg(macd) over ({W} rows unbounded preceding) as a_macd from m)
select symbol, ts, macd, {_ewm(9, "macd")} as macd_signal, macd - ({_ewm(9, "macd")}) as macd_hist from x2""")
def ti5(spark, d):
    return I.with_macd(X.bars(spark, d)).select("symbol", "ts", "macd", "macd_signal", "macd_hist")


def _bb(sd: str) -> str:
    m, s = f"avg(close) over {_w(20)}", f"{sd}(close) over {_w(20)}"
    parts = {"bb_upper": f"{m} + 2 * {s}", "bb_middle": m, "bb_lower": f"{m} - 2 * {s}", "bb_width": f"4 * {s} / nullif({m}, 0) * 100",
             "bb_position": f"case when {s} = 0 then 0.5 else (close - ({m} - 2 * {s})) / nullif(4 * {s}, 0) end"}
    return ", ".join(f"{_full('close', 20, v)} as {k}" for k, v in parts.items())


@Q.add("ti6_bollinger", _sql(_bb("stddev_samp")))
def ti6(spark, d):
    return _select(spark, d, **I.bollinger())


@Q.add("ti6_bollinger_population", _sql(_bb("stddev_pop")))
def ti6_dash(spark, d):
    return _select(spark, d, **I.bollinger(variant="dash"))


_LO, _HI = f"min(low) over {_w(14)}", f"max(high) over {_w(14)}"
_K = _full("close", 14, f"(close - {_LO}) / nullif({_HI} - {_LO}, 0) * 100")


@Q.add("ti7_stochastic", f"with {BARS}, x as (select symbol, ts, {_K} as stoch_k from bars) select symbol, ts, stoch_k, {_full('stoch_k', 3, f'avg(stoch_k) over {_w(3)}')} as stoch_d from x")
def ti7(spark, d):
    smoothed = I.full("stoch_k", 3, F.avg("stoch_k").over(I.rows(3))).alias("stoch_d")
    return frames.framed(X.bars(spark, d), lambda bars: bars.select("symbol", "ts", I.stochastic_k().alias("stoch_k")).select("*", smoothed))


_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_TRX = _DELTA + f", y as (select *, {_TR} as tr from x)"


@Q.add("ti8_atr", f"with {BARS}{_TRX} select symbol, ts, tr, {_full('tr', 14, f'avg(tr) over {_w(14)}')} as atr_14 from y")
def ti8(spark, d):
    mean = I.full("tr", 14, F.avg("tr").over(I.rows(14))).alias("atr_14")
    return frames.framed(X.bars(spark, d), lambda bars: bars.select("symbol", "ts", I.true_range().alias("tr")).select("*", mean))


def _di(x: str) -> str:
    return _full(x, 14, f"avg({x}) over {_w(14)} / nullif({_full('tr', 14, f'avg(tr) over {_w(14)}')}, 0) * 100")


@Q.add("ti9_adx", f"""with {BARS}{_TRX}, u as (
    select *, case when high - ph > pl - low and high - ph > 0 then high - ph when ph is not null then 0 end as up,
           case when pl - low > high - ph and pl - low > 0 then pl - low when ph is not null then 0 end as down from y),
v as (select symbol, ts, {_di("up")} as plus_di, {_di("down")} as minus_di from u),
w as (select *, abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) * 100 as dx from v)
select symbol, ts, plus_di, minus_di, {_full("dx", 14, f"avg(dx) over {_w(14)}")} as adx from w""")
def ti9(spark, d):
    return frames.framed(X.bars(spark, d), I.with_adx).select("symbol", "ts", "plus_di", "minus_di", "adx")


@Q.add("ti10_cci", f"""with {BARS}, x as (select *, (high + low + close) / 3 as tp from bars),
y as (select *, array_agg(tp) over {_w(20)} as a, avg(tp) over {_w(20)} as m from x)
select symbol, ts, case when len(a) >= 20 then (tp - m) / nullif(list_sum(list_transform(a, lambda v: abs(v - m))) / 20 * 0.015, 0) end as cci_20 from y""")
def ti10(spark, d):
    return frames.columns(X.bars(spark, d).withColumn("tp", I.typical()), "symbol", "ts", cci_20=I.cci_of("tp"))


@Q.add("ti11_williams_r", _sql(_full("close", 14, f"({_HI} - close) / nullif({_HI} - {_LO}, 0) * -100") + " as williams_r"))
def ti11(spark, d):
    return _select(spark, d, williams_r=I.williams_r())


@Q.add("ti12_momentum_roc", _sql(f"close - lag(close, 10) over ({W}) as momentum_10, (close / nullif(lag(close, 10) over ({W}), 0) - 1) * 100 as roc_10"))
def ti12(spark, d):
    return _select(spark, d, momentum_10=I.momentum(), roc_10=I.rate_of_change())


_SUM = f"over ({W} rows unbounded preceding)"


@Q.add("ti13_ti14_ti20_ti21_cumulative", f"""with {BARS}{_DELTA}
select symbol, ts, cast(sum(case when delta > 0 then volume when delta < 0 then -volume else 0 end) {_SUM} as bigint) as obv,
       coalesce(sum(delta / nullif(pc, 0) * volume) {_SUM}, 0) as pvt,
       coalesce(sum(((close - low) - (high - close)) / nullif(high - low, 0) * volume) {_SUM}, 0) as ad_line,
       sum((high + low + close) / 3 * volume) {_SUM} / nullif(sum(volume) {_SUM}, 0) as vwap_cum from x""")
def cumulative(spark, d):
    return I.with_cumulative(X.bars(spark, d)).select("symbol", "ts", "obv", "pvt", "ad_line", "vwap_cum")


@Q.add("ti20_vwap_session", f"""with {BARS} select symbol, ts, sum((high + low + close) / 3 * volume) over s / nullif(sum(volume) over s, 0) as vwap_session
from bars window s as (partition by symbol, cast(ts as date) order by ts rows unbounded preceding)""")
def ti20(spark, d):
    return I.with_session_vwap(X.bars(spark, d)).select("symbol", "ts", "vwap_session")


def _mid(n: int) -> str:
    return _full("high", n, f"(max(high) over {_w(n)} + min(low) over {_w(n)}) / 2")


@Q.add("ti15_ichimoku", f"""with {BARS}, x as (select *, {_mid(9)} as conversion, {_mid(26)} as base, {_mid(52)} as b, lead(close, 26) over ({W}) as lagging from bars)
select symbol, ts, conversion, base, lagging, lag((conversion + base) / 2, 26) over ({W}) as span_a, lag(b, 26) over ({W}) as span_b from x""")
def ti15(spark, d):
    return frames.framed(X.bars(spark, d), I.with_ichimoku).select("symbol", "ts", "conversion", "base", "lagging", "span_a", "span_b")


@Q.add("ti16_vortex", f"""with {BARS}{_TRX}
select symbol, ts, {_full("abs(high - pl)", 14, f"sum(abs(high - pl)) over {_w(14)} / nullif(sum(tr) over {_w(14)}, 0)").replace("sum(tr)", "sum(case when pc is not null then tr end)")} as vi_plus,
       {_full("abs(high - pl)", 14, f"sum(abs(low - ph)) over {_w(14)} / nullif(sum(case when pc is not null then tr end) over {_w(14)}, 0)")} as vi_minus from y""")
def ti16(spark, d):
    return _select(spark, d, **I.vortex())


@Q.add("ti17_keltner", f"""with {BARS}, p as (select *, lag(close) over ({W}) as pc, array_agg(close) over ({W} rows unbounded preceding) as a_close from bars),
y as (select symbol, ts, {_ewm(20)} as kc_middle, {_TR} as tr from p),
z as (select *, {_full("tr", 10, f"avg(tr) over {_w(10)}")} as atr from y)
select symbol, ts, kc_middle, kc_middle + 2 * atr as kc_upper, kc_middle - 2 * atr as kc_lower from z""")
def ti17(spark, d):
    return I.with_keltner(X.bars(spark, d)).select("symbol", "ts", "kc_middle", "kc_upper", "kc_lower")


@Q.add("ti18_psar", f"""with recursive {BARS},
n as (select symbol, ts, high, low, row_number() over ({W}) as r, lag(low) over ({W}) as l1, coalesce(lag(low, 2) over ({W}), lag(low) over ({W})) as l2,
      lag(high) over ({W}) as h1, coalesce(lag(high, 2) over ({W}), lag(high) over ({W})) as h2 from bars),
p as (
  select symbol, ts, r, true as rising, cast(0.02 as double) as speed, low as sar, high as extreme from n where r = 1
  union all
  select symbol, ts, r, case when rising then low >= up else high > down end,
         case when flips then 0.02 when further then least(cast(0.2 as double), speed + cast(0.02 as double)) else speed end,
         case when flips then extreme when rising then up else down end,
         case when (flips or further) and rising <> flips then high when flips or further then low else extreme end
  from (select *, case when rising then low < up else high > down end as flips, case when rising then high > extreme else low < extreme end as further
        from (select n.symbol, n.ts, n.r, n.high, n.low, p.rising, p.speed, p.extreme, least(p.sar + p.speed * (p.extreme - p.sar), n.l1, n.l2) as up,
                     greatest(p.sar + p.speed * (p.extreme - p.sar), n.h1, n.h2) as down from p join n on n.symbol = p.symbol and n.r = p.r + 1)))
select symbol, ts, sar as psar from p""")
def ti18(spark, d):
    return I.psar(X.bars(spark, d).select("symbol", "ts", "high", "low")).select("symbol", "ts", "psar")


@Q.add("ti18_psar_plain", f"""with recursive {BARS},
n as (select symbol, ts, high, low, row_number() over ({W}) as r from bars),
p as (
  select symbol, ts, r, true as rising, cast(0.02 as double) as speed, high as sar, low as extreme from n where r = 1
  union all
  select symbol, ts, r, rising <> flips, case when flips then cast(0.02 as double) else faster end, case when flips then beyond else next_sar end,
         case when flips and rising then low when flips then high else beyond end
  from (select *, case when rising then low <= next_sar else high >= next_sar end as flips
        from (select n.*, p.rising, p.sar + p.speed * (p.extreme - p.sar) as next_sar, case when p.rising then greatest(p.extreme, n.high) else least(p.extreme, n.low) end as beyond,
                     case when (p.rising and n.high > p.extreme) or (not p.rising and n.low < p.extreme) then least(cast(0.2 as double), p.speed + cast(0.02 as double)) else p.speed end as faster
              from p join n on n.symbol = p.symbol and n.r = p.r + 1)))
select symbol, ts, sar as psar from p""")
def ti18_plain(spark, d):
    return I.psar(X.bars(spark, d).select("symbol", "ts", "high", "low"), variant="plain").select("symbol", "ts", "psar")


@Q.add("ti19_volume_ratio", _sql(f"avg(volume) over {_w(20)} as volume_sma, case when avg(volume) over {_w(20)} = 0 then 1.0 else volume / nullif(avg(volume) over {_w(20)}, 0) end as volume_ratio"))
def ti19(spark, d):
    return _select(spark, d, volume_sma=F.avg("volume").over(I.rows(20)), volume_ratio=I.volume_ratio())


_FLOW = "((close - low) - (high - close)) / nullif(high - low, 0) * volume"


@Q.add("ti22_cmf", _sql(_full("close", 20, f"sum({_FLOW}) over {_w(20)} / nullif(sum(volume) over {_w(20)}, 0)") + " as cmf_20"))
def ti22(spark, d):
    return _select(spark, d, cmf_20=I.cmf())


@Q.add("ti23_ti24_pivots_candles", _sql("""(high + low + close) / 3 as pivot, (high + low + close) / 3 * 2 - low as r1, (high + low + close) / 3 * 2 - high as s1,
    case when high = low then 0.5 else (close - low) / nullif(high - low, 0) end as position_in_range, abs(close - open) as body,
    high - greatest(open, close) as upper_shadow, least(open, close) - low as lower_shadow"""))
def ti23(spark, d):
    return _select(spark, d, **I.pivots(), **I.candle())


@Q.add("ti25_patterns", f"""with {BARS}, x as (select *, row_number() over ({W}) as p, count(*) over (partition by symbol) as n, {_bb("stddev_samp")} from bars)
select symbol, ts, p > 20 and p <= n - 20 and high = max(high) over {_w(20)} as is_resistance, p > 20 and p <= n - 20 and low = min(low) over {_w(20)} as is_support,
       coalesce(close > bb_upper, false) as breakout_up, coalesce(close < bb_lower, false) as breakout_down from x""")
def ti25(spark, d):
    return I.with_patterns(X.bars(spark, d)).select("symbol", "ts", "is_resistance", "is_support", "breakout_up", "breakout_down")


def _vote(low: str, high: str) -> str:
    return f"case when {low} then 1 when {high} then -1 else 0 end"


def _signals_sql(bars_cte: str) -> str:
    return f"""with {bars_cte}{_DELTA}, i as (
    select symbol, ts, close, {_rsi(f"when {_LOSS} = 0 and {_GAIN} > 0 then 100")} as rsi, {_full("close", 20, f"avg(close) over {_w(20)}")} as sma_20,
           {_full("close", 20, f"case when stddev_samp(close) over {_w(20)} = 0 then 0.5 else (close - (avg(close) over {_w(20)} - 2 * stddev_samp(close) over {_w(20)})) / nullif(4 * stddev_samp(close) over {_w(20)}, 0) end")} as bb_position,
           {_K} as stoch_k, row_number() over (partition by symbol order by ts desc) as latest from x),
v as (select *, [{_vote("rsi < 30", "rsi > 70")}, {_vote("close > sma_20", "close < sma_20")}, {_vote("bb_position < 0.2", "bb_position > 0.8")}, {_vote("stoch_k < 20", "stoch_k > 80")}] as votes
      from i where latest = 1),
n as (select *, cast(len(list_filter(votes, lambda x: x = 1)) as integer) as buy_votes, cast(len(list_filter(votes, lambda x: x = -1)) as integer) as sell_votes from v)
select symbol, ts, rsi, sma_20, bb_position, stoch_k, buy_votes, sell_votes,
       case when buy_votes * 100.0 / nullif(buy_votes + sell_votes, 0) > 60 then 'bullish'
            when buy_votes * 100.0 / nullif(buy_votes + sell_votes, 0) < 40 then 'bearish' else 'neutral' end as overall from n"""


@Q.add("ti26_latest_signals", _signals_sql(X.bars_sql("1 day")))
def latest_signals(spark, d):
    """The flagship: events to daily bars, indicators, and the latest signals per symbol."""
    return I.signals(X.bars(spark, d, "1 day"))


def _joined(*names: str) -> str:
    """Joins of the SQL of other queries to the bars."""
    return " ".join(f"join ({Q.sql[n]}) q{k} using (symbol, ts)" for k, n in enumerate(names))


@Q.add("ti27_all_indicators", f"""with {BARS} select symbol, ts, b.open, b.high, b.low, b.close, b.volume, b.vwap, b.trade_count, sma_5, sma_10, sma_20, sma_50, rsi_ml as rsi_14,
  bb_upper, bb_middle, bb_lower, bb_width, bb_position, stoch_k, tr, (b.high + b.low + b.close) / 3 as tp, williams_r, momentum_10, roc_10, cmf_20, volume_ratio, vi_plus, vi_minus,
  position_in_range, body, upper_shadow, lower_shadow, "pivot", r1, s1, stoch_d, atr_14, cci_20
from bars b """ + _joined("ti1_sma", "ti4_rsi", "ti6_bollinger", "ti7_stochastic", "ti8_atr", "ti11_williams_r", "ti12_momentum_roc", "ti22_cmf", "ti19_volume_ratio", "ti16_vortex",
                          "ti23_ti24_pivots_candles", "ti10_cci"))
def ti27(spark, d):
    return frames.framed(X.bars(spark, d), I.all_indicators)


_SET_COLUMNS = """sma_20, ema_50, sma_200, rsi_ml as rsi_14, macd, macd_signal, macd_hist, stoch_k, stoch_d, bb_upper, bb_middle, bb_lower, bb_width, bb_position,
  atr_14, obv, vwap_cum, ad_line, cmf_20, kc_upper, kc_lower, psar, adx"""
_SET_SQL = f"""with recursive {BARS} select symbol, ts, {{name}} as timeframe, b.close, {_SET_COLUMNS} from bars b """ + _joined(
    "ti1_sma", "ti4_rsi", "ti5_macd", "ti6_bollinger", "ti7_stochastic", "ti8_atr", "ti13_ti14_ti20_ti21_cumulative", "ti22_cmf", "ti17_keltner", "ti18_psar", "ti9_adx"
) + f" join (with {BARS}{_ALL} select symbol, ts, {_ewm(50)} as ema_50 from x) e using (symbol, ts)"
TIMEFRAMES = {"1h": "1 hour", "1d": "1 day"}


@Q.add("ti27_sets", " union all ".join("select * from (" + _SET_SQL.format(name=f"'{k}'").replace("interval '1 hour'", f"interval '{v}'") + ")" for k, v in TIMEFRAMES.items()))
def ti27_sets(spark, d):
    """Every indicator of the named sets, over the bars of two timeframes."""
    names = tuple(dict.fromkeys(x for n in I.SETS.values() for x in n)) + ("adx",)
    out = I.for_timeframes({k: X.bars(spark, d, v) for k, v in TIMEFRAMES.items()}, names)
    return out.select(
        "symbol", "ts", "timeframe", "close", "sma_20", "ema_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d", "bb_upper", "bb_middle", "bb_lower",
        "bb_width", "bb_position", "atr_14", "obv", "vwap_cum", "ad_line", "cmf_20", "kc_upper", "kc_lower", "psar", "adx",
    )
