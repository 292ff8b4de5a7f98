"""Technical indicators as columns over (symbol, ts) windows of bars (symbol, ts, open, high, low, close, volume).

All use one partitioning and order, so a select of many shares one exchange and one sort.  ``full`` windows give null until
they hold n rows.  Divisions by zero give null unless said otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders, frames, relay, scan

KEY, TS = ["symbol"], ["ts"]


def order() -> Window:
    return Window.partitionBy(*KEY).orderBy(*TS)


def rows(n: int) -> Window:
    return order().rowsBetween(-(n - 1), 0)


def ever() -> Window:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(order())


def full(x: Column | str, n: int, value: Column) -> Column:
    """``value`` once n rows of x are in the window."""
    return F.when(F.count(x).over(rows(n)) >= n, value)


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sma(x="close", n: int = 20, variant: str = "ml") -> Column:
    mean = F.avg(c(x)).over(rows(n))
    return full(c(x), n, mean) if variant == "dash" else mean


def wma(x="close", n: int = 20) -> Column:
    """Weights n (latest) to 1, over full windows."""
    values = F.collect_list(c(x)).over(rows(n))
    total = F.aggregate(F.zip_with(values, F.sequence(F.lit(1), F.size(values)), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    return full(c(x), n, total / (n * (n + 1) / 2))


def rsi(x="close", n: int = 14, variant: str = "ml") -> Column:
    """ml: loss 0 gives 100 (null if there was no gain either); etl: ratio 100; dash: 0."""
    delta = c(x) - lag(c(x))
    gain, loss = (F.avg(F.when(d > 0, d).when(delta.isNotNull(), 0.0)).over(rows(n)) for d in (delta, -delta))
    ratio = F.try_divide(gain, loss)
    value = 100 - 100 / (1 + ratio)
    if variant == "etl":
        value = F.when(loss == 0, 100 - 100 / F.lit(101.0)).otherwise(value)
    elif variant == "dash":
        value = F.when(loss == 0, 0.0).otherwise(value)
    else:
        value = F.when((loss == 0) & (gain > 0), 100.0).otherwise(value)
    return full(delta, n, value)


def bollinger(x="close", n: int = 20, width: float = 2.0, variant: str = "ml") -> dict[str, Column]:
    mean = F.avg(c(x)).over(rows(n))
    sd = (F.stddev_pop if variant == "dash" else F.stddev_samp)(c(x)).over(rows(n))
    up, low = mean + sd * width, mean - sd * width
    out = {"bb_upper": up, "bb_middle": mean, "bb_lower": low, "bb_width": F.try_divide(up - low, mean) * 100,
           "bb_position": F.when(up == low, 0.5).otherwise(F.try_divide(c(x) - low, up - low))}
    return {k: full(c(x), n, v) for k, v in out.items()}


def stochastic_k(n: int = 14, variant: str = "ml") -> Column:
    low, high = F.min("low").over(rows(n)), F.max("high").over(rows(n))
    value = F.try_divide(c("close") - low, high - low) * 100
    return full("close", n, F.when(high == low, 50.0).otherwise(value) if variant == "etl" else value)


def true_range(variant: str = "ml") -> Column:
    prior = lag("close")
    if variant == "etl":
        prior = F.coalesce(prior, c("close"))
    return F.greatest(c("high") - c("low"), F.abs(c("high") - prior), F.abs(c("low") - prior))


def williams_r(n: int = 14) -> Column:
    low, high = F.min("low").over(rows(n)), F.max("high").over(rows(n))
    return full("close", n, F.try_divide(high - c("close"), high - low) * -100)


def momentum(x="close", n: int = 10) -> Column:
    return c(x) - lag(c(x), n)


def rate_of_change(x="close", n: int = 10) -> Column:
    return (F.try_divide(c(x), lag(c(x), n)) - 1) * 100


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def cci_of(tp: str, n: int = 20) -> Column:
    """Commodity channel index of a typical-price column: deviation about the window's mean."""
    values = F.collect_list(tp).over(rows(n))
    mean = F.avg(tp).over(rows(n))
    spread = F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    return full(tp, n, F.try_divide(c(tp) - mean, spread * 0.015))


def cmf(n: int = 20) -> Column:
    flow = F.try_divide((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low")) * c("volume")
    return full("close", n, F.try_divide(F.sum(flow).over(rows(n)), F.sum("volume").over(rows(n))))


def vortex(n: int = 14) -> dict[str, Column]:
    up, down, tr = F.abs(c("high") - lag("low")), F.abs(c("low") - lag("high")), true_range()
    total = F.sum(F.when(lag("close").isNotNull(), tr)).over(rows(n))
    return {"vi_plus": full(up, n, F.try_divide(F.sum(up).over(rows(n)), total)), "vi_minus": full(up, n, F.try_divide(F.sum(down).over(rows(n)), total))}


def volume_ratio(n: int = 20) -> Column:
    mean = F.avg("volume").over(rows(n))
    return F.when(mean == 0, 1.0).otherwise(F.try_divide(c("volume"), mean))


def ichimoku(conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> dict[str, Column]:
    """Conversion, base and lagging lines, and the unshifted spans (shift them with ``lag`` in a second select)."""
    mid = lambda n: full("high", n, (F.max("high").over(rows(n)) + F.min("low").over(rows(n))) / 2)
    return {"conversion": mid(conversion), "base": mid(base), "span_b_now": mid(span), "lagging": F.lead("close", shift).over(order())}


def with_ichimoku(bars: DataFrame, shift: int = 26) -> DataFrame:
    now = bars.select("*", *[v.alias(k) for k, v in ichimoku(shift=shift).items()])
    now = now.withColumn("span_a_now", (c("conversion") + c("base")) / 2)
    return now.select(*bars.columns, "conversion", "base", "lagging", lag("span_a_now", shift).alias("span_a"), lag("span_b_now", shift).alias("span_b"))


def with_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """ADX, +DI and -DI: rolling means of directional moves over the mean true range."""
    up, down = c("high") - lag("high"), lag("low") - c("low")
    step = bars.select(
        "*",
        F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0).alias("__up"),
        F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0).alias("__down"),
        true_range().alias("__tr"),
    )
    atr = full("__tr", n, F.avg("__tr").over(rows(n)))
    di = lambda x: full(x, n, F.try_divide(F.avg(x).over(rows(n)), atr) * 100)
    step = step.select("*", di("__up").alias("plus_di"), di("__down").alias("minus_di"))
    step = step.withColumn("__dx", F.try_divide(F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")) * 100)
    return step.select(*bars.columns, "plus_di", "minus_di", full("__dx", n, F.avg("__dx").over(rows(n))).alias("adx"))


def with_cumulative(bars: DataFrame) -> DataFrame:
    """OBV, price-volume trend, accumulation/distribution and cumulative VWAP, by running sums that carry over parts."""
    delta = c("close") - c("__prior")
    rows_ = frames.framed(bars, lambda b: b.withColumn("__prior", lag("close")), before=1, after=0)
    money = F.try_divide((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low")) * c("volume")
    out = scan.running_sums(rows_, {
        "obv": F.when(delta > 0, c("volume")).when(delta < 0, -c("volume")).otherwise(0),
        "pvt": F.try_divide(delta, c("__prior")) * c("volume"),
        "ad_line": money,
        "__tpv": typical() * c("volume"),
        "__v": c("volume"),
    })
    return out.select(*bars.columns, "obv", "pvt", "ad_line", F.try_divide("__tpv", "__v").alias("vwap_cum"))


def with_session_vwap(bars: DataFrame) -> DataFrame:
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("vwap_session", F.try_divide(F.sum(typical() * c("volume")).over(day), F.sum("volume").over(day)))


def with_ema(bars: DataFrame, spans: tuple[int, ...] = (12, 26), *, adjust: bool = True) -> DataFrame:
    return scan.ema(bars, {f"ema_{n}": (c("close"), n) for n in spans}, adjust=adjust)


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, adjust: bool = True) -> DataFrame:
    both = scan.ema(bars, {"__fast": (c("close"), fast), "__slow": (c("close"), slow)}, adjust=adjust)
    line = both.withColumn("macd", c("__fast") - c("__slow")).drop("__fast", "__slow")
    out = scan.ema(line, {"macd_signal": (c("macd"), signal)}, adjust=adjust)
    return out.withColumn("macd_hist", c("macd") - c("macd_signal"))


def with_keltner(bars: DataFrame, n: int = 20, atr_n: int = 10, width: float = 2.0) -> DataFrame:
    spread = full("__tr", atr_n, F.avg("__tr").over(rows(atr_n))) * width
    wide = frames.framed(bars, lambda b: b.withColumn("__tr", true_range()).withColumn("__width", spread).drop("__tr"), before=atr_n + 1, after=0)
    middle = scan.ema(wide, {"kc_middle": (c("close"), n)})
    return middle.select(*bars.columns, "kc_middle", (c("kc_middle") + c("__width")).alias("kc_upper"), (c("kc_middle") - c("__width")).alias("kc_lower"))


def pivots() -> dict[str, Column]:
    p = typical()
    return {"pivot": p, "r1": p * 2 - c("low"), "s1": p * 2 - c("high")}


def candle() -> dict[str, Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {
        "position_in_range": F.when(c("high") == c("low"), 0.5).otherwise(F.try_divide(c("close") - c("low"), c("high") - c("low"))),
        "body": F.abs(c("close") - c("open")), "upper_shadow": c("high") - top, "lower_shadow": bottom - c("low"),
    }


def sar_fold(start: float, step: float, most: float, variant: str):
    """One pass of the parabolic SAR; the state is direction, speed, SAR, extreme, and the lows and highs of the last two bars."""

    def clamped(state: tuple, high: float, low: float) -> tuple:
        rising, speed, sar, extreme, l1, l2, h1, h2 = state
        sar += speed * (extreme - sar)
        sar = min(sar, l1, l2) if rising else max(sar, h1, h2)
        if low < sar if rising else high > sar:
            return not rising, start, extreme, low if rising else high, low, l1, high, h1
        if high > extreme if rising else low < extreme:
            extreme, speed = high if rising else low, min(most, speed + step)
        return rising, speed, sar, extreme, low, l1, high, h1

    def plain(state: tuple, high: float, low: float) -> tuple:
        rising, speed, sar, extreme, l1, _, h1, _ = state
        sar += speed * (extreme - sar)
        if high > extreme if rising else low < extreme:
            extreme, speed = high if rising else low, min(most, speed + step)
        if low <= sar if rising else high >= sar:
            return not rising, start, extreme, low if rising else high, low, l1, high, h1
        return rising, speed, sar, extreme, low, l1, high, h1

    move = {"clamped": clamped, "plain": plain}[variant]

    def fold(state: tuple | None, given: dict[str, list]) -> tuple[dict[str, list], tuple | None]:
        out = []
        for high, low in zip(given["high"], given["low"], strict=True):
            if high is None or low is None:
                out.append(None)
                continue
            if state is None:
                sar, extreme = (low, high) if variant == "clamped" else (high, low)
                state = (True, start, sar, extreme, low, low, high, high)
            else:
                state = move(state, high, low)
            out.append(state[2])
        return {"psar": out}, state

    return fold


SAR_STATE = "rising boolean, speed double, sar double, extreme double, l1 double, l2 double, h1 double, h2 double"


def psar(bars: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2, *, variant: str = "clamped", tie: str | None = None,
         block: int = relay.BLOCK, warm: int = relay.WARM) -> DataFrame:
    """Adds psar, the parabolic SAR per symbol, by blocks of a series that run at the same time.

    clamped: begins at the first low with the first high as extreme, and never enters the range of the last two bars.  plain:
    begins at the first high with the first low as extreme, has no such bound, and moves the extreme before it tests for a
    turn.  Bars without a high or low have no SAR and change nothing.
    """
    typed = bars.withColumns({x: c(x).cast("double") for x in ("high", "low")})
    return relay.relayed(typed, sar_fold(start, step, most, variant), inputs=["high", "low"], state=SAR_STATE, out="psar double", tie=tie, block=block, warm=warm)


def with_patterns(bars: DataFrame, n: int = 20) -> DataFrame:
    """Support and resistance (a bar at the extreme of its last n, not within n of either end) and closes outside the bands."""
    sizes = bars.groupBy(c("symbol").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    placed = frames.numbered(bars).join(sizes, c("symbol").eqNullSafe(c("__of")))
    at = placed.select(*bars.columns, ((c("__n") >= n) & (c("__n") < c("__size") - n)).alias("__inner"))
    inner = c("__inner")
    bands = bollinger(n=n)
    made = {
        "is_resistance": inner & (c("high") == F.max("high").over(rows(n))), "is_support": inner & (c("low") == F.min("low").over(rows(n))),
        "breakout_up": F.coalesce(c("close") > bands["bb_upper"], F.lit(False)), "breakout_down": F.coalesce(c("close") < bands["bb_lower"], F.lit(False)),
    }
    out = frames.framed(at, lambda b: b.select("*", *[v.alias(k) for k, v in made.items()]), before=n)
    return out.select(*bars.columns, *made)


#: Bars of a symbol that its latest signals depend on, at most.
RECENT = 64


def signals(bars: DataFrame) -> DataFrame:
    """The latest bar's votes per symbol: RSI, price against SMA 20, band position, stochastic; bullish share over 60 %, bearish under 40 %."""
    bands = bollinger()
    # No signal looks further back, and a task cuts a symbol's bars down before they meet.
    recent = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts")))
    bars = bars.withColumn("__recent", recent).filter(c("__recent") <= RECENT)
    rows_ = bars.select(
        "symbol", "ts", "close", rsi().alias("rsi"), sma(n=20, variant="dash").alias("sma_20"), bands["bb_position"].alias("bb_position"), stochastic_k().alias("stoch_k"),
        F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts"))).alias("__latest"),
    ).filter("__latest = 1")
    vote = lambda low, high: F.when(low, 1).when(high, -1).otherwise(0)
    votes = F.array(
        vote(c("rsi") < 30, c("rsi") > 70), vote(c("close") > c("sma_20"), c("close") < c("sma_20")),
        vote(c("bb_position") < 0.2, c("bb_position") > 0.8), vote(c("stoch_k") < 20, c("stoch_k") > 80),
    )
    buys, sells = F.size(F.filter(votes, lambda v: v == 1)), F.size(F.filter(votes, lambda v: v == -1))
    share = F.try_divide(buys * 100.0, buys + sells)
    return rows_.select(
        "symbol", "ts", "rsi", "sma_20", "bb_position", "stoch_k", buys.alias("buy_votes"), sells.alias("sell_votes"),
        F.when(share > 60, "bullish").when(share < 40, "bearish").otherwise("neutral").alias("overall"),
    )


def all_indicators(bars: DataFrame) -> DataFrame:
    """The common set in one pass: one exchange and sort, nested windows in a second select."""
    one = bars.select(
        "*", *[sma(n=n).alias(f"sma_{n}") for n in (5, 10, 20, 50)], rsi().alias("rsi_14"), *[v.alias(k) for k, v in bollinger().items()],
        stochastic_k().alias("stoch_k"), true_range().alias("tr"), typical().alias("tp"), williams_r().alias("williams_r"),
        momentum().alias("momentum_10"), rate_of_change().alias("roc_10"), cmf().alias("cmf_20"), volume_ratio().alias("volume_ratio"),
        *[v.alias(k) for k, v in vortex().items()], *[v.alias(k) for k, v in candle().items()], *[v.alias(k) for k, v in pivots().items()],
    )
    return one.select("*", full("stoch_k", 3, F.avg("stoch_k").over(rows(3))).alias("stoch_d"), full("tr", 14, F.avg("tr").over(rows(14))).alias("atr_14"), cci_of("tp").alias("cci_20"))


ANNUAL = math.sqrt(252)


def _windowed(bars: DataFrame, names: set[str]) -> DataFrame:
    """The indicators of ``names`` that windows of a fixed number of rows give, by blocks of a series."""
    first = {
        **{f"sma_{n}": {f"sma_{n}": sma(n=n)} for n in (5, 10, 20, 50, 200)}, "rsi_14": {"rsi_14": rsi()}, "bollinger_bands": bollinger(), "cmf_20": {"cmf_20": cmf()},
        "stochastic": {"stoch_k": stochastic_k()}, "atr_14": {"__range": true_range()}, "volume_ratio": {"volume_ratio": volume_ratio()}, "williams_r": {"williams_r": williams_r()},
    }
    second = {"stochastic": {"stoch_d": full("stoch_k", 3, F.avg("stoch_k").over(rows(3)))}, "atr_14": {"atr_14": full("__range", 14, F.avg("__range").over(rows(14)))}}
    made = {k: v for n in first if n in names for k, v in first[n].items()}
    after = {k: v for n in second if n in names for k, v in second[n].items()}

    def build(b: DataFrame) -> DataFrame:
        out = b.select("*", *[v.alias(k) for k, v in made.items()]).select("*", *[v.alias(k) for k, v in after.items()])
        out = with_adx(out) if "adx" in names else out
        return out.drop("__range")

    return frames.framed(bars, build)


#: Indicators that carry from the first row on, each a step over the bars.
CARRIED = {
    "ema_50": lambda b: with_ema(b, (50,)), "macd": with_macd, "keltner_channels": with_keltner, "parabolic_sar": psar,
}
CUMULATIVE = {"obv": "obv", "vwap": "vwap_cum", "ad_line": "ad_line"}

#: Named sets (fixed values).
SETS = {
    "basic_trend": ("sma_20", "ema_50", "sma_200"),
    "momentum_suite": ("rsi_14", "macd", "stochastic"),
    "volatility_package": ("bollinger_bands", "atr_14", "keltner_channels"),
    "volume_analysis": ("obv", "vwap", "ad_line", "cmf_20"),
    "complete_technical": ("sma_20", "ema_50", "sma_200", "rsi_14", "macd", "stochastic", "bollinger_bands", "atr_14", "obv", "vwap", "parabolic_sar"),
}


def indicator_set(bars: DataFrame, name: str | tuple[str, ...]) -> DataFrame:
    """``bars`` with the indicators of a set of SETS, or of those named."""
    names = SETS[name] if isinstance(name, str) else name
    out = _windowed(folders.written(bars, "bars"), set(names))  # read by every step
    kept = list(out.columns)
    # The SAR counts its rows first, so it comes before what would be made twice for that.
    for n in sorted(names, key=lambda x: x != "parabolic_sar"):
        if n in CARRIED:
            # Written, as each such step reads its input twice: for the sums of parts, and to add them.
            out = folders.written(CARRIED[n](out), "bars")
            kept = [*kept, *[x for x in out.columns if x not in kept]]
    summed = [CUMULATIVE[n] for n in names if n in CUMULATIVE]
    if summed:
        out = with_cumulative(out)
        kept = [*kept, *summed]
    return out.select(*kept)


def for_timeframes(bars: dict[str, DataFrame], name: str | tuple[str, ...]) -> DataFrame:
    """The set over the bars of every timeframe, in one table tagged by ``timeframe``; each timeframe has its own series."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [indicator_set(b, name).withColumn("timeframe", F.lit(k)) for k, b in bars.items()])
