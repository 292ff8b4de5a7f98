"""Rolling statistics and features as columns over per-symbol windows ordered by ts.

Skewness and kurtosis are bias-corrected.  Where ``least`` is given, a window with fewer rows gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.functions import sliding
from ticklattice.functions.indicators import c, ever, full, lag, order, rows, sma

ANNUAL = math.sqrt(252)


def skew(x, w) -> Column:
    n = F.count(c(x)).over(w).cast("double")
    return F.when((n >= 3) & (F.var_pop(c(x)).over(w) > 0), F.skewness(c(x)).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x, w) -> Column:
    n = F.count(c(x)).over(w).cast("double")
    return F.when((n >= 4) & (F.var_pop(c(x)).over(w) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c(x)).over(w) + 6))


STATS = {
    "mean": lambda x, w: F.avg(c(x)).over(w), "std": lambda x, w: F.stddev_samp(c(x)).over(w), "var": lambda x, w: F.var_samp(c(x)).over(w),
    "min": lambda x, w: F.min(c(x)).over(w), "max": lambda x, w: F.max(c(x)).over(w), "sum": lambda x, w: F.sum(c(x)).over(w),
    "skew": skew, "kurt": kurt,
}
#: Statistics that need the window in order.
ORDERED = {"median": 0.5, "q25": 0.25, "q75": 0.75}
ALL_STATS = (*STATS, *ORDERED)


def with_rolling_statistics(df: DataFrame, x: str, windows=(5, 20), stats=ALL_STATS, *, least: int = 1, prefix: str = "") -> DataFrame:
    """Adds ``<prefix><stat>_<n>`` for every window length and statistic; null in windows of fewer than ``least`` values."""
    held = lambda n, v: F.when(F.count(c(x)).over(rows(n)) >= least, v) if least > 1 else v
    made = {f"{prefix}{s}_{n}": ("quantile", x, n, ORDERED[s]) for n in windows for s in stats if s in ORDERED}
    given = sliding.ordered(df, made) if made else df
    out = {f"{prefix}{s}_{n}": held(n, c(f"{prefix}{s}_{n}") if s in ORDERED else STATS[s](x, rows(n))) for n in windows for s in stats}
    return given.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def z_score(x, n: int) -> Column:
    return F.try_divide(c(x) - F.avg(c(x)).over(rows(n)), F.stddev_samp(c(x)).over(rows(n)))


def with_percentile_rank(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Adds the mean rank of the last value among the n-1 before it, in percent; 50 where it stands alone."""
    return sliding.ordered(df, {name: ("rank", x, n)})


def entropy(x: str, n: int, bins: int = 10) -> Column:
    """Entropy in bits of a histogram of ``bins`` equal bins between the window's extremes."""
    values = F.collect_list(c(x)).over(rows(n))
    low, high = F.min(c(x)).over(rows(n)), F.max(c(x)).over(rows(n))
    width = (high - low) / bins
    at = F.transform(values, lambda v: F.when(width > 0, F.least(F.floor((v - low) / width), F.lit(bins - 1))).otherwise(F.lit(0)))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda k: k == b)) / F.size(at))
    total = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return full(c(x), n, total)


def correlation(a, b, n: int) -> Column:
    return F.corr(c(a), c(b)).over(rows(n))


def beta(r, m, n: int, variant: str = "consistent") -> Column:
    """Slope of r on m; ``mixed`` divides a sample covariance by a population variance."""
    slope = F.try_divide(F.covar_samp(c(r), c(m)).over(rows(n)), F.var_samp(c(m)).over(rows(n)))
    if variant == "mixed":
        k = F.count(c(m)).over(rows(n)).cast("double")
        slope = slope * k / F.nullif(k - 1, F.lit(0.0))
    return full(c(r), n, slope)


def realized_volatility(r, n: int) -> Column:
    return full(c(r), n, F.stddev_samp(c(r)).over(rows(n)) * ANNUAL)


def parkinson(n: int) -> Column:
    x = F.pow(F.log(F.try_divide(c("high"), c("low"))), 2)
    return full(x, n, F.sqrt(F.avg(x).over(rows(n)) / (4 * math.log(2)) * 252))


def momentum_family(x, periods=(5, 10)) -> dict[str, Column]:
    out = {}
    for p in periods:
        out[f"diff_{p}"] = c(x) - lag(c(x), p)
        out[f"pct_{p}"] = F.try_divide(c(x) - lag(c(x), p), lag(c(x), p))
        out[f"log_{p}"] = F.log(F.try_divide(c(x), lag(c(x), p)))
    return out


def moments(x, n: int) -> dict[str, Column]:
    """Skewness, kurtosis, third and fourth central moment once max(4, n / 4) rows are there."""
    w, least = rows(n), max(4, n // 4)
    mean = F.avg(c(x)).over(w)
    sd = F.sqrt(F.var_pop(c(x)).over(w))
    values = {"skew": skew(x, w), "kurt": kurt(x, w), "m3": F.skewness(c(x)).over(w) * F.pow(sd, 3), "m4": (F.kurtosis(c(x)).over(w) + 3) * F.pow(sd, 4)}
    del mean
    return {f"{k}_{n}": F.when(F.count(c(x)).over(w) >= least, v) for k, v in values.items()}


def with_distribution(df: DataFrame, x: str, n: int = 50) -> DataFrame:
    """Adds mean, deviation, quartile and tail spreads and the coefficient of variation over n rows, once max(10, n / 5) are there."""
    w, least = rows(n), max(10, n // 5)
    at = sliding.ordered(df, {f"__q{p}": ("quantile", x, n, p / 100) for p in (5, 25, 75, 95)})
    mean, sd = F.avg(c(x)).over(w), F.stddev_samp(c(x)).over(w)
    values = {"mean": mean, "std": sd, "skew": skew(x, w), "kurt": kurt(x, w), "iqr": c("__q75") - c("__q25"), "tail_range": c("__q95") - c("__q5"), "cv": F.try_divide(sd, mean)}
    return at.select(*df.columns, *[F.when(F.count(c(x)).over(w) >= least, v).alias(k) for k, v in values.items()])


def autocorrelation(x, lag_by: int, n: int = 50) -> Column:
    """Correlation of x with itself ``lag_by`` rows before, within a window of n rows."""
    return full(c(x), n, F.corr(c(x), c(f"__lag_{lag_by}")).over(order().rowsBetween(-(n - 1 - lag_by), 0)))


def with_autocorrelations(df: DataFrame, x: str, lags=(1, 5), n: int = 50) -> DataFrame:
    lagged = df.select("*", *[lag(x, k).alias(f"__lag_{k}") for k in lags])
    return lagged.select(*df.columns, *[autocorrelation(x, k, n).alias(f"acf_{k}") for k in lags])


def with_ljung_box(df: DataFrame, x: str, lags: int = 5, n: int = 50) -> DataFrame:
    """Q statistic of the first ``lags`` autocorrelations in windows of n rows."""
    rows_ = with_autocorrelations(df, x, tuple(range(1, lags + 1)), n)
    q = sum((F.pow(c(f"acf_{k}"), 2) / (n - k) for k in range(1, lags + 1)), F.lit(0.0)) * n * (n + 2)
    return rows_.select(*df.columns, q.alias("ljung_box"))


def returns(x="close") -> dict[str, Column]:
    prior = lag(c(x))
    return {"ret": F.try_divide(c(x), prior) - 1, "log_ret": F.log(F.try_divide(c(x), prior))}


def with_cumulative_return(df: DataFrame, x: str = "close") -> DataFrame:
    """Cumulative return since the first row: logs add up, so the product telescopes."""
    return df.withColumn("cum_ret", F.try_divide(c(x), F.first(c(x)).over(ever())) - 1)


def lag_features(x, lags=(1, 2, 3)) -> dict[str, Column]:
    out = {}
    for k in lags:
        out |= {f"lag_{k}": lag(c(x), k), f"diff_{k}": c(x) - lag(c(x), k), f"pct_{k}": F.try_divide(c(x), lag(c(x), k)) - 1}
    return out


def with_garch(df: DataFrame, r: str, n: int = 252, alpha: float = 0.1, beta_: float = 0.85) -> DataFrame:
    """GARCH(1,1) variance: v[t] = omega + alpha * r[t-1]**2 + beta * v[t-1], omega from the series' variance.

    The recurrence is linear in v, so it runs as a decayed sum; the first row has the series' variance.
    """
    from ticklattice.functions import frames, scan

    var = df.groupBy(c("symbol").alias("__symbol")).agg(F.var_samp(c(r)).alias("__var"))
    prior = frames.framed(df, lambda b: b.withColumn("__prior", lag(r)), before=1, after=0)
    given = frames.numbered(prior.join(var, c("symbol").eqNullSafe(c("__symbol"))).drop("__symbol"))
    term = F.when(c("__n") == 0, c("__var")).otherwise((1 - alpha - beta_) * c("__var") + alpha * F.coalesce(F.pow(c("__prior"), 2), F.lit(0.0)))
    out = scan.decayed_sums(given, {"garch_var": (term, beta_)})
    return out.select(*df.columns, F.sqrt("garch_var").alias("garch_vol"))


def with_streaks(df: DataFrame, x: str = "close", n: int = 11) -> DataFrame:
    """Length of the current run of moves in one direction, and moves in the last n rows.

    A run is as long as its place is beyond that of its first row, which the scan of last known values finds over parts.
    """
    from ticklattice.functions import frames, scan

    def build(b: DataFrame) -> DataFrame:
        one = b.withColumn("__sign", F.signum(c(x) - lag(c(x))))
        moves = F.sum(F.when(c("__sign") != 0, 1).otherwise(0)).over(rows(n))
        return one.select("*", moves.alias("moves"), F.when(~c("__sign").eqNullSafe(lag("__sign")), 1).alias("__start"))

    at = scan.known(frames.framed(df, build, before=n + 2, after=0), "__start")
    run = (c("__n") - c("__back.n") + 1).cast("int")
    return at.select(*df.columns, F.when(c("__sign") != 0, run).otherwise(0).alias("streak"), "moves")


def feature_set(bars: DataFrame) -> DataFrame:
    """The comprehensive set over bars: returns, rolling statistics of returns, and of closes z-score, rank, volatilities, gap to
    the mean, momentum, entropy, moments, distribution, autocorrelations and Ljung-Box."""
    given = bars.select("*", *[v.alias(k) for k, v in returns().items()])
    given = given.select("*", *[lag("close", k).alias(f"__lag_{k}") for k in range(1, 6)])
    given = sliding.ordered(given, {
        "__q25": ("quantile", "ret", 20, 0.25), "__q75": ("quantile", "ret", 20, 0.75), "rank_20": ("rank", "close", 20),
        **{f"__p{p}": ("quantile", "close", 50, p / 100) for p in (5, 25, 75, 95)},
    })
    enough = lambda v: F.when(F.count(c("ret")).over(rows(20)) >= 5, v)
    out = {f"ret_{s}_20": enough(STATS[s]("ret", rows(20))) for s in ("mean", "std", "skew", "kurt")} | {f"ret_{q}_20": enough(c(f"__{q}")) for q in ("q25", "q75")}
    out |= {"z_20": z_score("close", 20), "rank_20": c("rank_20"), "vol_20": realized_volatility("ret", 20), "parkinson_20": parkinson(20), "ma_gap_20": F.try_divide(c("close") - sma(n=20), sma(n=20))}
    out |= momentum_family("close") | {"entropy_20": entropy("close", 20)} | moments("close", 20)
    spread = F.count(c("close")).over(rows(50)) >= 10
    out |= {"iqr_50": F.when(spread, c("__p75") - c("__p25")), "tail_range_50": F.when(spread, c("__p95") - c("__p5"))}
    acf = {k: autocorrelation("close", k, 50) for k in range(1, 6)}
    box = sum((F.pow(v, 2) / (50 - k) for k, v in acf.items()), F.lit(0.0)) * 50 * 52
    out |= {"acf_1": acf[1], "acf_5": acf[5], "ljung_box": box}
    kept = [*bars.columns, "ret", "log_ret"]
    return given.select(*kept, *[v.alias(k) for k, v in out.items()])
