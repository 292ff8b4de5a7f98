"""Anomaly detectors over per-symbol windows, their combination, and detectors fitted on a matrix of features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import frames, quantiles, sliding

c = F.col


def _order(*more: str) -> Window:
    return Window.partitionBy("symbol").orderBy("ts", *(more or ("trade_id",)))


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def detect(trades: DataFrame) -> DataFrame:
    """All tick detectors in one select: z-score, IQR, price spike, volume, and streak of moves; a flag and a score each."""
    return frames.framed(trades, _detect, tie="trade_id")


def _detect(trades: DataFrame) -> DataFrame:
    w100, w50, w10 = _order().rowsBetween(-100, 0), _order().rowsBetween(-50, 0), _order().rowsBetween(-10, 0)
    z = F.try_divide(c("price") - F.avg("price").over(w100), F.stddev_samp("price").over(w100))
    plain = trades.columns
    trades = sliding.ordered(trades, {"__q1": ("quantile", "price", 101, 0.25), "__q3": ("quantile", "price", 101, 0.75)}, order=("ts", "trade_id"))
    prior = F.lag("price").over(_order())
    step = trades.select(
        "*", F.abs(z).alias("__z"), F.try_divide(c("price") - prior, prior).alias("__move"),
        F.abs(F.try_divide(c("size") - F.avg("size").over(w50), F.stddev_samp("size").over(w50))).alias("__vz"), F.try_divide(c("size"), F.avg("size").over(w50)).alias("__vr"),
        F.signum(c("price") - prior).alias("__sign"),
    )
    low, high = c("__q1") - (c("__q3") - c("__q1")) * 1.5, c("__q3") + (c("__q3") - c("__q1")) * 1.5
    beyond = F.greatest(low - c("price"), c("price") - high, F.lit(0.0))
    step = step.withColumn("__prior_sign", F.lag("__sign").over(_order()))
    same = F.sum(F.when((c("__sign") == c("__prior_sign")) & (c("__sign") != 0), 1).otherwise(0)).over(w10)
    flags = {
        "zscore": (_no(c("__z") > 3), F.coalesce(c("__z") / 3, F.lit(0.0))),
        "iqr": (_no((c("price") < low) | (c("price") > high)), F.coalesce(F.try_divide(beyond, c("__q3") - c("__q1")), F.lit(0.0))),
        "spike": (_no(F.abs(c("__move")) > 0.05), F.coalesce(F.abs(c("__move")) / 0.05, F.lit(0.0))),
        "volume": (_no((c("__vz") > 3) | (c("__vr") > 5) | (c("__vr") < 0.1)), F.coalesce(c("__vz") / 3, F.lit(0.0))),
        "pattern": (same >= 8, same / 11.0),
    }
    scores = {k: F.least(F.when(flag, score).otherwise(0.0), F.lit(1.0)) for k, (flag, score) in flags.items()}
    return step.select(*plain, *[f.alias(f"is_{k}") for k, (f, _) in flags.items()], *[s.alias(f"anomaly_score_{k}") for k, s in scores.items()])


METHODS = ("zscore", "iqr", "spike", "volume", "pattern")


def classify(rows: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Composite and greatest score, methods that fired, severity and primary type."""
    scores = [c(f"anomaly_score_{m}") for m in methods]
    total = reduce(lambda a, b: a + b, scores) / len(scores)
    fired = reduce(lambda a, b: a + b, [c(f"is_{m}").cast("int") for m in methods])
    out = rows.select("*", total.alias("composite_score"), F.greatest(*scores).alias("max_score"), fired.alias("methods_fired"))
    severity = F.when(c("max_score") >= 0.8, "CRITICAL").when(c("max_score") >= 0.6, "WARNING").when(c("max_score") > 0, "INFO")
    kind = F.when(c("is_spike"), "price_spike").when(c("is_volume"), "volume").when(c("is_pattern"), "pattern").when(c("is_zscore") | c("is_iqr"), "statistical")
    return out.select("*", severity.alias("severity"), kind.alias("primary_type"))


def outlier_3sigma(trades: DataFrame, n: int = 50) -> DataFrame:
    w = _order().rowsBetween(-(n - 1), 0)
    mean, sd = F.avg("price").over(w), F.stddev_samp("price").over(w)
    far = _no(F.abs(c("price") - mean) > sd * 3).alias("is_outlier")
    return frames.framed(trades, lambda rows: rows.select("*", far), tie="trade_id", before=n)


def correlation_breaks(rows: DataFrame, n: int = 20) -> DataFrame:
    """Rolling correlation of a symbol's returns (ret) with the market's (market), and where it leaves three deviations."""
    w, far = _order("ts").rowsBetween(-(n - 1), 0), _order("ts").rowsBetween(-100, -1)
    one = rows.withColumn("market_corr", F.when(F.count("ret").over(w) >= n, F.corr("ret", "market").over(w)))
    z = F.try_divide(c("market_corr") - F.avg("market_corr").over(far), F.stddev_samp("market_corr").over(far))
    return one.withColumn("corr_z", z).withColumn("is_corr_break", _no(F.abs("corr_z") > 3))


def fit_params(matrix: DataFrame, features: list[str]) -> dict[str, dict[str, float | None]]:
    """Population mean and deviation, median, quartiles and median absolute deviation of each feature."""
    one = matrix.agg(*[a.alias(f"{f}__{n}") for f in features for n, a in (("mean", F.avg(f)), ("std", F.stddev_pop(f)))]).first()
    fit = {f: {"mean": one[f"{f}__mean"], "std": one[f"{f}__std"]} for f in features}
    for f, (q1, med, q3) in quantiles.quantiles(matrix, {f: f for f in features}, [0.25, 0.5, 0.75]).items():
        fit[f] |= {"q1": q1, "med": med, "q3": q3}
    far = {f: F.abs(c(f) - F.lit(fit[f]["med"]).cast("double")) for f in features}
    for f, (mad,) in quantiles.quantiles(matrix, far, [0.5]).items():
        fit[f]["mad"] = mad
    return fit


def score_params(matrix: DataFrame, params: dict[str, dict[str, float | None]], features: list[str]) -> DataFrame:
    """Row scores by z, modified z and IQR distance: the greatest over the features."""
    p = {(f, n): F.lit(x).cast("double") for f in features for n, x in params[f].items()}
    z = [F.abs(F.try_divide(c(f) - p[f, "mean"], p[f, "std"])) for f in features]
    m = [F.abs(F.try_divide((c(f) - p[f, "med"]) * 0.6745, p[f, "mad"])) for f in features]
    iqr = [F.try_divide(F.greatest(p[f, "q1"] - c(f), c(f) - p[f, "q3"], F.lit(0.0)), p[f, "q3"] - p[f, "q1"]) for f in features]
    most = lambda scores: F.array_max(F.array(*scores))
    return matrix.select("*", most(z).alias("z_score"), most(m).alias("modified_z"), most(iqr).alias("iqr_score"))


def series_detectors(bars: DataFrame, n: int = 20) -> DataFrame:
    """Moving-average, Bollinger and Hampel detectors on closes; windows of at least 10 rows."""
    order = Window.partitionBy("symbol").orderBy("ts")
    w, near = order.rowsBetween(-(n - 1), 0), order.rowsBetween(-2, 2)
    enough = F.count("close").over(w) >= 10
    mean, sd = F.avg("close").over(w), F.stddev_samp("close").over(w)
    step = bars.select("symbol", "ts", "close", mean.alias("__m"), sd.alias("__s"), enough.alias("__ok"), F.collect_list("close").over(near).alias("__near"))
    middle = lambda a: F.element_at(F.array_sort(a), ((F.size(a) + 1) / 2).cast("int"))  # noqa: E731  (lower middle of an even number)
    step = step.withColumn("__med", middle(c("__near")))
    step = step.withColumn("__mad", middle(F.transform("__near", lambda v: F.abs(v - c("__med")))))
    return step.select(
        "symbol", "ts", _no(c("__ok") & (F.abs(c("close") - c("__m")) > c("__s") * 3)).alias("is_ma"),
        _no(c("__ok") & ((c("close") > c("__m") + c("__s") * 2) | (c("close") < c("__m") - c("__s") * 2))).alias("is_bollinger"),
        _no(F.abs(c("close") - c("__med")) > c("__mad") * 1.4826 * 3).alias("is_hampel"),
    )


def seasonal_residuals(bars: DataFrame, period: int = 24, width: float = 3.0) -> DataFrame:
    """Additive decomposition: centred moving mean, mean by place in the period, and residuals beyond ``width`` deviations."""
    half = period // 2
    trend = F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-half, half)).alias("trend")
    near = frames.framed(bars.select("symbol", "ts", "close"), lambda b: b.select("*", trend), before=half, after=half)
    step = frames.numbered(near).select("symbol", "ts", "close", "trend", (c("__n") % period).alias("place"), (c("close") - c("trend")).alias("detrended"))
    # Means by place and by symbol are aggregated and joined back, so no task holds a symbol.
    places = step.groupBy(c("symbol").alias("__s"), c("place").alias("__p")).agg(F.sum("detrended").alias("__sum"), F.count("detrended").alias("__count"))
    wholes = places.groupBy(c("__s").alias("__w")).agg(F.try_divide(F.sum("__sum"), F.sum("__count")).alias("__mean"))
    means = places.join(wholes, c("__s").eqNullSafe(c("__w"))).select("__s", "__p", (F.try_divide("__sum", "__count") - c("__mean")).alias("seasonal"))
    rest = step.join(means, c("symbol").eqNullSafe(c("__s")) & (c("place") == c("__p"))).withColumn("residual", c("detrended") - c("seasonal"))
    spread = rest.groupBy(c("symbol").alias("__r")).agg(F.avg("residual").alias("__m"), F.stddev_samp("residual").alias("__sd"))
    both = rest.join(spread, c("symbol").eqNullSafe(c("__r")))
    return both.select("symbol", "ts", "close", "trend", "place", "seasonal", "residual", _no(F.abs(c("residual") - c("__m")) > c("__sd") * width).alias("is_seasonal"))


def combine(rows: DataFrame, flags: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Majority vote, mean and weighted mean of detector columns, and each one's part in the weighted mean."""
    weights = weights or dict.fromkeys(flags, 1.0)
    total = sum(weights.values())
    votes = reduce(lambda a, b: a + b, [c(f).cast("double") for f in flags])
    weighted = reduce(lambda a, b: a + b, [c(f).cast("double") * (weights[f] / total) for f in flags])
    return rows.select(
        "*", (votes / len(flags)).alias("mean_vote"), (votes * 2 > len(flags)).alias("majority"), weighted.alias("weighted_vote"), (weighted >= 0.5).alias("weighted_majority"),
        *[F.coalesce(F.try_divide(c(f).cast("double") * (weights[f] / total), weighted), F.lit(0.0)).alias(f"part_{f}") for f in flags],
    )
