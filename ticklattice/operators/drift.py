"""Drift between a baseline and a comparison of many features at once: (feature_id, is_new, value) in, one row per feature out.

Running counts over sorted values go by prefix sums of value ranges, so a feature with very many values isn't one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import quantiles

c = F.col
FLOOR = 1e-6


def _counts(long: DataFrame) -> DataFrame:
    """(feature_id, value, old, new) by distinct value."""
    return long.filter("value is not null").groupBy("feature_id", "value").agg(F.count_if(~c("is_new")).alias("old"), F.count_if(c("is_new")).alias("new"))


def distances(long: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov statistic and asymptotic p, and the Wasserstein distance over the baseline's range."""
    counts = quantiles.dealt(_counts(long), "value", key="feature_id")
    totals = counts.groupBy(c("feature_id").alias("f")).agg(
        F.sum("old").alias("n_old"), F.sum("new").alias("n_new"),
        F.min(F.when(c("old") > 0, c("value"))).alias("old_lo"), F.max(F.when(c("old") > 0, c("value"))).alias("old_hi"),
    )
    rows = counts.join(totals, c("feature_id") == c("f")).drop("f")
    sums = rows.groupBy(c("feature_id").alias("f"), c("part").alias("p")).agg(F.sum("old").alias("po"), F.sum("new").alias("pn"), F.min("value").alias("first"))
    before = Window.partitionBy("f").orderBy("p")
    sums = sums.select(
        "f", "p", F.coalesce(F.sum("po").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bo"),
        F.coalesce(F.sum("pn").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bn"), F.lead("first").over(before).alias("after"),
    )
    rows = rows.join(sums, (c("feature_id") == c("f")) & (c("part") == c("p")))
    inside = Window.partitionBy("feature_id", "part").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.sum("old").over(running) + c("bo")) / c("n_old") - (F.sum("new").over(running) + c("bn")) / c("n_new"))
    rows = rows.select("feature_id", "n_old", "n_new", "old_lo", "old_hi", gap.alias("gap"), (F.coalesce(F.lead("value").over(inside), c("after")) - c("value")).alias("dx"))
    out = rows.groupBy("feature_id").agg(
        F.first("n_old").alias("n_old"), F.first("n_new").alias("n_new"), F.max("gap").alias("ks"), F.coalesce(F.sum(c("gap") * c("dx")), F.lit(0.0)).alias("wasserstein"),
        F.first(c("old_hi") - c("old_lo")).alias("spread"),
    )
    size = F.sqrt(c("n_old") * c("n_new") / (c("n_old") + c("n_new")))
    x = (size + 0.12 + F.lit(0.11) / size) * c("ks")
    p = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 21)), F.lit(0.0))
    return out.select("feature_id", "n_old", "n_new", "ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < 0.2, 1.0).otherwise(p))).alias("ks_p"), "wasserstein", F.try_divide("wasserstein", "spread").alias("wasserstein_norm"))


def _binned(long: DataFrame, bins: int) -> DataFrame:
    """Counts by equal-width bin of the baseline; values outside it have bin null."""
    edges = long.filter("not is_new").groupBy(c("feature_id").alias("f")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(c("value").between(c("lo"), c("hi")), F.least(F.floor(F.coalesce(F.try_divide(c("value") - c("lo"), c("hi") - c("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)))
    return long.filter("value is not null").join(edges, c("feature_id") == c("f")).groupBy("feature_id", at.cast("int").alias("bin")).agg(
        F.count_if(~c("is_new")).alias("old"), F.count_if(c("is_new")).alias("new")
    )


def binned_tests(long: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index, chi-square statistic (expected scaled to the comparison's total) and Jensen-Shannon distance."""
    rows = _binned(long, bins)
    w = Window.partitionBy("feature_id")
    rows = rows.select("*", F.sum("old").over(w).alias("n_old"), F.sum("new").over(w).alias("n_new")).filter("bin is not null")
    p, q = F.greatest(c("old") / c("n_old"), F.lit(FLOOR)), F.greatest(c("new") / c("n_new"), F.lit(FLOOR))
    m = (p + q) / 2
    expected = c("old") * c("n_new") / c("n_old")
    return rows.groupBy("feature_id").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"), F.sum(F.when(expected > 0, F.pow(c("new") - expected, 2) / expected)).alias("chi_square"),
        F.sqrt(F.sum((p * F.log(p / m) + q * F.log(q / m)) / 2)).alias("js_distance"),
    )


def report(long: DataFrame) -> DataFrame:
    """All tests beside each other with severity by PSI and KS p, for features with at least 10 values a side."""
    both = distances(long).join(binned_tests(long), "feature_id").filter("n_old >= 10 and n_new >= 10")
    severity: Column = F.when((c("psi") >= 0.25) & (c("ks_p") < 0.01), "high").when((c("psi") >= 0.1) | (c("ks_p") < 0.05), "medium").otherwise("none")
    return both.select("*", severity.alias("severity"), (severity != "none").alias("has_drift"))
