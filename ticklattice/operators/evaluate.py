"""Evaluation of detectors and data splits: confusion counts, ranking metrics, thresholds, delays and comparisons.

Curves run over distinct scores, aggregated first, so prefix sums see one row per score.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders, frames, probability, quantiles, scan

c = F.col


def confusion(rows: DataFrame, *keys: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts and the rates they give, per key, of boolean truth ``y`` and prediction ``pred``."""
    one = rows.groupBy(*keys).agg(
        F.count_if(c(y) & c(pred)).alias("tp"), F.count_if(~c(y) & c(pred)).alias("fp"), F.count_if(~c(y) & ~c(pred)).alias("tn"), F.count_if(c(y) & ~c(pred)).alias("fn")
    )
    d = F.try_divide
    one = one.select("*", d(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")).alias("accuracy"), d("tp", c("tp") + c("fp")).alias("precision"), d("tp", c("tp") + c("fn")).alias("recall"))
    return one.select(
        "*", d(c("precision") * c("recall") * 2, c("precision") + c("recall")).alias("f1"), d("tn", c("tn") + c("fp")).alias("specificity"), d("tn", c("tn") + c("fn")).alias("npv"),
        d("fp", c("fp") + c("tn")).alias("fpr"), d("fn", c("fn") + c("tp")).alias("fnr"),
    )


def by_score(rows: DataFrame, *, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp): rows at each distinct score, and those at or above it.

    Scores are dealt to ranges of about equal numbers of them; sums within a range add to those of the ranges above, so no task sorts all scores.
    """
    g = rows.filter(c(score).isNotNull()).groupBy(c(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~c(y)).alias("neg"))
    g = quantiles.dealt(g, "score")
    sums = g.groupBy(c("part").alias("p")).agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    above = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)  # 64 rows at most
    sums = sums.select("p", F.coalesce(F.sum("a").over(above), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(above), F.lit(0)).alias("b"))
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(F.broadcast(sums), c("part") == c("p"))
    return g.select("score", "pos", "neg", (F.sum("pos").over(w) + c("a")).alias("tp"), (F.sum("neg").over(w) + c("b")).alias("fp"))


def ranking(rows: DataFrame) -> DataFrame:
    """ROC-AUC by mid-ranks and average precision, in one row."""
    s = by_score(rows)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.crossJoin(F.broadcast(total))  # one row
    return s.agg(
        F.try_divide(F.sum(c("neg") * (c("tp") - c("pos")) + c("neg") * c("pos") * 0.5), F.first("p") * F.first("n")).alias("roc_auc"),
        F.try_divide(F.sum(c("pos") * c("tp") / (c("tp") + c("fp"))), F.first("p")).alias("average_precision"),
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicting at or above each distinct score."""
    s = by_score(rows)
    s = s.crossJoin(F.broadcast(s.agg(F.sum("pos").alias("p"))))  # one row
    precision, recall = F.try_divide("tp", c("tp") + c("fp")), F.try_divide("tp", "p")
    return s.select(c("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0)).alias("f1"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the highest F1 (the higher of equals), in one row."""
    return thresholds(rows).agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("b")).select("b.*")


def precision_at_k(rows: DataFrame, k: int, *, tie: str) -> DataFrame:
    return rows.orderBy(F.desc("score"), tie).limit(k).agg(F.avg(c("y").cast("double")).alias("precision_at_k"))


def coverage(rows: DataFrame, reach: int = 5) -> DataFrame:
    """Per key, the share of true rows with a prediction within ``reach`` rows."""
    w = Window.partitionBy("symbol").orderBy("ts", "trade_id").rowsBetween(-reach, reach)
    near = frames.framed(rows, lambda r: r.withColumn("near", F.max(c("pred").cast("int")).over(w) == 1), tie="trade_id", before=reach, after=reach)
    return near.filter("y").groupBy("symbol").agg(F.avg(c("near").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("anomalies"))


def detection_delay(rows: DataFrame, horizon: int = 50) -> DataFrame:
    """Each start of an anomaly with the rows until a prediction: within its segment, and within ``horizon`` rows.

    The next prediction and the end of the segment are the next known places of a flag, found over parts of a series.
    """
    order = Window.partitionBy("symbol").orderBy("ts", "trade_id")

    def build(r: DataFrame) -> DataFrame:
        after = F.lead("y").over(order)
        starts = c("y") & ~F.coalesce(F.lag("y").over(order), F.lit(False))
        return r.select("*", starts.alias("starts"), F.when(c("pred"), 1).alias("__hit"), F.when(after.isNull() | (after != c("y")), 1).alias("__end"))

    r = frames.framed(rows.select("symbol", "ts", "trade_id", "y", "pred"), build, tie="trade_id", before=1, after=1)
    r = scan.known(folders.written(r, "delay"), "__hit", "__end", tie="trade_id").filter("starts")
    r = r.select("symbol", "trade_id", (c("__ahead___hit.n") - c("__n")).cast("int").alias("__far"), (c("__ahead___end.n") - c("__n")).alias("__left"))
    return r.select("symbol", "trade_id", F.when(c("__far") <= c("__left"), c("__far")).alias("delay_segment"), F.when(c("__far") < horizon, c("__far")).alias("delay_horizon"))


def rolling_metrics(rows: DataFrame, n: int = 30) -> DataFrame:
    """Precision and recall over the last n rows of each symbol, and whether the prediction is that of the row before."""
    order = Window.partitionBy("symbol").orderBy("ts", "trade_id")
    w = order.rowsBetween(-(n - 1), 0)
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).over(w)
    tp, fp, fn = count(c("y") & c("pred")), count(~c("y") & c("pred")), count(c("y") & ~c("pred"))
    made = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "consistent": c("pred") == F.lag("pred").over(order)}
    out = frames.framed(rows, lambda r: r.select("*", *[v.alias(k) for k, v in made.items()]), tie="trade_id", before=n, after=0)
    return out.select("symbol", "trade_id", *made)


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement table of two predictions against y, the corrected chi-square, and a p-value, exact unless there are many."""
    right_a, right_b = c(a) == c("y"), c(b) == c("y")
    one = rows.agg(F.count_if(right_a & right_b).alias("both"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.count_if(~right_a & ~right_b).alias("neither"))
    one = one.withColumn("chi_square", F.try_divide(F.pow(F.abs(c("only_a") - c("only_b")) - 1, 2), c("only_a") + c("only_b")))
    return one.withColumn("p_value", probability.sign_p(F.least("only_a", "only_b"), c("only_a") + c("only_b"), c("chi_square")))


def mann_whitney(rows: DataFrame) -> DataFrame:
    """U of the scores of true rows against the rest, its normal approximation z, and a two-sided p-value, which corrects for ties
    and continuity."""
    s = by_score(rows)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    t = (c("pos") + c("neg")).cast("double")
    u = s.crossJoin(F.broadcast(total)).agg(
        F.sum(c("neg") * (c("tp") - c("pos")) + c("neg") * c("pos") * 0.5).alias("u"), F.first("p").alias("n1"), F.first("n").alias("n2"), F.sum(t * t * t - t).alias("ties")
    )
    # Doubles: products of three counts leave the range of longs from some four million rows.
    n1, n2 = c("n1").cast("double"), c("n2").cast("double")
    off, both = c("u") - n1 * n2 / 2, n1 + n2
    u = u.withColumn("z", F.try_divide(off, F.sqrt(n1 * n2 * (both + 1) / 12)))
    spread = F.sqrt(n1 * n2 / 12 * (both + 1 - F.try_divide(c("ties"), both * (both - 1))))
    corrected = F.try_divide(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread)
    return u.withColumn("p_value", probability.two_sided(corrected)).drop("ties")


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test of paired values: pairs that differ, the rank sums of both signs, z with ties corrected, and p-value.

    Absolute differences are counted, dealt to ranges of about equal numbers of them, and ranked by the counts of the ranges below,
    ties at their middle.  Pairs with a null, and equal ones, don't count; without any pair all but the counts is null.
    """
    d = c(a).cast("double") - c(b).cast("double")
    g = rows.select(d.alias("d")).filter("d <> 0 and not isnan(d)").groupBy(F.abs("d").alias("size")).agg(F.count_if(c("d") > 0).alias("up"), F.count(F.lit(1)).alias("t"))
    g = quantiles.dealt(g, "size")
    below = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows at most
    sums = g.groupBy(c("part").alias("p")).agg(F.sum("t").alias("s")).select("p", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = g.join(F.broadcast(sums), c("part") == c("p")).withColumn("rank", c("base") + F.sum("t").over(inside) - (c("t") - 1) / 2.0)
    t = c("t").cast("double")
    one = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(c("rank") * c("up")).alias("w_plus"), F.sum(c("rank") * (c("t") - c("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties")
    )
    n = c("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (n * 2 + 1) / 24 - c("ties") / 48)
    one = one.withColumn("z", F.try_divide(c("w_plus") - n * (n + 1) / 4, spread))
    return one.withColumn("p_value", probability.signed_rank_p(c("n"), F.least("w_plus", "w_minus"), c("ties") > 0, c("z"))).drop("ties")


def paired_t(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = c(a) - c(b)
    one = rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    return one.select("n", "mean_difference", F.try_divide(c("mean_difference"), c("sd") / F.sqrt("n")).alias("t"))


def time_split(rows: DataFrame, ts: str = "ts", tie: str = "trade_id", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds split: the first rows by (ts, tie) train, the next validate, the last test.

    Positions come from counts per day carried forward, so no task sorts all rows.
    """
    day = F.to_date(ts)
    per = rows.groupBy(day.alias("__d")).count()
    w = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    per = per.select("__d", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__b"), F.sum("count").over(Window.partitionBy()).alias("__n"))
    pos = rows.withColumn("__r", F.row_number().over(Window.partitionBy(day).orderBy(ts, tie))).join(F.broadcast(per), day == c("__d"))
    at = c("__b") + c("__r")
    split = F.when(at <= F.floor(c("__n") * train), "train").when(at <= F.floor(c("__n") * (train + validation)), "validation").otherwise("test")
    return pos.withColumn("position", at).withColumn("split", split).drop("__d", "__b", "__n", "__r")


def time_folds(positioned: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, role, rows): expanding training part and the next part as test, of rows with ``position``."""
    n = positioned.agg(F.count(F.lit(1)).alias("n"))
    rows = positioned.crossJoin(F.broadcast(n)).withColumn("part", F.least(F.floor((c("position") - 1) / F.floor(c("n") / (folds + 1))), F.lit(folds)).cast("int"))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).filter("part <= fold")
    return rows.withColumn("role", F.when(c("part") == c("fold"), "test").otherwise("train"))


def scale_params(matrix: DataFrame, features: list[str]) -> dict[str, dict[str, tuple[float | None, float | None]]]:
    """(shift, width) of each feature and kind of scaling: standard (population deviation), minmax and robust."""
    one = matrix.agg(*[a.alias(f"{f}__{n}") for f in features for n, a in (("m", F.avg(f)), ("s", F.stddev_pop(f)), ("lo", F.min(f)), ("hi", F.max(f)))]).first()
    q = quantiles.quantiles(matrix, {f: f for f in features}, [0.25, 0.5, 0.75])
    gap = lambda b, a: None if a is None or b is None else b - a
    return {
        f: {"standard": (one[f"{f}__m"], one[f"{f}__s"]), "minmax": (one[f"{f}__lo"], gap(one[f"{f}__hi"], one[f"{f}__lo"])), "robust": (q[f][1], gap(q[f][2], q[f][0]))}
        for f in features
    }


def scale(matrix: DataFrame, features: list[str], params: dict | None = None) -> DataFrame:
    """Standard, min-max and robust scaling of each feature; a feature without spread gives null."""
    params = params or scale_params(matrix, features)
    number = lambda x: F.lit(x).cast("double")
    return matrix.select("*", *[F.try_divide(c(f) - number(a), number(w)).alias(f"{f}_{kind}") for f in features for kind, (a, w) in params[f].items()])


def unscale(scaled: DataFrame, params: dict, kind: str) -> DataFrame:
    """Adds each feature ``<f>_back`` as it was before scaling, from ``<f>_<kind>``."""
    number = lambda x: F.lit(x).cast("double")
    return scaled.select("*", *[(c(f"{f}_{kind}") * number(params[f][kind][1]) + number(params[f][kind][0])).alias(f"{f}_back") for f in params])


def correlations(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of features, from one pass over the rows that have all of them; null where one is constant."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    held = matrix.select(F.array(*[c(f).cast("double") for f in features]).alias("v")).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    table = Correlation.corr(held.select(array_to_vector("v").alias("v")), "v").first()[0].toArray()  # features by features
    pairs = [(features[i], features[j], float(table[i, j])) for i in range(len(features)) for j in range(i + 1, len(features))]
    return matrix.sparkSession.createDataFrame(pairs, "a string, b string, corr double").select("a", "b", F.nanvl("corr", F.lit(None).cast("double")).alias("corr"))


#: Running chances of a Poisson variable of mean 1 to be at most 0, 1, ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13))


def bootstrap(rows: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """95 % intervals of precision, recall and F1 by a Poisson bootstrap, in one pass without a row a replicate.

    Each row draws a Poisson(1) weight per replicate from a hash, so replicates are the same for the same rows.  A task adds the
    weights of its rows into one array for each pair of truth and prediction; what is shuffled is those four arrays a task.
    """
    import numpy as np
    import pyarrow as pa

    edges, salt = np.array(POISSON), np.uint64(seed)
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        total = np.zeros((4, replicates), np.int64)
        for batch in batches:
            group, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for lo in range(0, len(key), 256):
                part = mixed(key[lo : lo + 256, None] ^ mixed(steps + salt))
                weights = np.searchsorted(edges, (part >> np.uint64(11)).ravel() / 2.0**53, "right").reshape(part.shape)
                for g in range(4):
                    total[g] += weights[group[lo : lo + 256] == g].sum(0)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "w"])

    group = F.when(c("y") & c("pred"), 0).when(~c("y") & c("pred"), 1).when(c("y") & ~c("pred"), 2).otherwise(3)
    drawn = rows.filter("y is not null and pred is not null").select(group.cast("long"), F.xxhash64("trade_id")).mapInArrow(run, "at long, w long")
    m = drawn.groupBy((c("at") % replicates).alias("b")).agg(*[F.coalesce(F.sum(F.when(F.floor(c("at") / replicates) == g, c("w"))), F.lit(0)).alias(name) for g, name in enumerate(("tp", "fp", "fn"))])
    m = m.select(F.try_divide("tp", c("tp") + c("fp")).alias("precision"), F.try_divide("tp", c("tp") + c("fn")).alias("recall"), F.try_divide(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")).alias("f1"))
    long = m.unpivot([], ["precision", "recall", "f1"], "metric", "v")
    return long.groupBy("metric").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


#: Parts whose sums one task carries forward at a time.
CARRY = 4096


def _sums_before(sums: DataFrame, part: str, names: list[str]) -> DataFrame:
    """Replaces each of ``names`` by its sum over the parts before; parts go by blocks, so no task sees them all."""
    cut = sums.withColumn("__block", F.floor(c(part) / CARRY))
    inside = Window.partitionBy("__block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(c("__block").alias("__b")).agg(*[F.sum(x).alias(f"__{x}") for x in names])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per CARRY parts
    blocks = blocks.select("__b", *[F.sum(f"__{x}").over(before).alias(f"__{x}") for x in names])
    local = cut.select(part, "__block", *[F.sum(x).over(inside).alias(x) for x in names])
    joined = local.join(blocks, c("__block") == c("__b"))
    return joined.select(part, *[F.when(c(x).isNotNull() | c(f"__{x}").isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(f"__{x}", F.lit(0))).alias(x) for x in names])


def backtest(rows: DataFrame, step: int = 500) -> DataFrame:
    """Walk-forward test of a z-score detector: parameters of all rows before each part, F1 of the part, and its change.

    Parts are of ``step`` rows by position; sums of counts, values and squares carry the expanding parameters.
    """
    r = rows.withColumn("part", F.floor((c("position") - 1) / step).cast("int"))
    sums = r.groupBy("part").agg(F.count("price").alias("n"), F.sum("price").alias("s"), F.sum(c("price") * c("price")).alias("q"))
    p = _sums_before(sums, "part", ["n", "s", "q"]).filter("n > 1")
    p = p.select(c("part").alias("p"), (c("s") / c("n")).alias("m"), F.sqrt((c("q") - c("s") * c("s") / c("n")) / (c("n") - 1)).alias("sd"))
    scored = r.join(p, c("part") == c("p")).withColumn("pred", F.coalesce(F.abs(c("price") - c("m")) > c("sd"), F.lit(False)))
    f = confusion(scored, "part").select("part", "precision", "recall", "f1")
    prior = f.select((c("part") + 1).alias("__next"), c("f1").alias("__prior"))
    return f.join(prior, c("part") == c("__next"), "left").select("part", "precision", "recall", "f1", F.coalesce(c("f1") < c("__prior") * 0.9, F.lit(False)).alias("degraded"))


def backtest_summary(parts: DataFrame) -> DataFrame:
    """One row on a backtest: means and spread of F1 (none counts as 0), its trend over the parts, stability, parts that fell off."""
    f1 = F.coalesce("f1", F.lit(0.0))
    one = parts.agg(
        F.count(F.lit(1)).alias("parts"), F.avg(f1).alias("mean_f1"), F.stddev_pop(f1).alias("std_f1"), F.min(f1).alias("min_f1"), F.max(f1).alias("max_f1"),
        F.avg(F.coalesce("precision", F.lit(0.0))).alias("mean_precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("mean_recall"),
        F.corr(c("part").cast("double"), f1).alias("__r"), F.count_if("degraded").alias("alerts"),
    )
    trend = F.when(c("parts") < 3, "insufficient_data").when(c("__r") > 0.1, "improving").when(c("__r") < -0.1, "declining").otherwise("stable")
    stability = F.when(c("mean_f1") > 0, 1 - c("std_f1") / c("mean_f1")).otherwise(0.0)
    return one.withColumns({"trend": trend, "stability": stability}).drop("__r")


#: Metrics of a threshold by the counts at or above it (tp, fp) and all there are (p, n).
METRICS = {
    "f1": lambda tp, fp, p, n: F.try_divide(tp * 2, tp + fp + p),
    "accuracy": lambda tp, fp, p, n: F.try_divide(tp + n - fp, p + n),
    "youden": lambda tp, fp, p, n: F.try_divide(tp, p) - F.try_divide(fp, n),
    "balanced_accuracy": lambda tp, fp, p, n: (F.try_divide(tp, p) + 1 - F.try_divide(fp, n)) / 2,
}


def metric_threshold(rows: DataFrame, metric: str = "youden", *, maximize: bool = True) -> DataFrame:
    """(threshold, score): the best of the scores' percentiles 1 to 99 by a metric of METRICS, the lowest of several.

    All candidates are counted in one pass over the distinct scores.
    """
    s = by_score(rows)
    at = quantiles.quantiles(rows, {"score": "score"}, [k / 100 for k in range(1, 100)])["score"]
    spark = rows.sparkSession
    if at[0] is None:
        return spark.createDataFrame([], "threshold double, score double")
    counted = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), *[F.coalesce(F.max(F.when(c("score") >= t, c(x))), F.lit(0)).alias(f"{x}{k}") for k, t in enumerate(at) for x in ("tp", "fp")])
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), METRICS[metric](c(f"tp{k}"), c(f"fp{k}"), c("p"), c("n")).alias("score")) for k, t in enumerate(at)])
    found = counted.select(F.explode(each).alias("e")).select("e.threshold", "e.score").filter("score is not null")
    return found.orderBy(F.desc("score") if maximize else F.asc("score"), "threshold").limit(1)


def target_thresholds(rows: DataFrame, *, precision: float, recall: float) -> DataFrame:
    """(target, threshold, precision, recall): the threshold of most recall that reaches the precision, and that of most precision
    that reaches the recall; no row for a target out of reach."""
    t = thresholds(rows)
    reach = lambda name, least, most: t.filter(c(name) >= least).orderBy(F.desc(most), F.desc("threshold")).limit(1).select(F.lit(name).alias("target"), "threshold", "precision", "recall")
    return reach("precision", precision, "recall").unionByName(reach("recall", recall, "precision"))


def contamination_threshold(rows: DataFrame, share: float) -> float | None:
    """The score above which about ``share`` of the rows lie."""
    return quantiles.quantiles(rows, {"score": "score"}, [1 - share])["score"][0]
