"""Isolation forest (Liu, Ting and Zhou 2008), sequence reconstruction by PCA, and batch scoring.

Trees are grown side by side from bounded samples, one task per tree; their tables are small and of known size
(trees * 2 * sample nodes), so every scoring task gets all of them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import quantiles

c = F.col
TREES, SAMPLE = 50, 256
NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def path_length(n: float) -> float:
    """Mean path of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(matrix: DataFrame, features: list[str], *, key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """Nodes of all trees.  A row joins a tree's sample by a hash of its key, so samples are the same for the same rows."""
    total = matrix.count()
    rate = min(1.0, 2.0 * sample / max(1, total))
    u = lambda tree: F.pmod(F.xxhash64(key, tree, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    # Only the trees that draw a row make one of it.
    drawn_by = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(t) < rate)
    drawn = matrix.select(key, *features, F.explode(drawn_by).alias("tree")).withColumn("__u", u(c("tree")))
    few = Window.partitionBy("tree").orderBy("__u", key)
    drawn = drawn.withColumn("__n", F.row_number().over(few)).filter(c("__n") <= sample)

    def one(pdf):
        import numpy as np

        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["__u", key], kind="stable")[features].to_numpy(float)
        random, limit, rows = np.random.default_rng(seed * 1_000_003 + tree), math.ceil(math.log2(max(2, sample))), []

        def split(own: np.ndarray, depth: int) -> int:
            node = len(rows)
            rows.append(None)
            spread = np.flatnonzero(x[own].max(axis=0) > x[own].min(axis=0)) if len(own) > 1 else []
            if depth >= limit or not len(spread):
                rows[node] = (tree, node, -1, 0.0, -1, -1, depth + path_length(len(own)))
                return node
            f = int(random.choice(spread))
            cut = float(random.uniform(x[own, f].min(), x[own, f].max()))
            below = x[own, f] < cut
            left, right = split(own[below], depth + 1), split(own[~below], depth + 1)
            rows[node] = (tree, node, f, cut, left, right, 0.0)
            return node

        split(np.arange(len(x)), 0)
        return pd.DataFrame(rows, columns=[n.split()[0] for n in NODES.split(", ")])

    return drawn.groupBy("tree").applyInPandas(one, NODES)


def score(matrix: DataFrame, nodes: DataFrame, features: list[str], *, sample: int = SAMPLE) -> DataFrame:
    """Adds iforest_score: 2 ** (-mean path / c(sample)); a missing feature counts as 0."""
    import numpy as np

    table = nodes.orderBy("tree", "node").toPandas()  # at most trees * 2 * sample rows
    spark = matrix.sparkSession
    given = spark.sparkContext.broadcast([g.to_numpy() for _, g in table.groupby("tree")[["feature", "cut", "left", "right", "depth"]]])
    base = path_length(sample)

    @F.pandas_udf("double")
    def paths(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([s.fillna(0.0).to_numpy(float) for s in columns])
        total = np.zeros(len(x))
        for tree in given.value:
            at = np.zeros(len(x), int)
            while True:
                inner = tree[at, 0] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                n = tree[at[rows]]
                below = x[rows, n[:, 0].astype(int)] < n[:, 1]
                at[rows] = np.where(below, n[:, 2], n[:, 3]).astype(int)
            total += tree[at, 4]
        return pd.Series(np.exp2(-total / len(given.value) / base))

    return matrix.withColumn("iforest_score", paths(*[c(f).cast("double") for f in features]))


def score_bounds(scored: DataFrame, score: str = "iforest_score") -> tuple[float | None, float | None]:
    """The least and greatest score of the rows that a forest was fitted on."""
    return tuple(scored.agg(F.min(score), F.max(score)).first())


def normalised(scored: DataFrame, bounds: tuple[float | None, float | None], score: str = "iforest_score", name: str = "iforest_share") -> DataFrame:
    """Adds the score between the bounds of the fit, from 0 to 1; beyond them it stays at the end, and without spread it is 0."""
    low, high = (F.lit(x).cast("double") for x in bounds)
    share = F.least(F.greatest((c(score) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return scored.withColumn(name, F.when(high > low, share).otherwise(F.lit(0.0)))


def contamination(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Median over the features of the share of IQR outliers, between 0.01 and 0.5."""
    q = quantiles.quantiles(matrix, {f: f for f in features}, [0.25, 0.75])
    low = {f: F.lit(None if a is None else a - (b - a) * 1.5).cast("double") for f, (a, b) in q.items()}
    high = {f: F.lit(None if a is None else b + (b - a) * 1.5).cast("double") for f, (a, b) in q.items()}
    rates = matrix.agg(*[F.avg(F.coalesce((c(f) < low[f]) | (c(f) > high[f]), F.lit(False)).cast("double")).alias(f) for f in features])
    rates = rates.unpivot([], features, "f", "rate")
    return rates.agg(F.least(F.greatest(F.percentile("rate", F.lit(0.5)), F.lit(0.01)), F.lit(0.5)).alias("contamination"))  # one row a feature


def sequence_errors(bars: DataFrame, *, n: int = 30, parts: int = 3) -> DataFrame:
    """Reconstruction error of each window of n closes by the first principal components; flagged above the 95th percentile."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    seq = bars.select("symbol", "ts", F.collect_list("close").over(w).alias("a")).filter(F.size("a") == n)
    mean = F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / n
    seq = seq.withColumn("v", array_to_vector(F.transform("a", lambda x: x - mean)))
    model = PCA(k=parts, inputCol="v", outputCol="z").fit(seq)
    axes = model.pc.toArray()  # n by parts
    back = F.array(*[sum((c("zz")[k] * F.lit(float(axes[r, k])) for k in range(parts)), F.lit(0.0)) for r in range(n)])
    e = model.transform(seq).withColumn("zz", vector_to_array("z")).withColumn("vv", vector_to_array("v"))
    error = F.aggregate(F.zip_with("vv", back, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / n
    e = e.select("symbol", "ts", error.alias("error"))
    edge = quantiles.quantiles(e, {"error": "error"}, [0.95])["error"][0]
    return e.select("symbol", "ts", "error", (c("error") > F.lit(edge).cast("double")).alias("is_anomaly"))


def search(rows: DataFrame, spans: tuple[int, ...] = (20, 50, 100), widths: tuple[float, ...] = (2.0, 2.5, 3.0)) -> DataFrame:
    """(span, width, mean_f1, sd_f1) of rolling z-score detectors over five time folds of rows with ``position`` and y."""
    w = lambda n: Window.partitionBy("symbol").orderBy("ts", "trade_id").rowsBetween(-(n - 1), 0)
    z = rows.select("y", "position", *[F.abs(F.try_divide(c("price") - F.avg("price").over(w(n)), F.stddev_samp("price").over(w(n)))).alias(f"z{n}") for n in spans])
    total = z.agg(F.count(F.lit(1)).alias("n"))
    dealt = z.crossJoin(F.broadcast(total)).withColumn("fold", F.least(F.floor((c("position") - 1) * 5 / c("n")), F.lit(4)))  # one row
    grid = [(n, t, F.coalesce(c(f"z{n}") > t, F.lit(False))) for n in spans for t in widths]
    f1 = lambda pred: F.try_divide(F.count_if(c("y") & pred) * 2, F.count_if(pred) + F.count_if("y"))
    # All detectors are counted in one pass: a row a fold comes out, whatever their number.
    each = dealt.groupBy("fold").agg(*[f1(pred).alias(f"f{k}") for k, (_, _, pred) in enumerate(grid)])
    long = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(t).alias("width"), c(f"f{k}").alias("f1")) for k, (n, t, _) in enumerate(grid)])).alias("g"))
    return long.groupBy("g.span", "g.width").agg(F.avg("g.f1").alias("mean_f1"), F.stddev_samp("g.f1").alias("sd_f1"))


def stack(rows: DataFrame, scores: list[str], *, y: str = "y") -> DataFrame:
    """Adds stacked_score: a logistic regression of y on detector scores, fitted on rows with split ``train``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    given = VectorAssembler(inputCols=scores, outputCol="__x").transform(rows.withColumn("__y", c(y).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", maxIter=50).fit(given.filter("split = 'train'"))
    return model.transform(given).withColumn("stacked_score", vector_to_array("__p")[1]).drop("__x", "__y", "__p", "__r", "__c")
