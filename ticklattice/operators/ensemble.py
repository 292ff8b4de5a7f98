"""Weights of detectors from how they did, on the whole and near the row that is judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklattice.functions import folders
from ticklattice.operators import neighbours

c = F.col
#: Least weight of a detector before weights are brought to a sum of 1.
LEAST = 0.1


def auto_weights(rows: DataFrame, flags: list[str], *, folds: int = 3, y: str = "y") -> dict[str, float]:
    """Each detector's mean F1 over ``folds`` parts of the rows by ``position``, LEAST at least, brought to a sum of 1.

    One aggregation counts all detectors in all parts.  No rows, equal weights.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    fold = F.least(F.floor((c("position") - F.lit(1)) * folds / c("n")), F.lit(folds - 1))
    first = rows.agg(F.min("position").alias("first"))
    dealt = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(first))  # one row each
    dealt = dealt.withColumn("position", c("position") - c("first") + 1).withColumn("fold", fold)
    f1 = lambda f: F.coalesce(F.try_divide(F.count_if(c(y) & c(f)) * 2, F.count_if(c(f)) + F.count_if(c(y))), F.lit(0.0))
    each = dealt.groupBy("fold").agg(*[f1(f).alias(f) for f in flags]).agg(*[F.avg(f).alias(f) for f in flags]).first()
    raw = {f: max(each[f] if each[f] is not None else LEAST, LEAST) for f in flags}
    return {f: w / sum(raw.values()) for f, w in raw.items()}


def select(rows: DataFrame, validation: DataFrame, flags: list[str], features: list[str], weights: dict[str, float], *, k: int = 25, margin: float = 0.1, key: str = "trade_id", y: str = "y") -> DataFrame:
    """Adds dynamic_score and n_selected to ``rows``: the vote of the detectors that did well around each row.

    A row's region of competence is its k nearest ``validation`` rows by ``features``.  A detector's competence is the share of them
    that it judged right; those within ``margin`` of the best take part, with their weight times their competence.  Rows without a
    neighbour (no validation, or a null feature) get the plain weighted vote of all detectors.  Rows with equal features have one
    region, which is searched once.
    """
    regions = folders.written(rows.groupBy(*features).agg(F.min(key).alias("query_id")), "regions")
    near = neighbours.nearest(regions, validation.withColumnRenamed(key, "point_id"), features, k)
    right = validation.select(c(key).alias("__p"), *[(c(f) == c(y)).cast("double").alias(f"__{f}") for f in flags])
    local = near.join(right, c("point_id") == c("__p")).groupBy(c("query_id").alias("__q")).agg(*[F.avg(f"__{f}").alias(f"__{f}") for f in flags])
    local = regions.join(local, c("query_id") == c("__q")).select("__q", *[c(f).alias(f"__at_{f}") for f in features], *[f"__{f}" for f in flags])
    both = rows.join(local, reduce(lambda a, b: a & b, [c(f) == c(f"__at_{f}") for f in features]), "left")
    known = c("__q").isNotNull()
    best = F.greatest(*[c(f"__{f}") for f in flags]) if len(flags) > 1 else c(f"__{flags[0]}")
    taken = {f: F.when(known, F.when(c(f"__{f}") >= best - margin - 1e-12, c(f"__{f}") * weights[f]).otherwise(0.0)).otherwise(weights[f]) for f in flags}
    total = reduce(lambda a, b: a + b, taken.values())
    vote = reduce(lambda a, b: a + b, [w * c(f).cast("double") for f, w in taken.items()])
    number = reduce(lambda a, b: a + b, [(w > 0).cast("int") for w in taken.values()])
    return both.select(*rows.columns, F.coalesce(F.try_divide(vote, total), F.lit(0.0)).alias("dynamic_score"), number.alias("n_selected"))
