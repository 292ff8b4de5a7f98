"""Exact nearest neighbours between two tables, by cells around pivots.

Points go to the cell of their nearest pivot, which knows its number of points and its radius.  A query reaches, by the triangle
inequality, every cell that may hold one of its k nearest and no other.  Cells are cut into blocks of points, and the queries of
a crowded cell into shares, so a task holds one block and streams its queries past it; each query leaves with k rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders

c = F.col
#: Pivots at least and at most (else the root of the number of points), points of a block, queries of a share.
PIVOTS, MOST_PIVOTS, BLOCK, SHARE = 256, 2048, 4096, 1 << 16
#: Rows that are compared with all pivots at once.
ROWS = 1024
#: What rounding may take from a distance.
SLACK = 1e-9


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)]) if n else np.zeros((batch.num_rows, 0))


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, as sums of squared differences."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[:, k]) ** 2
    return out


def nearest(queries: DataFrame, points: DataFrame, features: list[str], k: int, *, query_id: str = "query_id", point_id: str = "point_id", pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, point_id, distance: squared, rank from 1) of each query's k nearest points (all, if fewer), ties to the smaller id.

    Ids are longs, unique on each side; rows with a null or NaN feature take no part.  No points, no rows.  Of points with equal
    features only the k of smallest id can be among anyone's k nearest, so no more are kept.
    """
    spark, n = queries.sparkSession, len(features)
    good = F.forall(F.array(*[c(f).cast("double") for f in features]), lambda x: x.isNotNull() & ~F.isnan(x))
    numbers = [c(f).cast("double").alias(f) for f in features]
    p = points.filter(good).select(c(point_id).cast("long").alias("id"), *numbers)
    p = folders.written(p.withColumn("__r", F.row_number().over(Window.partitionBy(*features).orderBy("id"))).filter(c("__r") <= k).drop("__r"), "points")
    if pivots is None:
        pivots = min(max(PIVOTS, int(p.count() ** 0.5)), MOST_PIVOTS)
    q = queries.filter(good).select(c(query_id).cast("long").alias("id"), *numbers)
    # A bounded number of rows by the order of a hash.
    chosen = p.orderBy(F.xxhash64("id"), "id").limit(pivots).select(*features).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, point_id long, distance double, rank int")
    centers = np.unique(np.array([list(r) for r in chosen], float), axis=0)
    fields = ", ".join(f"`{f}` double" for f in features)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(lo, ROWS) for lo in range(0, batch.num_rows, ROWS))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            d = _far(_matrix(batch, 1, n), centers)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], names=["id", *features, "cell", "off"])

    p = folders.written(p.mapInArrow(placed, f"id long, {fields}, cell long, off double"), "points")
    known = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()  # a row a pivot
    held, radius = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    for r in known:
        held[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    blocks = -(-held // block)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            d = np.sqrt(_far(_matrix(batch, 1, n), centers))
            d[:, held == 0] = np.inf
            by = np.argsort(d + radius, axis=1)
            enough = np.cumsum(held[by], axis=1) >= k
            last = np.where(enough.any(1), enough.argmax(1), len(centers) - 1)
            rows = np.arange(len(d))
            most = np.where(enough.any(1), (d + radius)[rows, by[rows, last]], np.inf)
            at, cell = np.nonzero(np.isfinite(d) & (d - radius <= (most * (1 + SLACK) + SLACK)[:, None]))
            yield pa.RecordBatch.from_arrays([*(col.take(pa.array(at)) for col in batch.columns), pa.array(cell)], names=["id", *features, "cell"])

    asked = folders.written(q.mapInArrow(sent, f"id long, {fields}, cell long"), "asked")
    shares = np.ones(len(centers), np.int64)
    for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        shares[r["cell"]] = -(-r["n"] // SHARE)
    table = F.broadcast(spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(blocks, shares, strict=True))], "cell long, blocks long, shares long"))
    of = lambda x: F.pmod(F.xxhash64("id"), c(x))
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), c(x) - 1))
    left = p.join(table, "cell").withColumn("block", of("blocks")).withColumn("share", every("shares"))
    right = asked.join(table, "cell").filter("blocks > 0").withColumn("share", of("shares")).withColumn("block", every("blocks"))
    columns = ["cell", "block", "share", "is_query", "id", *features]
    both = left.withColumn("is_query", F.lit(False)).select(*columns).unionByName(right.withColumn("is_query", F.lit(True)).select(*columns))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, np.zeros(0, np.int64), np.zeros((0, n))
        for batch in batches:
            key = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            query, own = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            x = _matrix(batch, 5, n)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is None or tuple(key[a]) != now:
                    now, ids, rows = tuple(key[a]), np.zeros(0, np.int64), np.zeros((0, n))
                first = a + int((~query[a:b]).sum())  # points come before queries
                ids, rows = np.concatenate([ids, own[a:first]]), np.concatenate([rows, x[a:first]])
                by_id = np.argsort(ids, kind="stable")
                ids, rows = ids[by_id], rows[by_id]
                for lo in range(first, b, 256):
                    d = _far(x[lo : min(b, lo + 256)], rows)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    at = np.arange(len(d))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own[lo : lo + len(d)], best.shape[1])), pa.array(ids[best.ravel()]), pa.array(d[at[:, None], best].ravel())],
                        names=["query_id", "point_id", "distance"],
                    )

    dealt = both.repartition("cell", "block", "share").sortWithinPartitions("cell", "block", "share", "is_query")
    near = dealt.mapInArrow(found, "query_id long, point_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "point_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
