"""Exact quantiles of large columns: no task holds all values of a column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ticklattice.functions import folders

c = F.col
#: Ranges into which the values of each column are dealt.
PARTS = 64


def dealt(counts: DataFrame, value: str, *, key: str | None = None, parts: int = PARTS) -> DataFrame:
    """Adds part: the range of ``value``, of about equal numbers of rows (per ``key``), in rising order.

    The edges come to the driver first (``parts`` numbers a key), so whatever reads the rows again finds the same ranges.
    """
    at = F.percentile_approx(c(value).cast("double"), [i / parts for i in range(1, parts)], 20 * parts).alias("__edges")
    given = counts.groupBy(*([key] if key else [])).agg(at).filter("__edges is not null").collect()
    place = F.size(F.filter("__edges", lambda x: x < c(value))).alias("part")
    if key is None:
        edges = F.array(*[F.lit(e) for e in (given[0][0] if given else [])]).cast("array<double>")
        return counts.withColumn("__edges", edges).select(*counts.columns, place)
    limits = counts.sparkSession.createDataFrame(given, StructType([counts.schema[key], StructField("__edges", ArrayType(DoubleType()))]))
    return counts.join(F.broadcast(limits), key).select(*counts.columns, place)


#: Bits that one scan settles, and entries of a task's histogram that go out together.
BITS, HELD = 16, 1 << 20
#: Rows of a key from which its quantiles come from histograms; keys with fewer are aggregated as they are.
LARGE = 1 << 20


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _double(u: int) -> float:
    u = u ^ (1 << 63) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array(u, np.uint64).view(np.float64))


def _histogram(values: DataFrame, targets: list[tuple[int, int]], level: int, keyed: bool) -> DataFrame:
    """(code, n): how many values of target t, those of column (or key) k with the leading bits p of ``targets``[t] = (k, p), go on
    with the bits b, at code = t << BITS | b.  A task adds up its own before anything is shuffled."""
    by_column: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in {k for k, _ in targets}:
        own = sorted((p, t) for t, (x, p) in enumerate(targets) if x == k)
        by_column[k] = np.array([p for p, _ in own], np.uint64), np.array([t for _, t in own], np.int64)
    below = np.uint64(64 - BITS * (level + 1))

    def codes(k: int, x: np.ndarray) -> np.ndarray:
        prefixes, place = by_column[k]
        u = _ordered(x[~np.isnan(x)])
        if level:
            lead = u >> (below + np.uint64(BITS))
            at = np.minimum(np.searchsorted(prefixes, lead), len(prefixes) - 1)
            hit = prefixes[at] == lead
            u, at = u[hit], at[hit]
        else:
            at = np.zeros(len(u), np.int64)
        return (place[at] << BITS) | ((u >> below) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)

        def merged(new: list[np.ndarray]) -> np.ndarray:
            code, n = np.unique(np.concatenate(new), return_counts=True)
            both, inverse = np.unique(np.concatenate([held[0], code]), return_inverse=True)
            return np.stack([both, np.bincount(inverse, np.concatenate([held[1], n]), len(both)).astype(np.int64)])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["code", "n"])

        for batch in batches:
            if keyed:
                key, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                new = [codes(k, x[key == k]) for k in np.unique(key).tolist() if k in by_column]
            else:
                new = [codes(k, batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64)) for k in by_column]
            if new:
                held = merged(new)
            if held.shape[1] > HELD:
                yield made()
                held = np.zeros((2, 0), np.int64)
        if held.shape[1]:
            yield made()

    return values.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _ranked(values: DataFrame, columns: list[int], probs: list[float], keyed: bool) -> dict[int, list[float | None]]:
    """Quantiles of each column (or key): four scans narrow the bits of every rank's value from the first to the last."""
    spark = values.sparkSession
    targets = [(k, 0) for k in columns]
    wanted: dict[tuple[int, int], int] = {}  # (column, rank): rank among the values of its target
    total = dict.fromkeys(columns, 0)
    for level in range(64 // BITS):
        counts = folders.written(_histogram(values, targets, level, keyed), "histogram")
        if not level:
            for k, n in counts.groupBy(F.shiftright("code", BITS).alias("t")).agg(F.sum("n")).collect():  # a row a column
                total[targets[k][0]] = n
            for k, n in total.items():
                for p in probs if n else ():
                    wanted |= {(k, r): r for r in (math.floor((n - 1) * float(p)), math.ceil((n - 1) * float(p)))}
            at = {key: targets.index((key[0], 0)) for key in wanted}
        if not wanted:
            break
        names = list(wanted)
        ranks = spark.createDataFrame([(i, at[x], wanted[x]) for i, x in enumerate(names)], "i long, t long, rank long")
        upto = Window.partitionBy("t").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** BITS rows
        summed = counts.withColumn("t", F.shiftright("code", BITS)).withColumn("last", F.sum("n").over(upto))
        found = summed.join(F.broadcast(ranks), "t").filter("last - n <= rank and rank < last").select("i", "t", "code", (c("rank") - c("last") + c("n")).alias("rest"))
        prefix: dict[tuple[int, int], int] = {}
        for i, t, code, rest in found.collect():  # a row a rank
            prefix[names[i]] = targets[t][1] << BITS | code & ((1 << BITS) - 1)
            wanted[names[i]] = rest
        targets = sorted({(x[0], p) for x, p in prefix.items()})
        place = {x: t for t, x in enumerate(targets)}
        at = {x: place[x[0], p] for x, p in prefix.items()}
    out: dict[int, list[float | None]] = {k: [None] * len(probs) for k in columns}
    for k, n in total.items():
        for i, p in enumerate(probs if n else ()):
            x = (n - 1) * float(p)
            a, b = (_double(targets[at[k, r]][1]) for r in (math.floor(x), math.ceil(x)))
            out[k][i] = a + (b - a) * (x - math.floor(x))
    return out


def quantiles(rows: DataFrame, columns: dict[str, Column | str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles (linear between neighbours) of each named column, as numbers, by radix refinement.

    Each of four scans counts, for all columns at once, the next 16 bits of the values that still may hold a wanted rank; tasks
    add up their own counts, so no row is multiplied and no value is shuffled.  What comes to the driver has a row a column and
    rank.  Nulls and NaN don't count; a column without values has None.
    """
    made = [(c(x) if isinstance(x, str) else x).cast("double").alias(f"c{k}") for k, x in enumerate(columns.values())]
    found = _ranked(rows.select(*made), list(range(len(made))), probs, keyed=False)
    return {name: found[k] for k, name in enumerate(columns)}


def by_key(rows: DataFrame, key: str, x: str, probs: dict[str, float], *, large: int = LARGE) -> DataFrame:
    """(key, a column a quantile of ``x``) for every key, null where it has no value.

    Keys of more than ``large`` rows, of which a table holds no more than its rows by that number, go through ``quantiles``'
    histograms; for the others each key's values are aggregated together.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(c(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter(c("__n") > large)
    hot = [r[0] for r in sizes.collect()]
    value = c(x).cast("double")
    plain = lambda df: df.groupBy(key).agg(*[F.percentile(F.when(~F.isnan(value), value), F.lit(p)).alias(name) for name, p in probs.items()])
    if not hot:
        return plain(rows)
    kind = rows.schema[key].dataType
    named = spark.createDataFrame([(k, i) for i, k in enumerate(hot)], StructType([StructField("__key", kind), StructField("__g", LongType())]))
    marked = rows.join(F.broadcast(named), c(key).eqNullSafe(c("__key")), "left")
    found = _ranked(marked.filter("__g is not null").select("__g", value.alias("v")), list(range(len(hot))), list(probs.values()), keyed=True)
    fields = [StructField(key, kind), *[StructField(name, DoubleType()) for name in probs]]
    of_hot = spark.createDataFrame([(k, *found[i]) for i, k in enumerate(hot)], StructType(fields))
    return plain(marked.filter("__g is null").select(*rows.columns)).unionByName(of_hot)
