"""Lineage of features: events, edges, what depends on what, and its impact."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders

c = F.col


def edges(events: DataFrame) -> DataFrame:
    """(src, dst): each feature and what it was made from, from events (feature_id, kind, ts, dependencies)."""
    return events.select(F.explode("dependencies").alias("src"), c("feature_id").alias("dst")).distinct()


def reachable(graph: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance): what each named root (node) reaches along (src, dst) in at most ``depth`` steps, at its least distance.

    A frontier is written before the next step is taken, so a level costs one join of the frontier with the graph.  The result
    has a row a root and node: name roots, and ask ``reach`` for counts of all nodes.  Null nodes are nobody's neighbour.
    """
    seen = folders.written(start.select(c("node").alias("root"), "node", F.lit(0).alias("distance")).distinct(), "reach")
    front, levels = seen, seen
    for k in range(1, depth + 1):
        step = front.join(graph, front.node == graph.src).select("root", c("dst").alias("node")).distinct()
        front = folders.written(step.join(levels.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k)), "reach")
        if not front.limit(1).count():
            break
        levels = levels.unionByName(front)
    return levels.filter("distance > 0")


#: Nodes that a sketch of a reachable set holds at most: counts below are exact, beyond the error is about one in its root.
SKETCH = 256


def reach(graph: DataFrame, nodes: DataFrame, depth: int, *, size: int = SKETCH) -> DataFrame:
    """(node, of): for every node the ``size`` nodes of least hash among those it reaches in at most ``depth`` steps, itself included.

    The least hashes of a union are found among the least of its parts, so each step joins the edges with the sketches once and
    keeps the least; a node's rows are cut down in every task before they meet.
    """
    least = Window.partitionBy("node").orderBy(F.xxhash64("of"), "of")
    sketch = folders.written(nodes.select("node", c("node").alias("of")).filter("node is not null").distinct(), "sketch")
    edges_ = folders.written(graph.select("src", "dst").distinct(), "graph")
    for _ in range(depth):
        further = edges_.join(sketch, c("dst") == c("node")).select(c("src").alias("node"), "of")
        both = sketch.unionByName(further).distinct()
        sketch = folders.written(both.withColumn("__n", F.row_number().over(least)).filter(c("__n") <= size).drop("__n"), "sketch")
    return sketch


def rollup(events: DataFrame) -> DataFrame:
    """Counts by kind and latest times of each feature."""
    return events.groupBy("feature_id").agg(
        F.count_if(c("kind") == "computed").alias("computations"), F.count_if(c("kind") == "accessed").alias("accesses"),
        F.max(F.when(c("kind") == "computed", c("ts"))).alias("last_computed"), F.max(F.when(c("kind") == "accessed", c("ts"))).alias("last_accessed"),
    )


def _accessed(events: DataFrame) -> DataFrame:
    return folders.written(rollup(events).select("feature_id", "accesses"), "use")


def _numbered(nodes: DataFrame, name: str) -> DataFrame:
    """(node, number): places from 0 in the order of ``name``, by ranges of it, so no task sorts all; null has none."""
    dealt = nodes.filter(c(name).isNotNull()).select(c(name).alias("node")).repartitionByRange("node")
    dealt = folders.written(dealt.withColumn("part", F.spark_partition_id()), "nodes")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = dealt.groupBy(c("part").alias("p")).agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    return folders.written(dealt.withColumn("place", place).join(F.broadcast(sizes), c("part") == c("p")).select("node", (c("base") + c("place") - 1).alias("number")), "nodes")


def _counted_once(events: DataFrame) -> DataFrame:
    """(feature_id, src, accesses): a row a feature and what it was made from, its accesses spread over them; the events are read once."""
    each = events.select("feature_id", "kind", F.posexplode_outer("dependencies").alias("at", "src"))
    accessed = F.count_if((c("kind") == "accessed") & (F.coalesce("at", F.lit(0)) == 0))  # an event has a row for each of its dependencies
    return folders.written(each.groupBy("feature_id", "src").agg(accessed.alias("accesses")), "pairs")


#: Targets that a bitmap names at most, sources that a task holds bitmaps of, edges that it follows at once.
SLAB, SOURCES, CHUNK = 4096, 1 << 17, 1 << 11
#: Sources of a piece of an edge list, and bitmaps that one step sends to tasks, about (5 GB at most).
PIECE, SENT = 256, 1 << 23


def _or_into(held: np.ndarray, to: np.ndarray, bits: np.ndarray, at: np.ndarray) -> None:
    """held[to] |= bits[at] for each edge; edges to the same row take turns."""
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    turn = np.arange(len(to)) - np.repeat(first, np.diff(first, append=len(to)))
    by, ends = np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        e = by[lo:hi]
        held[to[e]] |= bits[at[e]]


class _Reached:
    """One bitmap a target slab for each source of a range, as they come to a task that adds them up."""

    def __init__(self, sources: int, width: int):
        self.sources, self.width = sources, width

    def gathered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(key, bitmaps of all sources, accesses of the slab's targets) of a partition's keys, from (key, to, bits); without ``to`` bits are accesses."""
        held, use = {}, {}
        for batch in batches:
            for key in np.unique(batch.column(0).to_numpy()).tolist():
                rows = batch.filter(pc.equal(batch.column(0), key))
                if key not in held:
                    held[key], use[key] = np.zeros((self.sources, self.width // 64), np.uint64), np.zeros(self.width, np.int64)
                if rows.column(1).null_count:
                    for told in rows.filter(pc.is_null(rows.column(1))).column(2).to_pylist():
                        use[key] = np.frombuffer(told, np.int64)
                    rows = rows.filter(pc.is_valid(rows.column(1)))
                bits, ends = _bitmaps(rows.column(2), self.width), np.cumsum(pc.list_value_length(rows.column(1)).to_numpy())
                to = rows.column(1).flatten().to_numpy()
                for lo in range(0, len(to), CHUNK):
                    hi = min(lo + CHUNK, len(to))
                    _or_into(held[key], to[lo:hi], bits, np.searchsorted(ends, np.arange(lo, hi), side="right"))
        for key in held:
            yield key, held[key], use[key]

    def rows(self, key: int, slabs: int, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, their bitmaps), few at once, of those that reach something."""
        for lo in range(0, self.sources, SLAB):
            part = held[lo : lo + SLAB]
            some = np.flatnonzero(part.any(axis=1))
            if len(some):
                yield key // slabs * self.sources + lo + some, part[some]


def _bitmaps(column: pa.BinaryArray, width: int) -> np.ndarray:
    """A row of words of 64 bits for each value; all have ``width`` bits."""
    if not len(column):
        return np.zeros((0, width // 64), np.uint64)
    lo = column.offset * width // 8
    return np.frombuffer(column.buffers()[2], np.uint8)[lo : lo + len(column) * width // 8].reshape(-1, width // 8).view(np.uint64)


def _binary(bits: np.ndarray) -> pa.BinaryArray:
    size = bits.shape[1] * 8
    ends = np.arange(len(bits) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))])


def _sums(bits: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The sum of ``use`` over the bits of each row, by a table of sums of each byte."""
    byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    table, at = (use.reshape(-1, 8) @ byte.T).ravel(), np.arange(len(use) // 8) * 256
    return np.concatenate([table[bits[k : k + 512].view(np.uint8) + at].sum(axis=1) for k in range(0, len(bits), 512)])


def reach_all(graph: DataFrame, numbers: DataFrame, accesses: DataFrame, depth: int, *, width: int = SLAB, sources: int = SOURCES, sent: int = SENT) -> DataFrame:
    """(node, reached, used): for every node the number of nodes it reaches in at most ``depth`` steps, itself included, and the sum of their accesses.

    ``graph`` (src, dst) and ``accesses`` (number, accesses) name nodes by their ``numbers`` (node, number), from 0 without gaps.  Pairs of
    nodes are bits of a bitmap a source and slab of ``width`` targets.  A step sends a target's bitmap once to each range of ``sources`` that
    has edges to it, with these edges, and a task adds up the bitmaps of a range and slab.  The work is quadratic at worst (edges by slabs);
    a task holds one range's bitmaps.  Steps that would send more than ``sent`` bitmaps go over parts of the slabs, one after the other to
    the end, of which only the counts stay, so the disk is bounded too.
    """
    spark, n = numbers.sparkSession, numbers.count()
    width = min(width, max(1, -(-n // 64)) * 64)
    sources = min(sources, max(width, -(-n // 4)))
    ranges, kernel = max(1, -(-n // sources)), _Reached(sources, width)
    graph = graph if depth else graph.limit(0)
    itself = numbers.select(c("number").alias("src"), c("number").alias("dst"))
    lists = graph.unionByName(itself).groupBy("dst", F.floor(c("src") / sources).cast("int").alias("range")).agg(F.collect_set((c("src") % sources).cast("int")).alias("__all"))
    cut = F.expr(f"transform(sequence(0, size(__all) - 1, {PIECE}), k -> slice(__all, k + 1, {PIECE}))")
    pieces = folders.written(lists.select("dst", "range", F.explode(cut).alias("to")), "graph")
    each = pieces.count() / max(1, n)
    place = (c("number") % width).cast("int")
    use = accesses.groupBy(F.floor(c("number") / width).cast("int").alias("slab")).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "accesses")))["accesses"].alias("accesses"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.pad(x.values.to_numpy(), (0, width - len(x.values))) for x in batch.column(1)]
            if each:
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(np.array(each, np.int64))], names=["slab", "bits"])

    use = folders.written(use.mapInArrow(packed, "slab int, bits binary"), "use")
    counts = folders.folder(spark, "counts")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            bits = np.zeros((len(number), width // 8), np.uint8)
            bits[np.arange(len(number)), number % width // 8] = 1 << (number % 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((number // width).astype(np.int32)), _binary(bits.view(np.uint64))], names=["node", "slab", "bits"])

    def sends(words: DataFrame, lo: int, hi: int, last: bool) -> DataFrame:
        """(key, to, bits), a partition a key."""
        key = lambda r: (r * (hi - lo) + c("slab") - lo).cast("int").alias("key")
        out = words.join(pieces, c("node") == c("dst")).select(key(c("range")), "to", "bits")
        if last:
            told = use.filter((c("slab") >= lo) & (c("slab") < hi)).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
            out = out.unionByName(told.select(key(c("range")), F.lit(None).cast("array<int>").alias("to"), "bits"))
        return out.repartitionById(ranges * (hi - lo), "key")

    def further(words: DataFrame, lo: int, hi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, held, _ in kernel.gathered(batches):
                for node, bits in kernel.rows(key, hi - lo, held):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), lo + key % (hi - lo), np.int32)), _binary(bits)], names=["node", "slab", "bits"])

        return sends(words, lo, hi, False).mapInArrow(run, "node long, slab int, bits binary")

    def counted(words: DataFrame, lo: int, hi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, held, use in kernel.gathered(batches):
                for node, bits in kernel.rows(key, hi - lo, held):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bitwise_count(bits).sum(axis=1, dtype=np.int64)), pa.array(_sums(bits, use))], names=["node", "reached", "used"])

        return sends(words, lo, hi, True).mapInArrow(run, "node long, reached long, used long")

    def go(words: DataFrame, left: int, lo: int, hi: int) -> None:
        parts = max(1, min(hi - lo, math.ceil(words.count() * each / sent)))
        cuts = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = words if parts == 1 else words.filter((c("slab") >= a) & (c("slab") < b))
            if left == 1:
                counted(part, a, b).write.mode("append").parquet(counts)
            else:
                with folders.held(further(part, a, b), "words") as reached:
                    go(reached, left - 1, a, b)

    with folders.swept(spark), folders.held(numbers.select("number").mapInArrow(first, "node long, slab int, bits binary"), "words") as words:
        go(words, max(1, depth), 0, max(1, -(-n // width)))
    sums = spark.read.schema("node long, reached long, used long").parquet(counts).groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("used").alias("used"))
    return sums.select(c("node").alias("number"), "reached", "used").join(numbers, "number").select("node", "reached", "used")


def impact_of_all(events: DataFrame, depth: int = 5, **sizes: int) -> DataFrame:
    """What ``impact`` estimates from sketches, counted: exact for every feature, however many depend on it.  ``sizes``: of ``reach_all``."""
    pairs = _counted_once(events)
    use = folders.written(pairs.groupBy("feature_id").agg(F.sum("accesses").alias("accesses")), "use")
    numbers = _numbered(use, "feature_id")
    named = lambda name, to: numbers.select(c("node").alias(name), c("number").alias(to))
    graph = pairs.filter("src is not null").join(named("src", "__src"), "src").join(named("feature_id", "__dst"), "feature_id").select(c("__src").alias("src"), c("__dst").alias("dst"))
    counted = reach_all(graph, numbers, use.join(named("feature_id", "number"), "feature_id").select("number", "accesses"), depth, **sizes)
    # A feature reaches itself, so its own accesses are among those used; one without a name reaches nothing.
    return use.join(counted, c("feature_id") == c("node"), "left").select(
        "feature_id", F.coalesce(c("reached") - 1, F.lit(0)).alias("dependents"), F.least(F.coalesce("used", "accesses") / 100, F.lit(10.0)).alias("impact"), F.lit(True).alias("is_exact")
    )


def impact(events: DataFrame, depth: int = 5, *, size: int = SKETCH) -> DataFrame:
    """Dependents of each feature and a score: accesses of it and its dependents over 100, 10 at most; ``is_exact`` where both are.

    Reachable sets come as sketches; beyond ``size`` nodes their number follows from the largest hash kept, and their accesses
    from the mean of those kept.
    """
    use = _accessed(events)
    sketch = reach(edges(events), use.select(c("feature_id").alias("node")), depth, size=size)
    held = sketch.join(use, sketch.of == use.feature_id).groupBy("node").agg(
        F.count(F.lit(1)).alias("kept"), F.max(F.xxhash64("of")).alias("last"), F.sum(F.when(c("of") != c("node"), c("accesses"))).alias("below"),
        F.count(F.when(c("of") != c("node"), 1)).alias("others"),
    )
    share = (c("last").cast("double") + 2.0**63) / 2.0**64
    exact = c("kept") < size
    dependents = F.when(exact, c("kept") - 1).otherwise(F.round((size - 1) / share) - 1).cast("long")
    below = F.when(exact, F.coalesce("below", F.lit(0)).cast("double")).otherwise(c("below") / c("others") * dependents)
    found = held.select("node", exact.alias("is_exact"), dependents.alias("dependents"), below.alias("below"))
    return use.join(found, use.feature_id == found.node).select("feature_id", "dependents", F.least((c("accesses") + c("below")) / 100, F.lit(10.0)).alias("impact"), "is_exact")
