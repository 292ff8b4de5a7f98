"""Exact Jaccard join of shingle sets by their count vectors, and the components of its links.

Tokens (hashes of shingles) are dealt into groups, and a set is the point of its groups' counts.  Sets that differ in at most
D tokens agree in all counts of at least one of D + 1 parts of the groups, so the upper levels of the index are cells: the
points with equal counts in one part, for sets of about one size.  Inside a cell a packed R-tree over coarser counts bounds the
overlap of two boxes, and at last of two points, by the sum of the smaller upper counts; the pairs that survive are verified by
their whole sets.  Cells whose points are linked already hold nothing more to find: a first pass links the points of a cell with
one of them, and only cells that still hold two components are searched.  A large cell is searched by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import shared
from . import text as tx
from .nearcopies import shingles

c = F.col
SHINGLE = 3
#: Similarity from which two sets are linked, as a fraction.
LEAST = (9, 10)
#: Sizes of a band, largest by smallest; groups of a part; groups of the vector that trees hold.
RATIO, GROUPS, COORDS = 1.5, 32, 64
#: Parts of a point that are known inside a cell, so that a pair is tested in the first of them that both share.
HEAD = 16
#: Points of a leaf, points of a block of a cell, and pairs of boxes that are bounded at once.
LEAF, BLOCK, AT_ONCE = 16, 4096, 1 << 15

_DIGESTS = tx.mix(np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64))
_WEIGHTS = tx.mix(np.arange(1, GROUPS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(least: tuple[int, int], most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands and the number of parts of each, one more than two sets of the band may differ in and be linked."""
    p, q = least
    first = [-(-(p + q) // (2 * (q - p)))]
    while first[-1] < most:
        first.append(max(first[-1] + 1, int(first[-1] * RATIO)))
    edges = np.array(first)
    return edges[:-1], 2 * (edges[1:] - 1) * (q - p) // (p + q) + 1


def cells(row: np.ndarray, found: np.ndarray, band: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cells, one a part, and the rows' offsets; ``band`` is a row's band, or -1, ``parts`` the parts of each band."""
    each = np.where(band >= 0, parts[band], 0)
    at = np.concatenate([[0], np.cumsum(each)])
    used = band[row] >= 0
    row, hashed = row[used], tx.mix(found[used] + np.uint64(1))
    part = ((hashed >> np.uint64(32)) * each[row].astype(np.uint64)) >> np.uint64(32)
    group = (at[row] + part.astype(np.int64)) * GROUPS + (hashed % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(group, minlength=at[-1] * GROUPS).reshape(-1, GROUPS).astype(np.uint64)
    of = np.repeat(np.arange(len(band)), each)
    place = ((np.arange(at[-1]) - at[of]) + (band[of] << 40)).astype(np.uint64)
    return tx.mix((counts * _WEIGHTS).sum(axis=1, dtype=np.uint64) ^ tx.mix(place)), at


def points(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, n, d1, d2, own, next, counts) of each document: size and digest of its set, its cells in its own band and in
    the one above if a partner may be there, and its coarse counts."""
    kind = docs.schema[doc_id].dataType.simpleString()
    p, q = least
    first, parts = bands(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tx.passes(batch.column(1)):
                row, found = shingles(batch.column(1).slice(lo, hi - lo), size)
                n = np.bincount(row, minlength=hi - lo)
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                digest = np.zeros((2, hi - lo), np.uint64)
                if len(cuts):
                    for k in range(2):
                        digest[k, row[cuts]] = np.add.reduceat(tx.mix(found ^ _DIGESTS[k]), cuts)
                band = np.searchsorted(first, n, "right") - 1
                above = np.where((n > 0) & (n * q >= first[band + 1] * p), band + 1, -1)
                lists = []
                for b in (band, above):
                    keys, at = cells(row, found, b, parts)
                    lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))))
                coarse = np.bincount(row * COORDS + (found % np.uint64(COORDS)).astype(np.int64), minlength=(hi - lo) * COORDS)
                counts = [x.tobytes() for x in coarse.astype("<u4").reshape(-1, COORDS)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), *lists, pa.array(counts, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "own", "next", "counts"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, own array<long>, next array<long>, counts binary")


class Boxes:
    """A packed R-tree: points split at the median of their widest coordinate, down to leaves; a box has each coordinate's largest value."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        first, last, left, right, order = [], [], [], [], []
        wide = np.column_stack([vectors, sizes])

        def build(own: np.ndarray) -> int:
            """Recursion halves, so it is as deep as a logarithm."""
            here = len(first)
            first.append(len(order)), last.append(0), left.append(-1), right.append(-1)
            spread = wide[own].max(0) - wide[own].min(0)
            if len(own) > LEAF:
                own = own[np.argsort(wide[own, spread.argmax()], kind="stable")]
                left[here] = build(own[: len(own) // 2])
                right[here] = build(own[len(own) // 2 :])
            else:
                order.extend(own.tolist())
            last[here] = len(order)
            return here

        build(np.arange(len(vectors)))
        self.order = np.array(order)
        self.first, self.last, self.left, self.right = (np.array(x) for x in (first, last, left, right))
        self.vectors, self.sizes, self.groups = vectors[self.order], sizes[self.order], groups[self.order]
        spans = list(zip(first, last, strict=True))
        self.high = np.array([self.vectors[a:b].max(0) for a, b in spans])
        self.least = np.array([self.sizes[a:b].min() for a, b in spans])
        self.most = np.array([self.sizes[a:b].max() for a, b in spans])
        low, high = (np.array([f(self.groups[a:b]) for a, b in spans]) for f in (np.min, np.max))
        self.single = np.where(low == high, low, -1 - np.arange(len(spans)))  # the group of all, or a number that no other has


def _may(high_a, high_b, least_a, least_b, most_a, most_b, least: tuple[int, int]) -> np.ndarray:
    """Whether sets under the upper counts and of sizes in the ranges may be linked."""
    p, q = least
    ok = (most_a * q >= least_b * p) & (most_b * q >= least_a * p)
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), AT_ONCE):
        k = at[lo : lo + AT_ONCE]
        ok[k] = np.minimum(high_a(k), high_b(k)).sum(axis=1) * (p + q) >= p * (least_a[k] + least_b[k])
    return ok


def search(a: Boxes, b: Boxes, least: tuple[int, int], tested: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points (by place in what the trees were built of), of different groups, that may be linked; ``a is b`` gives each once.

    ``tested`` gets the number of pairs of points that were bounded one by one.
    """
    same, out = a is b, [np.zeros((2, 0), np.int64)]
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(u):
        go = a.single[u] != b.single[v] if not same else (a.single[u] != b.single[v]) | ((u == v) & (a.single[u] < 0))
        u, v = u[go], v[go]
        go = _may(lambda k, u=u: a.high[u[k]], lambda k, v=v: b.high[v[k]], a.least[u], b.least[v], a.most[u], b.most[v], least)
        u, v = u[go], v[go]
        ends = (a.left[u] < 0) & (b.left[v] < 0)
        leaves = list(zip(u[ends].tolist(), v[ends].tolist(), strict=True))
        for lo in range(0, len(leaves), AT_ONCE // LEAF**2):
            some = leaves[lo : lo + AT_ONCE // LEAF**2]
            x = np.concatenate([np.repeat(np.arange(a.first[i], a.last[i]), b.last[j] - b.first[j]) for i, j in some])
            y = np.concatenate([np.tile(np.arange(b.first[j], b.last[j]), a.last[i] - a.first[i]) for i, j in some])
            go = a.groups[x] != b.groups[y]
            if same:
                go &= x < y
            x, y = x[go], y[go]
            if tested is not None:
                tested.append(len(x))
            go = _may(lambda k, x=x: a.vectors[x[k]], lambda k, y=y: b.vectors[y[k]], a.sizes[x], b.sizes[y], a.sizes[x], b.sizes[y], least)
            out.append(np.stack([a.order[x[go]], b.order[y[go]]]))
        u, v = u[~ends], v[~ends]
        # Of two different boxes the one with more points is opened; a box paired with itself gives three pairs.
        wide = (a.left[u] >= 0) & ((b.left[v] < 0) | (a.last[u] - a.first[u] >= b.last[v] - b.first[v]))
        own = (u == v) & same
        left, right = wide & ~own, ~wide & ~own
        nu = [a.left[u[left]], a.right[u[left]], u[right], u[right], a.left[u[own]], a.left[u[own]], a.right[u[own]]]
        nv = [v[left], v[left], b.left[v[right]], b.right[v[right]], b.left[v[own]], b.right[v[own]], b.right[v[own]]]
        u, v = np.concatenate(nu), np.concatenate(nv)
    return tuple(np.concatenate(out, axis=1))


def candidates(members: DataFrame, *, block: int = BLOCK, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b), a < b: pairs of a cell's points, of different groups, that counts don't rule out.

    ``members`` (key, id, part, group, cell: the cell's number of points, n, head: the point's first cells, counts).
    """
    blocks = F.ceil(c("cell") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, c("mine")).alias("i"), F.greatest(k, c("mine")).alias("j")))
    dealt = members.withColumn("mine", mine).withColumn("pair", F.explode(pairs)).select("key", "pair.i", "pair.j", "mine", "id", "part", "group", "n", "head", "counts")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def of_cell(rows: list[tuple]) -> np.ndarray:
        _, i, j, mine, ids, part, group, n, head, counts = zip(*rows, strict=True)
        vectors = np.frombuffer(b"".join(counts), "<u4").reshape(-1, COORDS).astype(np.int64)
        ids, group, n, mine = np.array(ids), np.array(group), np.array(n), np.array(mine)
        heads = np.zeros((len(ids), HEAD), np.int64)
        known = np.array([len(h) for h in head])
        for k, h in enumerate(head):
            heads[k, : len(h)] = h
        sides = [np.flatnonzero(mine == i[0])]
        if i[0] != j[0]:
            sides.append(np.flatnonzero(mine == j[0]))
        trees = [Boxes(vectors[s], n[s], group[s]) for s in sides if len(s)]
        if len(trees) < len(sides):
            return np.zeros((2, 0), np.int64)
        x, y = search(trees[0], trees[-1], least)
        x, y = sides[0][x], sides[-1][y]
        # In the first of the known parts that both share, or here if they share none of them.
        alike = (heads[x] == heads[y]) & (np.arange(HEAD) < np.minimum(known[x], known[y])[:, None])
        first = np.where(alike.any(1), alike.argmax(1), HEAD)
        go = first == min(part[0], HEAD)
        x, y = ids[x[go]], ids[y[go]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            found = of_cell(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield made()
                held.append(row)
        if held:
            yield made()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, slim: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (d1, id, hashes) have a similarity of ``least`` or more; ``slim`` has d1 of every id."""
    p, q = least
    for k in ("a", "b"):
        pairs = pairs.join(slim.select(c("id").alias(k), c("d1").alias(f"d1_{k}")), k)
    x, y = (sets.select(c("id").alias(f"id_{k}"), c("d1").alias(f"key_{k}"), c("hashes").alias(f"of_{k}")) for k in ("a", "b"))
    pairs = pairs.join(x, (c("d1_a") == c("key_a")) & (c("a") == c("id_a"))).select("a", "b", "d1_b", "of_a")
    pairs = pairs.join(y, (c("d1_b") == c("key_b")) & (c("b") == c("id_b")))
    both, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return pairs.filter(both * F.lit(p + q).cast("long") >= total * F.lit(p).cast("long")).select("a", "b")


def bounded(pairs: DataFrame, slim: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (a, b) that sizes and counts (``slim``: id, n, counts) don't rule out."""
    x, y = (slim.select(c("id").alias(k), c("n").alias(f"n_{k}"), c("counts").alias(f"of_{k}")) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(k).to_numpy() for k in (2, 3)]
            of = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, COORDS).astype(np.int64) for k in (4, 5)]
            go = _may(lambda k, of=of: of[0][k], lambda k, of=of: of[1][k], n[0], n[1], n[0], n[1], least)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], names=["a", "b"]).filter(pa.array(go))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(run, "a long, b long")


#: Bits of the filter of wanted sets, at most; beyond some millions of sets it lets more through, which costs time but no result.
FILTER_BITS = 1 << 24
#: Sets that a task remembers having sent.
SENT = 1 << 20


def whole_sets(docs: DataFrame, wanted: DataFrame, *, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(d1, id, hashes) of ``wanted`` (id, d1, d2), in buckets of d1: made again from the texts, of which only those whose digest
    passes a filter of the wanted ones leave their task, and copies once a task."""
    word = F.shiftrightunsigned("d1", 6) % (FILTER_BITS // 64)
    found = wanted.select(word.alias("w"), F.expr("shiftleft(1L, int(d1 & 63))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    if found:
        words[[r["w"] for r in found]] = np.array([r["bits"] for r in found], np.int64).view(np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(words)  # FILTER_BITS at most, whatever the tables' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for lo, hi in tx.passes(batch.column(0)):
                row, hashed = shingles(batch.column(0).slice(lo, hi - lo), size)
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                if not len(cuts):
                    continue
                digest = [np.add.reduceat(tx.mix(hashed ^ d), cuts) for d in _DIGESTS]
                passed = (held.value[((digest[0] >> np.uint64(6)) % np.uint64(FILTER_BITS // 64)).astype(np.int64)] >> (digest[0] & np.uint64(63))) & np.uint64(1)
                ends = np.append(cuts, len(row))[1:]
                some = []
                for k in np.flatnonzero(passed).tolist():
                    name = hash((int(digest[0][k]), int(digest[1][k])))
                    if name not in sent:
                        some.append(k)
                        if len(sent) < SENT:
                            sent.add(name)
                if some:
                    own = [hashed[cuts[k] : ends[k]].view(np.int64) for k in some]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(d[some].view(np.int64)) for d in digest), lists], names=["d1", "d2", "hashes"])

    sets = docs.select(text).mapInArrow(run, "d1 long, d2 long, hashes array<long>")
    named = wanted.select("id", c("d1").alias("__d1"), c("d2").alias("__d2"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = sets.repartition(buckets, "d1").dropDuplicates(["d1", "d2"]).join(named, (c("d1") == c("__d1")) & (c("d2") == c("__d2"))).select("d1", "id", "hashes")
    return shared.bucketed(whole, "d1", "sets", dealt=True)


def linked(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of ``docs``, classes of equal sets (id, first: the smallest doc_id, n, d1, d2), and links (a, b) between classes.

    The links reach everything that all links reach: those between classes that others connect already may be missing.
    """
    spark = docs.sparkSession
    path = shared.scratch(spark, "points")
    made = points(docs, doc_id=doc_id, text=text, size=size, least=least)
    made.write.parquet(path)
    whole = spark.read.schema(made.schema).parquet(path)
    marked = shared.written(whole.select("doc_id", "n", "d1", "d2"), "marked")
    rest = ["n", "own", "next", "counts"]
    classes = whole.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), *[F.first(x).alias(x) for x in rest])
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    cells_at = shared.scratch(spark, "cells")
    classes.write.parquet(cells_at)
    classes = spark.read.schema(classes.schema).parquet(cells_at)
    shared.remove(spark, path)  # what later steps need of it is in the two tables above

    keyed = classes.select("id", F.size("own").alias("__own"), F.posexplode(F.concat("own", "next")).alias("__at", "key")).select(
        "id", "key", (c("__at") >= c("__own")).alias("up"), F.when(c("__at") < c("__own"), c("__at")).otherwise(c("__at") - c("__own")).alias("part")
    )
    # A class has a cell once, so two rows are two classes.
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select("key")
    members = shared.written(keyed.join(common, "key"), "members")
    heads = [F.slice(x, 1, HEAD).alias(x) for x in ("own", "next")]
    slim = shared.written(classes.select("id", "first", "n", "d1", "d2", *heads, "counts"), "classes")
    shared.remove(spark, cells_at)

    # First each cell's points with the one that stands in the most crowded cells, as the original of many copies does.
    seen = members.filter(c("part") < HEAD).select("key", "id")
    crowd = seen.groupBy("key").agg(F.count(F.lit(1)).alias("__crowd"))
    weight = seen.join(crowd, "key").groupBy("id").agg(F.sum("__crowd").alias("weight"))
    leader = seen.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("__top")).select("key", c("__top.id").alias("leader"))
    star = seen.join(leader, "key").filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    star = shared.written(bounded(star, slim, least), "pairs")
    links = shared.written(verified(star, slim, _sets_of(docs, star, slim, text, size), least), "links")
    labels = cc.components(links)

    grouped = members.join(labels, c("id") == c("node"), "left").select("key", "id", "up", "part", F.coalesce("component", "id").alias("group"))
    open_ = grouped.groupBy("key").agg(F.min("group").alias("__lo"), F.max("group").alias("__hi"), F.count(F.lit(1)).alias("cell")).filter("__lo < __hi")
    left = grouped.join(open_.select("key", "cell"), "key").join(slim.select("id", *rest), "id").select(
        "key", "id", "part", "group", "cell", "n", F.when(c("up"), c("next")).otherwise(c("own")).alias("head"), "counts"
    )
    tried = shared.written(candidates(left, block=block, least=least).join(star, ["a", "b"], "left_anti"), "pairs")
    if not tried.limit(1).count():
        return marked, slim, links
    more = shared.written(verified(tried, slim, _sets_of(docs, tried, slim, text, size), least), "links")
    return marked, slim, links.union(more)


def _sets_of(docs: DataFrame, pairs: DataFrame, slim: DataFrame, text: str, size: int) -> DataFrame:
    named = pairs.select(c("a").alias("id")).union(pairs.select("b")).distinct()
    return whole_sets(docs, slim.join(named, "id", "left_semi"), text=text, size=size)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the size of its set of ``size``-word shingles, and the smallest
    doc_id that links of similarity ``least`` or more reach.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; fewer words than ``size`` are one shingle.
    Null, empty and blank texts have empty sets and are linked with nothing.  Texts may be of any length.  Rows count by
    themselves, whatever their doc_id: equal sets are linked, whether doc_ids repeat or are null; a component whose doc_ids are
    all null has a null id.  An empty table gives no row.  Other columns of ``docs`` may have any name.
    """
    marked, classes, links = linked(docs, doc_id=doc_id, text=text, size=size, least=least, block=block)
    labels = cc.components(links)
    rooted = shared.written(classes.join(labels, c("id") == c("node"), "left").select("d1", "d2", "first", F.coalesce("component", "id").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(c("d1").alias("__d1"), c("d2").alias("__d2"), "component_id")
    found = marked.select("doc_id", "n", "d1", "d2").join(named, (c("d1") == c("__d1")) & (c("d2") == c("__d2")) & (c("n") > 0), "left")
    return found.select("doc_id", c("n").alias("n_shingles"), F.when(c("n") > 0, c("component_id")).otherwise(c("doc_id")).alias("component_id"))
