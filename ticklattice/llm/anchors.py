"""Vector codes by parts: codebooks fitted with metric trees of the anchors hierarchy.

Vectors are cut into parts, and each part position has a codebook, fitted by rounds of assigning every part to its nearest
entry.  A task packs its vectors into shards and grows one tree a part position, middle out: anchors far from each other take
the points nearest to them, balls above are merged from anchors and balls below come from anchors of anchors.  A ball caches
the sum and the number of its points.  A pass over a tree hands each ball the entries that its parent left over and drops
those farther than the nearest by more than the ball's width; a ball with one entry left belongs to it wholly, and only its
cache is read.  Trees are grown once, written beside their points, and read again by every round.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Vectors of a shard, whose trees one task grows at a time, and points below which a ball is not divided.
SHARD, LEAF = 8192, 24
#: Largest integer component: squares of differences, summed over a part, stay within 64 bits.
LARGEST = 1 << 28
#: A ball is wholly owned only beyond what rounding of doubles could hide.
SLACK = 1e-9


class Tree(NamedTuple):
    """Balls of points[order[first:last]]; children are places of balls, or -1."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _anchored(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor (0, 1, ...) of each point: each new anchor is the point farthest from its own one, and takes what it is nearer to.

    A point within half the distance between its anchor and the new one cannot be nearer to that, and is not looked at.
    """
    own = np.zeros(len(points), np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(1).astype(float))
    pivots = [points[0]]
    while len(pivots) < most:
        at = int(far.argmax())
        if far[at] == 0:
            break
        between = np.sqrt(((np.array(pivots) - points[at]) ** 2).sum(1).astype(float))
        open_ = np.flatnonzero(far > between[own] / 2)
        near = np.sqrt(((points[open_] - points[at]) ** 2).sum(1).astype(float))
        won = near < far[open_]
        own[open_[won]], far[open_[won]] = len(pivots), near[won]
        far[at] = 0
        pivots.append(points[at])
    return np.unique(own, return_inverse=True)[1]


def grow(points: np.ndarray) -> Tree:
    """The tree of integer ``points`` (n, width), n > 0; equal points share a ball."""
    nodes: list[list[int]] = []  # first, last, left, right
    order: list[np.ndarray] = []
    placed = 0

    def leaf(idx: np.ndarray) -> int:
        nonlocal placed
        order.append(idx)
        nodes.append([placed, placed + len(idx), -1, -1])
        placed += len(idx)
        return len(nodes) - 1

    def branch(idx: np.ndarray) -> int:
        here = points[idx]
        if len(idx) <= LEAF or (here == here[0]).all():
            return leaf(idx)
        own = _anchored(here, max(2, math.isqrt(len(idx))))
        by = np.argsort(own, kind="stable")
        groups = np.split(idx[by], np.flatnonzero(np.diff(own[by])) + 1)
        return merged(groups)

    def merged(groups: list[np.ndarray]) -> int:
        """Balls of the groups, joined two by two where the ball of both is smallest; a pair's points end up side by side."""
        count = np.array([len(g) for g in groups], float)
        center = np.array([points[g].mean(0) for g in groups])
        radius = np.array([np.sqrt(((points[g] - m) ** 2).sum(1).max()) for g, m in zip(groups, center, strict=True)])
        plan: list = list(groups)
        size = (np.sqrt(((center[:, None] - center) ** 2).sum(2)) + radius[:, None] + radius) / 2
        np.fill_diagonal(size, np.inf)
        for _ in range(len(groups) - 1):
            i, j = divmod(int(size.argmin()), len(groups))
            plan[i] = (plan[i], plan[j])
            center[i] = (center[i] * count[i] + center[j] * count[j]) / (count[i] + count[j])
            radius[i] = max(radius[i], radius[j], size[i, j])
            count[i] += count[j]
            alive = np.isfinite(size[i]) | np.isfinite(size[j])
            alive[[i, j]] = False
            size[i] = np.where(alive, (np.sqrt(((center - center[i]) ** 2).sum(1)) + radius + radius[i]) / 2, np.inf)
            size[:, i] = size[i]
            size[j] = size[:, j] = np.inf
        # Merged pairs may form a chain as deep as there are anchors, so this walks without recursion.
        top = next(p for p, n in zip(plan, count, strict=True) if n == sum(map(len, groups)))
        done: list[int] = []
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                b, a = done.pop(), done.pop()
                nodes.append([min(nodes[a][0], nodes[b][0]), max(nodes[a][1], nodes[b][1]), a, b])
                done.append(len(nodes) - 1)
            elif isinstance(x, tuple):
                todo += [None, x[1], x[0]]
            else:
                done.append(branch(x))
        return done[0]

    root = branch(np.arange(len(points)))
    first, last, left, right = np.array(nodes, np.int64).reshape(-1, 4)[:, :4].T
    at = np.concatenate(order)
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[at], 0)])
    total = sums[last] - sums[first]
    center = total / (last - first)[:, None]
    radius = np.array([np.sqrt(((points[at[a:b]] - m) ** 2).sum(1).max()) for a, b, m in zip(first, last, center, strict=True)])
    assert root == len(first) - 1
    return Tree(at, first, last, left, right, center, radius, total)


def assign(tree: Tree, points: np.ndarray, book: np.ndarray, *, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, float]:
    """Number and sum of the points nearest to each entry of ``book`` (ties: the lower index), each point's entry if ``each``,
    and the share of points that were settled by caches alone."""
    unique, lowest = np.unique(book, axis=0, return_index=True)
    entries = np.sort(lowest)  # of equal entries all but the first never win
    unique = book[entries]
    count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    code = np.zeros(len(points), np.int64) if each else None
    nodes, open_ = np.array([len(tree.first) - 1]), np.ones((1, len(entries)), bool)
    cached = 0
    while len(nodes):
        far = np.sqrt(((tree.center[nodes][:, None] - unique) ** 2).sum(2))
        far[~open_] = np.inf
        best = far.min(1)
        reach = best + 2 * tree.radius[nodes]
        open_ = far <= (reach + SLACK * (1 + reach))[:, None]
        owned = open_.sum(1) == 1
        for node, entry in zip(nodes[owned], entries[open_[owned].argmax(1)], strict=True):
            size = int(tree.last[node] - tree.first[node])
            count[entry] += size
            sums[entry] += tree.total[node]
            cached += size
            if code is not None:
                code[tree.order[tree.first[node] : tree.last[node]]] = entry
        rest, open_ = nodes[~owned], open_[~owned]
        ends = tree.left[rest] < 0
        if ends.any():
            sizes = (tree.last - tree.first)[rest[ends]]
            at = np.repeat(tree.first[rest[ends]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            where = tree.order[at]
            square = ((points[where][:, None] - unique) ** 2).sum(2)
            square[~np.repeat(open_[ends], sizes, axis=0)] = np.iinfo(np.int64).max
            won = entries[square.argmin(1)]
            count += np.bincount(won, minlength=len(book))
            np.add.at(sums, won, points[where])
            if code is not None:
                code[where] = won
        nodes = np.concatenate([tree.left[rest[~ends]], tree.right[rest[~ends]]])
        open_ = np.concatenate([open_[~ends], open_[~ends]])
    return count, sums, code, cached / len(points)


def _packed(ids: list, labels: list, vectors: np.ndarray, parts: int) -> bytes:
    points = vectors.reshape(len(ids), parts, -1)
    held = {"points": vectors.astype(np.int32), "ids": np.array([x or 0 for x in ids], np.int64), "no_id": np.array([x is None for x in ids])}
    held |= {"labels": np.array([x or 0 for x in labels], np.int64), "no_label": np.array([x is None for x in labels])}
    for p in range(parts):
        held |= {f"{p}.{k}": v for k, v in grow(points[:, p])._asdict().items()}
    out = io.BytesIO()
    np.savez(out, **held)
    return out.getvalue()


def shards(vectors: DataFrame, width: int, parts: int, *, size: int = SHARD) -> DataFrame:
    """(shard: binary) of ``vectors`` (vec_id, label, v: array<long> of at most parts * width): points, trees, ids and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_packed(ids, labels, np.array(rows), parts)], pa.binary())], names=["shard"])
            ids.clear(), labels.clear(), rows.clear()
            return out

        for batch in batches:
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if max(v, default=0) > LARGEST or min(v, default=0) < -LARGEST:
                    raise ValueError(f"vec_id {i}: a component is too large for exact distances")
                row = np.zeros(parts * width, np.int64)
                row[: len(v)] = v
                ids.append(i), labels.append(label), rows.append(row)
                if len(ids) == size:
                    yield flush()
        if ids:
            yield flush()

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "shard binary")


def _opened(data: bytes, parts: int) -> tuple[dict, np.ndarray, list[Tree]]:
    held = dict(np.load(io.BytesIO(data)))
    points = held["points"].astype(np.int64).reshape(len(held["ids"]), parts, -1)
    return held, points, [Tree(*(held[f"{p}.{k}"] for k in Tree._fields)) for p in range(parts)]


def _sums(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """Number and component sums (parts, entries, 1 + width) of the parts nearest to each entry: one small row a task, entry and component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for data in batch.column(0):
                _, points, trees = _opened(data.as_py(), parts)
                for p in range(parts):
                    count, sums, *_ = assign(trees[p], points[:, p], books[p], each=False)
                    found[p, :, 0] += count
                    found[p, :, 1:] += sums
        at = np.flatnonzero(found.any(axis=2).repeat(1 + width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], names=["at", "s"])

    total = np.zeros(parts * entries * (1 + width), np.int64)
    # As many rows as the codebooks have numbers, whatever the table's size.
    for at, s in packed.mapInArrow(run, "at long, s long").groupBy("at").agg(F.sum("s")).collect():
        total[at] = s
    return total.reshape(parts, entries, 1 + width)


def kept(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is not null and holds only finite components, each as floor(256 * x)."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * 256))
    return vectors.filter(good).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), ints.alias("v"))


def fit(vectors: DataFrame, packed: DataFrame, *, width: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, width): from the vectors with the smallest ids, through ``rounds`` of assigning and averaging."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # a codebook's worth of rows
    seeds = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(seeds, first, strict=True):
        row[: len(r["v"])] = r["v"]
    books = seeds.reshape(len(first), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds):
        found = _sums(packed, books)
        used = found[:, :, 0] > 0
        books[used] = found[used][:, 1:] // found[used][:, :1]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64,
             rounds: int = 2, shard: int = SHARD) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, (vec_id, label, code, error), and the codebooks (parts, entries, width).

    Components become floor(256 * x).  Null vectors and those with null or non-finite components are left out; so is an empty
    table (no rows, empty codebooks).  Vectors shorter than the longest, or than a multiple of ``parts``, count as filled up
    with zeros, an empty one as zeros alone.  Rows that repeat an id are coded each; among the first ids they come in the
    order of their components, a null id last.  Ties go to the lower entry, and an entry that nothing is nearest to stays.
    Components beyond 2**28 after scaling are refused.  Other columns of ``vectors`` may have any name.
    """
    rows = kept(vectors, key=key, vector=vector, label=label)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    spark = vectors.sparkSession
    path = shared.scratch(spark, "anchors")
    # One column that is never equal or compressed: a task's share of the files is about what it holds at once.
    shards(rows, width, parts, size=shard).write.option("compression", "none").parquet(path)
    packed = spark.read.schema("shard binary").parquet(path)
    books = fit(rows, packed, width=width, parts=parts, entries=entries, rounds=rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, points, trees = _opened(data.as_py(), parts)
                codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
                for p in range(parts):
                    code = assign(trees[p], points[:, p], books[p], each=True)[2]
                    codes[:, p] = code
                    error += ((points[:, p] - books[p][code]) ** 2).sum(1)
                text = codes.tobytes().hex()
                hexes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held["ids"], mask=held["no_id"]), pa.array(held["labels"], mask=held["no_label"]), pa.array(hexes), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return packed.mapInArrow(run, "vec_id long, label long, code string, error long"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels (nulls are one label): summed per task first, then joined back."""
    sums = coded.groupBy(F.col("label").alias("__of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__of"))).drop("__of")
