"""Exact top-k search by inner product: queries and data in cover trees, searched together.

Every task builds cover trees over the vectors it holds (a node's children cover it at half its radius, and lie more than
that apart; where many dimensions leave children of a few vectors each, such neighbours share a leaf, with a covering
radius of its own).  Blocks of queries, in trees of their own, meet each data tree in a depth-first search over pairs of nodes: a
pair is dropped when its bound, from the centres' product and both covering radii, is below the worst k-th score of the
query node.  Each task returns its k best per query; the best of those are the answer.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K, EVERY, SCALE = 5, 50, 256
#: Vectors of a data tree, of a query block, and of a leaf.
SHARD, QUERY_BLOCK, LEAF = 50_000, 5_000, 512


class Node:
    """Rows ``start`` to ``end`` of a tree's ordered vectors, all within ``radius`` of ``centre``."""

    __slots__ = ("centre", "children", "end", "norm", "radius", "start", "worst")

    def __init__(self, centre: np.ndarray, radius: float, start: int, end: int, children: list):
        self.centre, self.radius, self.start, self.end, self.children = centre, radius, start, end, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf


class CoverTree:
    """A cover tree of vectors (n, d) with ids; rows of a leaf are in the order of ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids = vectors, ids
        order: list[np.ndarray] = []
        self.leaf, self.at = leaf, 0
        self.root = self._build(np.arange(len(vectors)), vectors[0], order)
        own = np.concatenate(order)
        self.vectors, self.ids = vectors[own], ids[own]

    def _leaf(self, own: np.ndarray, centre: np.ndarray, order: list) -> Node:
        gap = self.vectors[own] - centre
        radius = float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max()))
        order.append(own[np.argsort(self.ids[own], kind="stable")])
        self.at += len(own)
        return Node(centre, radius, self.at - len(own), self.at, [])

    def _build(self, own: np.ndarray, centre: np.ndarray, order: list) -> Node:
        gap = self.vectors[own] - centre
        distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        radius = float(distance.max())
        if len(own) <= self.leaf or radius == 0:
            return self._leaf(own, centre, order)
        # Children: centres more than half the radius apart, each point with the first centre that covers it.
        start, half, children, few = self.at, radius / 2, [], []
        left = own[np.argsort(distance, kind="stable")]
        while len(left):
            first = self.vectors[left[0]]
            gap = self.vectors[left] - first
            near = np.einsum("ij,ij->i", gap, gap) <= half * half
            near[0] = True
            if near.sum() * 4 < self.leaf:
                few.append(left[near])
                if len(few) * self.leaf > 16 * len(own):  # the rest is no denser: no more covers by single points
                    few += [left[~near]]
                    break
            else:
                children.append(self._build(left[near], first, order))
            left = left[~near]
        rest = np.concatenate(few) if few else own[:0]
        if len(rest):
            # Small covers share leaves: ordered along the direction in which they spread most.
            part = self.vectors[rest] - self.vectors[rest].mean(axis=0)
            axis = part[np.einsum("ij,ij->i", part, part).argmax()]
            rest = rest[np.argsort(part @ axis, kind="stable")]
            for lo in range(0, len(rest), self.leaf):
                block = rest[lo : lo + self.leaf]
                children.append(self._leaf(block, self.vectors[block].mean(axis=0), order))
        return Node(centre, radius, start, self.at, children)


def _search(queries: CoverTree, data: CoverTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and ids of each query row (in the query tree's order); ids of -1 fill up."""
    q_ids, d_ids, n = queries.ids, data.ids, len(queries.ids)
    best = np.full((n, k), -np.inf)
    found = np.full((n, k), np.iinfo(np.int64).max)

    def base(q: Node, r: Node) -> None:
        # Equal vectors score alike: of a leaf of them the smallest ids, a query's own aside, are enough.
        end = min(r.end, r.start + k + 1) if r.radius == 0 and len(np.unique(d_ids[r.start : r.start + k + 1])) > k else r.end
        score = queries.vectors[q.start : q.end] @ data.vectors[r.start : end].T
        ids = d_ids[r.start : end]
        score[q_ids[q.start : q.end, None] == ids[None, :]] = -np.inf
        edge = best[q.start : q.end, -1]
        if score.shape[1] > k:  # ties at the k-th score are settled by id, so all that reach it stay
            edge = np.maximum(edge, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
        row, col = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
        if not len(row):
            return
        count = np.bincount(row)
        rows = np.flatnonzero(count)
        count = count[rows]
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + k
        at = np.repeat(np.arange(len(rows)), count)
        s = np.full((len(rows), k + int(count.max())), -np.inf)
        i = np.full(s.shape, np.iinfo(np.int64).max)
        s[:, :k], i[:, :k] = best[q.start + rows], found[q.start + rows]
        s[at, place], i[at, place] = score[row, col], ids[col]
        order = np.lexsort((i, -s), axis=1)[:, :k]
        best[q.start + rows], found[q.start + rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def bound(q: Node, rs: list[Node]) -> np.ndarray:
        centres = np.array([r.centre for r in rs])
        radius, norm = np.array([r.radius for r in rs]), np.array([r.norm for r in rs])
        top = centres @ q.centre + q.radius * (norm + radius) + radius * q.norm
        return top + 1e-6 * np.abs(top) + 1e-6

    def worst(q: Node) -> float:
        # Scores only rise, so a bound taken earlier stays valid; leaves are read afresh.
        q.worst = float(best[q.start : q.end, -1].min()) if not q.children else min(c.worst for c in q.children)
        return q.worst

    stack: list[tuple[Node, Node, float]] = [(queries.root, data.root, np.inf)]
    while stack:
        q, r, top = stack.pop()
        if top < worst(q):
            continue
        if not q.children and not r.children:
            base(q, r)
            worst(q)
            continue
        if q.children and (not r.children or q.radius >= r.radius):
            pairs = [(c, r, float(bound(c, [r])[0])) for c in q.children]
        else:
            tops = bound(q, r.children)
            pairs = [(q, c, float(t)) for c, t in zip(r.children, tops, strict=True)]
        pairs.sort(key=lambda p: p[2])  # the most promising is popped first
        stack += pairs
    return best, found


def _matrix(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows with usable vectors and their floor(scale * x), by length."""
    lengths = column.value_lengths()
    sizes = lengths.fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    valid = flat.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.nan_to_num(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan)
    ends = np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        block = numbers[(ends[rows] - size)[:, None] + np.arange(size)]
        ok = np.isfinite(block).all(axis=1) & valid[(ends[rows] - size)[:, None] + np.arange(size)].all(axis=1)
        out[size] = (rows[ok], np.floor(scale * block[ok]))
    return out


def write_queries(queries: DataFrame, *, scale: int = SCALE, block: int = QUERY_BLOCK) -> list[str]:
    """Files of query blocks (vec_id, vectors of one length); the driver sees only their names."""
    folder = shared.scratch(queries.sparkSession, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            names = []
            for rows, vectors in _matrix(batch.column(1), scale).values():
                for lo in range(0, len(rows), block):
                    out = io.BytesIO()
                    np.savez(out, ids=ids[rows[lo : lo + block]].astype(np.int64), vectors=vectors[lo : lo + block])
                    names.append(f"{folder}/{uuid.uuid4().hex}.npz")
                    shared.write_bytes(names[-1], out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    n = queries.count()
    dealt = queries.select("vec_id", "embedding").coalesce(max(1, -(-n // block)))
    return sorted(r["file"] for r in dealt.mapInArrow(write, "file string").collect())


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``,
    the k rows of other ids with the highest inner products of floor(scale * x), ties to the smaller vec_id.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null vec_id;
    vectors of different lengths have no product.  Rows that repeat a vec_id are candidates of their own; a query id that
    repeats is asked once for each distinct result it yields.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
    files = write_queries(rows.filter(F.col("vec_id") % every == 0), scale=scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def answer(size: int) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held[size]])
            data = np.concatenate([v for _, v in held[size]])
            held[size] = []
            tree = CoverTree(data, ids)
            for file in files:
                block = np.load(io.BytesIO(shared.read_bytes(file)))
                if block["vectors"].shape[1] != size:
                    continue
                asked = CoverTree(block["vectors"], block["ids"])
                q_ids = asked.ids
                best, found = _search(asked, tree, k)
                ok = best > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, k)[ok.ravel()]), pa.array(found[ok]), pa.array(best[ok].astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for size, (own, block) in _matrix(batch.column(1), scale).items():
                if len(own):
                    held.setdefault(size, []).append((ids[own], block))
                    if sum(len(i) for i, _ in held[size]) >= shard:
                        yield from answer(size)
        for size in list(held):
            if held[size]:
                yield from answer(size)

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
