"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint bits get vectors of r+1 bits, dealt in turn.  For each non-zero vector v, table v hashes a fingerprint by the
bits whose vector has an odd product with v.  Any r differing bits leave some v that is even with all of them, so two
fingerprints within the radius r share a key in some of the 2**(r+1)-1 tables: no pair is missed.  Equal fingerprints form
one class before any table is made; inside a bucket only a spanning forest of the links is kept.  A bucket too large for
one task is hashed again with vectors dealt anew: its members agree on the first key, so their differing bits lie in the
rest, which the new tables cover alike; each level fixes about half of what is left, so parts soon are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import shared
from . import text as tx

RADIUS = 4
SHINGLE = 4
#: Members of a bucket that one task compares; larger buckets are split by further tables.
BUCKET = 4096


def masks(radius: int = RADIUS, bits: int = 64, level: int = 0) -> list[int]:
    """A mask per table: of the bits whose vector has an odd inner product with the table's; each level deals anew."""
    places = np.random.RandomState(level).permutation(bits).tolist() if level else range(bits)
    vectors = [(k % (2 ** (radius + 1) - 1)) + 1 for k in places]
    return [sum(1 << k for k in range(bits) if bin(vectors[k] & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fingerprint: signed 64-bit) of each row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; shingles of fewer than ``shingle`` words are
    the whole sequence.  A null text, or one without words, has the fingerprint 0.
    """
    carried = ["doc_id", *(keep or [])]
    source = docs.select(*carried, "text")
    fields = [source.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fingerprint long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            column = tx.column(batch, "text")
            out = [np.zeros(0, np.uint64)]
            for lo, hi in tx.passes(column):
                raw, at = tx.utf8(column.slice(lo, hi - lo))
                raw = tx.LOWER[raw]
                first, end, row = tx.word_spans(raw, at, tx.SPACE)
                count = np.bincount(row, minlength=hi - lo)
                # The words again, one space after each: a shingle is then one slice.
                size = end - first
                place = np.zeros(len(first) + 1, np.int64)
                np.cumsum(size + 1, out=place[1:])
                joined = np.full(place[-1], 0x20, np.uint8)
                joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = raw[~tx.SPACE[raw]]
                data = joined.tobytes()
                ends_at = np.cumsum(count)
                begin = np.arange(len(first))
                last = begin + shingle
                row_end = np.repeat(ends_at, count)
                whole = (count < shingle) & (count > 0)
                ok = last <= row_end
                begin, last = begin[ok], last[ok]
                short = ends_at[whole] - count[whole]
                rows = np.concatenate([row[ok], np.flatnonzero(whole)])
                s = np.concatenate([place[begin], place[short]]).tolist()
                e = np.concatenate([place[last] - 1, place[ends_at[whole]] - 1]).tolist()
                hashes = np.fromiter((digest(data[x:y], 42) for x, y in zip(s, e, strict=True)), np.uint64, len(s))
                order = np.argsort(rows, kind="stable")
                hashes, rows = hashes[order], rows[order]
                made = np.zeros(hi - lo, np.uint64)
                ones = np.zeros((hi - lo, 64), np.int64)
                for k in range(0, len(hashes), 1 << 16):
                    bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    part = rows[k : k + (1 << 16)]
                    cut = np.flatnonzero(np.diff(part, prepend=-1))
                    ones[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
                total = np.bincount(rows, minlength=hi - lo)
                set_bits = ones * 2 > total[:, None]
                made = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
                out.append(made)
            columns = [tx.column(batch, c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out).view(np.int64))], names=[*carried, "fingerprint"])

    return source.mapInArrow(run, schema)


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints within the radius, thinned to a spanning forest of their components."""
    n = len(values)
    root = np.arange(n)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b = [], []
    step = max(1, (1 << 20) // n)
    for lo in range(0, n, step):
        near = np.bitwise_count(values[lo : lo + step, None] ^ values[None, :]) <= radius
        near &= np.arange(n)[None, :] > np.arange(lo, min(n, lo + step))[:, None]
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = find(lo + int(x)), find(int(y))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(lo + int(x))
                b.append(int(y))
    return values[a], values[b]


def _keys(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Each row's table and key at the next level; ``path`` holds what it was hashed to before."""
    table = F.array(*[F.struct(F.lit(k).cast("int").alias("v"), F.col("value").bitwiseAND(F.lit(m if m < 2**63 else m - 2**64)).alias("key")) for k, m in enumerate(masks(radius, level=level))])
    exploded = rows.select("path", "value", F.explode(table).alias("t"))
    return exploded.select(F.xxhash64("path", "t.v", "t.key").alias("path"), "value", F.col("t.v").alias("v"), F.col("t.key").alias("key"))


def links(values: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` of one another; ``values`` (value: long).

    Within every bucket the edges form a spanning forest of its links, so components come out as from all pairs.
    """
    spark = values.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        path_left, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            value = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(path):
                continue
            cut = np.flatnonzero(np.diff(path)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]])
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            # Only the first group can go on from the last batch, and only the last may go on in the next.
            if path[0] == path_left:
                held = np.concatenate([held, value[: ends[0]]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if len(held) > 1:
                    x, y = _forest(held, radius)
                    a.append(x)
                    b.append(y)
                several = np.flatnonzero(ends[:-1] - starts[:-1] > 1)
                for k in several:
                    x, y = _forest(value[starts[k] : ends[k]], radius)
                    a.append(x)
                    b.append(y)
                held = value[starts[-1] :]
            path_left = path[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema)
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _forest(held, radius)], schema=schema)

    rows = values.select(F.lit(0).cast("long").alias("path"), "value")
    found, level = [], 0
    while True:
        keyed = _keys(rows, radius, level).select("path", "value")
        sizes = keyed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
        large = shared.written(sizes.select("path"), "large")
        none = large.limit(1).count() == 0
        small = keyed if none else keyed.join(large, "path", "left_anti")
        found.append(small.repartition("path").sortWithinPartitions("path", "value").mapInArrow(compare, "a long, b long"))
        if none:
            break
        rows = shared.written(keyed.join(large, "path", "left_semi"), "split")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the row's own included.
    Rows with a null doc_id get a fingerprint but take no part in links unless others share theirs, and never name a
    component; rows with equal doc_id are rows of their own.
    """
    marked = shared.written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle=shingle), "fingerprints")
    classes = shared.written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    edges = links(classes.select(F.col("fingerprint").alias("value")), radius=radius, bucket=bucket)
    # Nodes are fingerprints; a class that has no link is its own component and takes no part in the rounds.
    joined = cc.components(edges)
    named = (
        classes.join(joined, classes.fingerprint == joined.node, "left")
        .select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root"))
    )
    named = shared.written(named, "named")
    least = shared.written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    by_class = shared.written(named.join(least, "root").select("fingerprint", "component_id"), "by-class")
    return marked.join(by_class, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
