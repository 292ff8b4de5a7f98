"""Near copies by the share of common shingles: the pipeline's rule, Jaccard similarity 0.8 or more of five-word shingles.

Rows with equal sets of shingles form one class first.  SimHash fingerprints of the same shingles name candidates by covering
tables (``simhash.links``): the close copies.  Few bits differ only then, so bands of MinHash values name the rest: sets with similarity s
share some of b bands of r values with probability 1 - (1 - s**r)**b (at 0.8 all but 3 in a million pairs).  Every candidate
whose MinHash values agree often enough is checked by its whole sets of 64-bit shingle hashes.  A bucket first compares its
members with two leaders, those that stand in the most crowded buckets, as the common original of many copies does; what
these links join needs no further comparison, and all other pairs of the bucket are compared in a second pass; where those are many,
within the bucket itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import shared, simhash
from . import text as tx

SHINGLE = 5
#: Similarity from which two rows are near copies, as a fraction.
LEAST = (4, 5)
BANDS, BAND = 32, 5
#: Members of a bucket that all its others are compared with in the first pass.
LEADERS = 2
#: Pairs for each member from which a bucket counts as crowded with sets that are nearly similar.
CROWDED = 8
#: Of the BANDS * BAND values of two sets, so many agree where their texts are compared: at a similarity of 0.8 the expected
#: 128 lie 5.6 standard deviations above (fewer: one pair in 100 million), at 0.5 the expected 80 lie three below.
AGREE = 100
#: Rows of two whole texts that go to Python at once.
BATCH = 200

_WINDOW = 0xD6E8FEB86659FD93
_SEEDS = tx.mix(np.arange(1, 2 * BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1) | np.uint64(1)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, sorted by both; fewer words than ``size`` are one shingle.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    """
    raw, at = tx.utf8(column)
    raw = tx.LOWER[raw]
    first, end, row = tx.word_spans(raw, at, tx.SPACE)
    words = tx.word_hashes(raw, first, end)
    count = np.bincount(row, minlength=len(column))
    ends = np.cumsum(count)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, size + 1):
        windows = tx.window_hashes(words, n, _WINDOW)
        begin = np.flatnonzero(np.arange(len(windows)) + n <= np.repeat(ends, count)[: len(windows)]) if n == size else (ends - count)[count == n]
        rows.append(row[begin])
        found.append(tx.mix(windows[begin] + np.uint64(n)))
    rows, found = np.concatenate(rows), np.concatenate(found)
    by = np.lexsort((found, rows))
    rows, found = rows[by], found[by]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 0) | (found[1:] != found[:-1])
    return rows[new], found[new]


def signatures(rows: DataFrame) -> DataFrame:
    """(row, doc_id, d1, d2, size, bands, values) of each of ``rows`` (row, doc_id, text): digest and size of its set, a hash a
    band, a byte of each MinHash value (null without a word)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.column(batch, "text")
            for lo, hi in tx.passes(column):
                row, found = shingles(column.slice(lo, hi - lo))
                digest = np.zeros((2, hi - lo), np.uint64)
                cuts = np.flatnonzero(np.diff(row, prepend=-1))
                full = row[cuts]
                bands, values = np.zeros((len(full), BANDS), np.uint64), np.zeros((len(full), BANDS * BAND), np.uint8)
                if len(full):
                    for k in range(2):
                        digest[k, full] = np.add.reduceat(tx.mix(found ^ _SEEDS[k, 0]), cuts)
                    for b in range(BANDS):
                        key = np.full(len(full), b + 1, np.uint64)
                        for k in range(b * BAND, (b + 1) * BAND):
                            least = np.minimum.reduceat((found ^ _SEEDS[0, k]) * _SEEDS[1, k], cuts)
                            values[:, k] = tx.mix(least).astype(np.uint8)
                            key = tx.mix(key * np.uint64(31) + least)
                        bands[:, b] = key
                sizes = np.zeros(hi - lo, np.int64)
                sizes[full] = BANDS
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
                part = [tx.column(batch, c).slice(lo, hi - lo) for c in ("row", "doc_id")]
                total = pa.array(np.bincount(row, minlength=hi - lo))
                known: list[bytes | None] = [None] * (hi - lo)
                for k, v in zip(full.tolist(), values, strict=True):
                    known[k] = v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*part, *(pa.array(d.view(np.int64)) for d in digest), total, lists, pa.array(known, pa.binary())],
                    names=["row", "doc_id", "d1", "d2", "size", "bands", "values"],
                )

    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, d1 long, d2 long, size long, bands array<long>, values binary")


def _crossing(members: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``members`` (sorted by group) that lie in different groups."""
    cuts = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    for k, rest in zip(range(len(members)), np.repeat(cuts, np.diff(cuts, prepend=0)).tolist(), strict=True):
        if rest < len(members):
            yield np.full(len(members) - rest, members[k]), members[rest:]


def pairs(buckets: DataFrame, *, leaders: int = 0) -> DataFrame:
    """(a, b), a < b: distinct pairs of a bucket's members whose ``group`` differs, all of them or those with a leader.

    ``buckets`` (key, row, group, size, weight, values).  The leaders are the members of most weight of the ``leaders`` groups
    of most.  Pairs whose sizes alone rule the similarity out are left out, and those whose values agree too seldom.  A bucket
    with more than CROWDED pairs for each member is named instead of its pairs: (its key, null).
    """
    above, under = LEAST

    def of_bucket(row: np.ndarray, group: np.ndarray, weight: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not leaders:
            by = np.argsort(group, kind="stable")
            yield from _crossing(by, group[by])
            return
        by = np.lexsort((row, -weight))
        heads = by[np.sort(np.unique(group[by], return_index=True)[1])[:leaders]]
        for head in heads.tolist():
            other = np.flatnonzero(group != group[head])
            yield np.full(len(other), head), other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*[np.zeros(0, np.int64)] * 5, np.zeros((0, BANDS * BAND), np.uint8)]
        out, size, crowds = [], 0, []

        def made() -> pa.RecordBatch:
            x, y = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in out)]) for k in (0, 1))
            cols = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
            more = [pa.array(crowds, pa.int64()), pa.nulls(len(crowds), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(cols, more, strict=True)], names=["a", "b"])

        for batch in _and_end(batches):
            last = batch is None
            if not last:
                values = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * BAND)
                held = [*(np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held[:5])), np.concatenate([held[5], values])]
            key = held[0]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            # The last bucket may go on in the next batch.
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            for lo, hi in spans if last else spans[:-1]:
                if hi - lo > 1:
                    before, own = len(out), 0
                    for x, y in of_bucket(held[1][lo:hi], held[2][lo:hi], held[4][lo:hi], held[5][lo:hi]):
                        sizes = held[3][lo + x], held[3][lo + y]
                        ok = np.flatnonzero(np.minimum(*sizes) * under >= np.maximum(*sizes) * above)
                        ok = ok[(held[5][lo + x[ok]] == held[5][lo + y[ok]]).sum(axis=1) >= AGREE]
                        out.append((held[1][lo + x[ok]], held[1][lo + y[ok]]))
                        own += len(ok)
                        if not leaders and own > CROWDED * (hi - lo):
                            out = out[:before]
                            crowds.append(int(key[lo]))
                            break
                    size += own + 1
                    if size >= 1 << 16:
                        yield made()
                        out, size, crowds = [], 0, []
            if spans:
                held = [h[spans[-1][0] :] for h in held]
        if out or crowds:
            yield made()

    dealt = buckets.select("key", "row", "group", "size", "weight", "values").repartition("key").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def similar(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of ``candidates`` (a, b) whose sets of shingles have a similarity of LEAST or more, written; ``texts`` (row, text)."""
    above, under = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [np.zeros(0, bool)]
            for lo, hi in tx.passes(batch.column(2)):
                one = batch.slice(lo, hi - lo)
                for start, end in tx.passes(one.column(3)):
                    sides = [shingles(one.column(k).slice(start, end - start)) for k in (2, 3)]
                    row, found = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
                    by = np.lexsort((found, row))
                    row, found = row[by], found[by]
                    both = row[1:][(np.diff(row) == 0) & (found[1:] == found[:-1])]
                    common = np.bincount(both, minlength=end - start)
                    total = np.bincount(row, minlength=end - start) - common
                    ok.append(common * under >= total * above)
            mask = pa.array(np.concatenate(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    found = candidates.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    conf, name = candidates.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH))
    try:
        return shared.written(found, "near")
    finally:
        conf.set(name, before)


def linked(crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of members of different groups of a crowded bucket whose sets are similar, written.

    ``crowded`` (key, row, group, size, weight, values).  Whole sets of shingle hashes come to the bucket, once for each
    member, and only pairs that are similar leave it.
    """
    above, under = LEAST

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tx.passes(batch.column(1)):
                row, found = shingles(batch.column(1).slice(lo, hi - lo))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                own = [found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], names=["row", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            union = np.unique(np.concatenate([h for *_, h in held])) if held else np.zeros(0, np.uint64)
            place = [np.searchsorted(union, h) for *_, h in held]
            group = np.array([g for _, g, _, _ in held])
            values = np.stack([v for _, _, v, _ in held]) if held else np.zeros((0, BANDS * BAND), np.uint8)
            size, inside = np.array([len(p) for p in place]), np.zeros(len(union), bool)
            for k in range(len(held) - 1):
                rest = k + 1 + np.flatnonzero(group[k + 1 :] != group[k])
                rest = rest[np.minimum(size[rest], size[k]) * under >= np.maximum(size[rest], size[k]) * above]
                rest = rest[(values[rest] == values[k]).sum(axis=1) >= AGREE]
                inside[place[k]] = True
                for j in rest.tolist():
                    common = int(inside[place[j]].sum())
                    if common * under >= (size[k] + size[j] - common) * above:
                        found.append((min(held[k][0], held[j][0]), max(held[k][0], held[j][0])))
                inside[place[k]] = False
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for k, row, group, values, hashes in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if k != key:
                    yield links()
                    key, held = k, []
                held.append((row, group, np.frombuffer(values, np.uint8), np.frombuffer(hashes, np.uint64)))
        yield links()

    members = shared.written(crowded.select("key", "row", "group", "values"), "crowded")
    whole = texts.select("row", "text").join(members.select("row").distinct(), "row", "left_semi").mapInArrow(sets, "row long, hashes binary")
    tasks = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(whole, "row").select("key", "row", "group", "values", "hashes").repartition(tasks, "key").sortWithinPartitions("key", "row")
    return shared.written(dealt.mapInArrow(compare, "a long, b long").distinct(), "near")


def fingerprinted(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: rows of ``texts`` (row, text) linked by SimHash fingerprints of their shingles, of RADIUS differing bits at most.

    Equal fingerprints hang on the smallest row; between unlike ones the links are those of ``simhash.links``, one a pair of classes.
    """
    marked = shared.written(simhash.fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), shingle=SHINGLE), "fingerprints")
    classes = shared.written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("row")), "fingerprint-classes")
    equal = marked.join(classes, "fingerprint").filter("row < doc_id").select(F.col("row").alias("x"), F.col("doc_id").alias("y"))
    side = lambda name, row: classes.select(F.col("fingerprint").alias(name), F.col("row").alias(row))
    near = simhash.links(classes.select(F.col("fingerprint").alias("value"))).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return equal.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near copies: that with the smallest doc_id.

    Groups are reached over pairs of near copies.  Rows count by themselves, whatever their doc_id: of rows with equal
    doc_id, or none, one of the group stays too (null goes last).  Rows without a word are copies of one another.
    """
    # Written: a row must keep its number whenever it is read.
    rows = shared.bucketed(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", "rows")
    texts = rows.select(F.col("__row").alias("row"), "doc_id", "text")
    marked = shared.written(signatures(texts), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = shared.written(marked.groupBy("d1", "d2").agg(first).select("first", F.col("first.row").alias("row")), "classes")
    buckets = marked.join(classes.select("row"), "row", "left_semi").select("row", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = shared.written(buckets.join(several, "key"), "crowds")
    weight = buckets.groupBy("row").agg(F.sum("n").alias("weight"))
    members = shared.written(marked.join(weight, "row").select("row", "size", "weight", "values"), "members")
    buckets = shared.written(buckets.select("key", "row").join(members, "row"), "buckets")
    close = fingerprinted(texts.join(classes.select("row"), "row", "left_semi"))
    tested = shared.written(pairs(buckets.withColumn("group", F.col("row")), leaders=LEADERS).union(close).distinct(), "pairs")
    edges = similar(tested, texts)
    labels = cc.components(edges)
    grouped = buckets.join(labels, buckets.row == labels.node, "left").select("key", "row", "size", "weight", "values", F.coalesce("component", "row").alias("group"))
    rest = shared.written(pairs(grouped), "pairs")
    more = similar(rest.filter("b is not null").join(tested, ["a", "b"], "left_anti"), texts)
    crowds = rest.filter("b is null").select(F.col("a").alias("key"))
    if crowds.limit(1).count():
        more = more.union(linked(grouped.join(crowds, "key", "left_semi"), texts))
    if more.limit(1).count():
        labels = cc.components(edges.union(more))
    rooted = classes.join(labels, classes.row == labels.node, "left").select("first", F.coalesce("component", "row").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(shared.written(kept, "kept"), "__row", "left_semi").select(*docs.columns)
