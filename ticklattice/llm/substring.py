"""Substring deduplication with a log-structured index of window fingerprints.

The index is a folder of sorted, immutable runs, bucketed by their key, and a manifest that names them.  A new batch of
documents is merge-joined with every run of what came before it; its own fingerprints become a run; ``fan_in`` runs are
compacted into one.  The folder can be opened again later, and only what it holds (and, for windows that repeat for the first
time, the old texts) is asked when the next batch comes: nothing is known beforehand about batches to come.

Two kinds of fingerprints keep the runs small.  Every window names the hash of one of its inner shingles, the least, as its
anchor, so equal windows have equal anchors and neighbouring windows mostly share theirs (a stretch).  Anchor runs hold each
anchor with its first and last document.  Window runs hold window hashes, but only of anchors that more than one document
has: those of a new batch, and those of the first old document with an anchor that repeats now, hashed from its text.  A
stretch gets one hash; where stretches of an anchor differ, each of its windows gets one too.

A match needs two hashes: one of hashes of words, and a BLAKE2 digest of the words' own bytes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from . import text as tx

WINDOW = 50
ANCHOR = 16
BATCHES = 3
FAN_IN = 2
#: Bits of a filter: between these powers of two, 16 for each member.  A member sets three in a block of 512.
LEAST_BITS, MOST_BITS = 20, 28
#: Fingerprints that a task holds before it passes them on.
HELD = 500_000
_WINDOW, _ANCHOR, _STRETCH = 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0xA0761D6478BD642F
SEGMENTS = 64


class _Windows:
    """Words, windows and stretches of windows of some texts."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        raw, at = tx.utf8(column)
        self.first, self.end, self.row = tx.word_spans(raw, at, tx.SPACE)
        self.raw, self.window = raw, window
        hashes = tx.word_hashes(raw, self.first, self.end)
        n = len(hashes)
        self.place = np.arange(n) - np.searchsorted(self.row, self.row, "left") if n else np.zeros(0, np.int64)
        self.start, self.anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.new, self.size, self.stretch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < window:
            return
        least = tx.sliding_min(tx.window_hashes(hashes, anchor, _ANCHOR), window - anchor + 1)
        self.start = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :])
        # Least hashes crowd at the low end; scrambled ones are even again.
        self.anchor = tx.mix(least[self.start])
        self.hashes = tx.window_hashes(hashes, window, _WINDOW)
        if not len(self.start):
            return
        # Maximal stretches of consecutive windows with one anchor, cut where they are longer than a window.
        start, least = self.start, self.anchor
        cut = np.concatenate([[True], (least[1:] != least[:-1]) | (self.row[start[1:]] != self.row[start[:-1]])])
        new = np.flatnonzero(cut)
        since = np.arange(len(start)) - new[np.cumsum(cut) - 1]
        self.new = np.flatnonzero(since % window == 0)
        self.size = np.diff(np.append(self.new, len(start)))
        a, b = start[self.new], start[self.new + self.size - 1]
        # The first and the last window cover all words of a stretch.
        self.stretch = tx.mix(tx.mix(self.hashes[a] ^ np.uint64(_STRETCH)) + tx.mix(self.hashes[b]) * np.uint64(_STRETCH) + self.size.astype(np.uint64))

    def digests(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64 bits of the BLAKE2 digest of the words (joined by one space) of ``size`` windows from each ``start``."""
        span = self.end - self.first
        at = np.zeros(len(span) + 1, np.int64)
        np.cumsum(span + 1, out=at[1:])
        joined = np.full(at[-1], 0x20, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[at[1:] - 1] = False
        joined[inside] = self.raw[~tx.SPACE[self.raw]]
        data, low, high = memoryview(joined.tobytes()), at[start].tolist(), (at[start + size + self.window - 1] - 1).tolist()
        blake = hashlib.blake2b
        return np.frombuffer(b"".join([blake(data[a:b], digest_size=8).digest() for a, b in zip(low, high, strict=True)]), np.int64)


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, least, most, low, high): first and last document of each anchor, and smallest and largest hash of its
    stretches.  Repeats within a pass, then within a task, meet before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in tx.passes(batch.column(1)):
                w = _Windows(batch.column(1).slice(lo, hi - lo), window, anchor)
                if not len(w.new):
                    continue
                value, doc = w.anchor[w.new], ids[lo + w.row[w.start[w.new]]].astype(np.int64)
                order = np.argsort(value, kind="stable")
                value, doc, stretch = value[order], doc[order], w.stretch[order].view(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                ends = [f.reduceat(x, cut) for x in (doc, stretch) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array(value[cut].view(np.int64)), *map(pa.array, ends)], names=["anchor", "least", "most", "low", "high"])

    found = docs.select("doc_id", "text").mapInArrow(run, "anchor long, least long, most long, low long, high long")
    return found.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three bits of each member (a hash) in a filter."""
    block = (values >> np.uint64(64 - (bits - 9))).astype(np.int64) << 9
    return [block + ((values >> np.uint64(shift)) & np.uint64(511)).astype(np.int64) for shift in (0, 9, 18)]


class Filter:
    """A Bloom filter of bounded size in files of the shared folder.  A full one only lets more through."""

    def __init__(self, members: DataFrame):
        """``members``: one column of hashes."""
        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, (16 * members.count()).bit_length()))
        self.folder = folder = shared.scratch(members.sparkSession, "filter")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            size = (1 << bits) // SEGMENTS
            for batch in batches:
                for bit in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                    for segment in np.unique(bit // size).tolist():
                        own = held.setdefault(segment, np.zeros(size, bool))
                        own[bit[bit // size == segment] % size] = True
            names = []
            for segment, own in held.items():
                names.append(f"{folder}/{segment:03d}-{uuid.uuid4().hex}")
                shared.write_bytes(names[-1], np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

        # Each segment is one task's; a task gets a few segments of a bounded size, whatever the number of members.
        member = members.select(F.col(members.columns[0]).alias("m"))
        dealt = member.repartition(SEGMENTS, F.shiftrightunsigned("m", 58))
        self.files = sorted(r["file"] for r in dealt.mapInArrow(write, "file string").collect())

    def holds(self, values: np.ndarray) -> np.ndarray:
        bitmap, out = _load(tuple(self.files), self.bits), np.ones(len(values), bool)
        for bit in _places(values, self.bits):
            out &= ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def _load(files: tuple[str, ...], bits: int) -> np.ndarray:
    def make() -> np.ndarray:
        size = (1 << bits) // SEGMENTS // 8
        whole = np.zeros((1 << bits) // 8, np.uint8)
        for name in files:
            segment = int(name.rpartition("/")[2][:3])
            whole[segment * size : (segment + 1) * size] |= np.frombuffer(shared.read_bytes(name), np.uint8)
        return whole

    return shared.kept(("filter", bits, files), make, most=3)


#: A fingerprint: two hashes of ``n`` consecutive windows of a document and the place of the first (with the number of the
#: row's copy in the upper half).  ``known`` ones are lost to an earlier document of their task and need no comparison.
PRINT = "h1 long, h2 long, doc_id long, place long, n int, known boolean"


def _combined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a task: those of each distinct one's first document, and runs that its later documents lose."""
    h1, h2, doc, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, h2, h1))
    new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    own = np.empty(len(order), bool)
    own[order] = doc[order] == doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    names = [x.split()[0] for x in PRINT.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(h1[own].view(np.int64)), pa.array(h2[own]), pa.array(doc[own]), pa.array(place[own]), pa.array(n[own].astype(np.int32)), pa.array(np.zeros(own.sum(), bool))],
        names=names,
    )
    if own.all():
        return
    doc, place, n = doc[~own], place[~own], n[~own]
    order = np.lexsort((place, doc))
    doc, place, n = doc[order], place[order], n[order]
    # Windows that follow one another become one run.
    far = np.maximum.accumulate(place + n + (np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 48))
    near = place + (np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 48)
    new = np.flatnonzero(np.concatenate([[True], near[1:] > far[:-1]]))
    size = far[np.append(new[1:], len(far)) - 1] - near[new]
    nothing = pa.nulls(len(new), pa.int64())
    # Their first hash only spreads them over the tasks.
    yield pa.RecordBatch.from_arrays(
        [pa.array(tx.mix(doc[new].view(np.uint64)).view(np.int64)), nothing, pa.array(doc[new]), pa.array(place[new]), pa.array(size.astype(np.int32)), pa.array(np.ones(len(new), bool))],
        names=names,
    )


def _prints(docs: DataFrame, repeated: Filter, mixed: Filter, window: int, anchor: int, only: Filter | None = None) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, copy, text) whose anchors are in ``repeated``; ``only`` is of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.working():
            yield from judge(batches)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if only is not None:
                hashes = [xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), 42) for x in batch.column(0).to_pylist()]
                batch = batch.filter(pa.array(only.holds(np.array(hashes, np.uint64))))
            ids, copies = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in tx.passes(batch.column(2)):
                w = _Windows(batch.column(2).slice(lo, hi - lo), window, anchor)
                own = repeated.holds(w.anchor[w.new]) if len(w.new) else np.zeros(0, bool)
                if not own.any():
                    continue
                new, size = w.new[own], w.size[own]
                found = [(w.start[new], size, w.stretch[own])]
                # Single windows stand beside their stretch, so what another batch held for one stretch is still met.
                apart = mixed.holds(w.anchor[new])
                if apart.any():
                    new, size = new[apart], size[apart]
                    at = np.repeat(new, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    found.append((w.start[at], np.ones(len(at), np.int64), w.hashes[w.start[at]]))
                for at, n, h1 in found:
                    of = lo + w.row[at]
                    place = (copies[of].astype(np.int64) << 32) + w.place[at]
                    parts.append((h1, w.digests(at, n), ids[of].astype(np.int64), place, n))
                    held += len(at)
                if held >= HELD:
                    yield from _combined(parts)
                    parts, held = [], 0
        if parts:
            yield from _combined(parts)

    return docs.select("doc_id", "copy", "text").mapInArrow(run, PRINT)


class FingerprintIndex:
    """The index in ``folder``: a new one, or the one that is there already.

    ``window``, ``anchor`` and the number of buckets are those it was begun with.  Documents come in batches whose doc_ids
    are larger than all before.
    """

    COLUMNS = {"anchor": ("anchor", "least", "most", "low", "high"), "window": ("h1", "h2", "doc_id")}

    def __init__(self, spark: SparkSession, folder: str | None = None, *, window: int = WINDOW, anchor: int = ANCHOR, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.folder = folder or shared.scratch(spark, "fingerprints")
        self.names: dict[str, str] = {}
        held = self._manifest()
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.state = held or {"number": 0, "window": window, "anchor": anchor, "buckets": buckets, "last": None, "anchors": [], "windows": []}
        self.window, self.anchor, self.buckets = self.state["window"], self.state["anchor"], self.state["buckets"]

    def _manifest(self) -> dict | None:
        files, path = shared.filesystem(f"{self.folder}/manifest")
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(x.base_name for x in found if x.base_name.endswith(".json"))
        return json.loads(shared.read_bytes(f"{self.folder}/manifest/{names[-1]}")) if names else None

    def _commit(self, **changes: object) -> None:
        """A new manifest; the state before it stays readable until then."""
        self.state = self.state | changes | {"number": self.state["number"] + 1}
        shared.write_bytes(f"{self.folder}/manifest/{self.state['number']:08d}.json", json.dumps(self.state).encode())

    def _write(self, rows: DataFrame, kind: str) -> str:
        """A run: a bucketed and sorted table whose files lie in the index's folder.  Rows come dealt by its key."""
        path, key = f"{self.folder}/{kind}-{uuid.uuid4().hex}", self.COLUMNS[kind][0]
        table = "ticklattice_" + uuid.uuid4().hex
        out = rows.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).format("parquet")
        (out.partitionBy("is_new") if "is_new" in rows.columns else out).saveAsTable(table)
        self.spark.sql(f"drop table {table}")  # the files stay
        return path

    def _run(self, path: str, kind: str) -> DataFrame:
        """A run as a bucketed table; one that this session doesn't know yet gets a name."""
        if path not in self.names:
            self.names[path] = table = "ticklattice_" + uuid.uuid4().hex
            columns, key = ", ".join(f"{c} bigint" for c in self.COLUMNS[kind]), self.COLUMNS[kind][0]
            self.spark.sql(f"create table {table} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{path}'")
        return self.spark.table(self.names[path])

    def forget_names(self) -> None:
        """Drop the tables' names; the files stay, also for reads that are planned on them."""
        for table in self.names.values():
            self.spark.sql(f"drop table if exists {table}")
        self.names = {}

    def _hot(self, own: DataFrame) -> tuple[DataFrame, str]:
        """Writes the batch's anchors as a run; returns those that repeat, within the batch or with what came before.

        fetch: the old document whose windows of the anchor are not in the index, but are needed now.
        """
        run = self._write(own, "anchor")
        state = self._run(run, "anchor")
        before = None
        for k, old in enumerate(self.state["anchors"]):
            old = self._run(old, "anchor").select(F.col("anchor").alias(f"a{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("least", "most", "low", "high")])
            state = state.join(old, F.col("anchor") == F.col(f"a{k}"), "left")
            one = {c: F.col(f"{c}{k}") for c in ("least", "most", "low", "high")}
            before = one if before is None else {c: (F.least if c in ("least", "low") else F.greatest)(before[c], one[c]) for c in one}
        own = {c: F.col(c) for c in ("least", "most", "low", "high")}
        if before is None:
            least, most, low, high, fetch = own["least"], own["most"], own["low"], own["high"], F.lit(None).cast("long")
        else:
            least, most = F.least(own["least"], before["least"]), F.greatest(own["most"], before["most"])
            low, high = F.least(own["low"], before["low"]), F.greatest(own["high"], before["high"])
            was_hot, was_mixed = before["least"] < before["most"], before["low"] < before["high"]
            fetch = F.when(~was_hot | (~was_mixed & (low < high)), before["least"])
        hot = state.filter(least < most).select("anchor", (low < high).alias("mixed"), fetch.alias("fetch"))
        return shared.written(hot, "hot"), run

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Judge a batch (doc_id, copy, text; no null doc_id) and index it; returns (doc_id, place, n): runs of repeated windows.

        ``history`` gives the texts of the documents added before, in the same columns.  Of those, only documents that hold
        an anchor which now repeats for the first time are hashed again.  A run is ``n`` windows from a place (the number of
        the first word; the copy number in the upper half).  An empty batch adds nothing; raises ValueError on doc_ids that
        aren't larger than all before.
        """
        for kind in ("anchor", "window"):
            if len(self.state[f"{kind}s"]) >= self.fan_in:
                self._compact(kind)
        hot, anchors = self._hot(_anchors(batch, self.window, self.anchor))
        ids = self._run(anchors, "anchor").agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
        last = self.state["last"]
        if ids["least"] is not None and last is not None and ids["least"] <= last:
            raise ValueError(f"document {ids['least']} comes after document {last}")
        repeated, mixed = Filter(hot.select("anchor")), Filter(hot.filter("mixed").select("anchor"))
        prints = _prints(batch, repeated, mixed, self.window, self.anchor)
        fetch = hot.filter("fetch is not null")
        if self.state["anchors"] and fetch.limit(1).count():
            if history is None:
                raise ValueError("windows of earlier documents repeat for the first time; their texts are needed")
            owners = Filter(fetch.select(F.xxhash64("fetch")))
            prints = prints.union(_prints(history, Filter(fetch.select("anchor")), mixed, self.window, self.anchor, owners))
        dealt = prints.repartition(self.buckets, "h1")
        before = F.lit(None).cast("long")
        for k, run in enumerate(self.state["windows"]):
            old = self._run(run, "window").select(*[F.col(c).alias(f"{c}_{k}") for c in ("h1", "h2", "doc_id")])
            # The merge joins on the first hash; the digest verifies.
            same = (F.col("h1") == F.col(f"h1_{k}")) & (F.col("h2").bitwiseXOR(F.col(f"h2_{k}")) == 0)
            dealt = dealt.join(old, same, "left")
            before = F.least(before, F.col(f"doc_id_{k}"))  # nulls count for nothing
        order = Window.partitionBy("h1", "h2").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.least(before, F.first("doc_id").over(order))
        known, number = F.col("known"), F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "place"))
        ours = F.lit(True) if last is None else F.col("doc_id") > last
        judged = dealt.select("h1", "h2", "doc_id", "place", "n", (ours & (known | (F.col("doc_id") > first))).alias("lost"),
                              (~known & before.isNull() & (number == 1)).alias("is_new")).filter("lost or is_new")
        new = F.col("is_new")
        rows = judged.select(F.when(new, F.col("h1")).alias("h1"), F.when(new, F.col("h2")).alias("h2"), "doc_id",
                             F.when(~new, F.col("place")).alias("place"), F.when(~new, F.col("n")).alias("n"), "is_new")
        run = self._write(rows, "window")
        self._commit(
            anchors=[*self.state["anchors"], anchors], windows=[*self.state["windows"], f"{run}/is_new=true"],
            last=last if ids["most"] is None else ids["most"],
        )
        self._mkdir(f"{run}/is_new=true")
        self._mkdir(f"{run}/is_new=false")
        return self.spark.read.schema("doc_id long, place long, n int").parquet(f"{run}/is_new=false")

    @staticmethod
    def _mkdir(uri: str) -> None:
        files, path = shared.filesystem(uri)
        files.create_dir(path, recursive=True)

    def _compact(self, kind: str) -> None:
        """Merge the runs of a kind into one, two at a time (sorted buckets meet without a shuffle), and delete them."""
        names = self.COLUMNS[kind]
        while len(self.state[f"{kind}s"]) > 1:
            runs = self.state[f"{kind}s"]
            a, b = (self._run(run, kind).select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for side, run in zip("ab", runs[:2], strict=True))
            same = F.col(f"a_{names[0]}") == F.col(f"b_{names[0]}")
            if kind == "window":
                same &= F.col("a_h2").bitwiseXOR(F.col("b_h2")) == 0
                ends = {"h1": F.coalesce, "h2": F.coalesce, "doc_id": F.least}
            else:
                ends = {"anchor": F.coalesce, "least": F.least, "low": F.least, "most": F.greatest, "high": F.greatest}
            both = a.join(b, same, "full").select(*[f(f"a_{c}", f"b_{c}").alias(c) for c, f in ends.items()])
            merged = self._write(both.select(*names), kind)
            self._commit(**{f"{kind}s": [merged, *runs[2:]]})
            for old in runs[:2]:
                shared.remove(self.spark, old)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text): the copy number tells rows of equal doc_id apart; it is 0 where there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        return docs.select("doc_id", F.lit(0).alias("copy"), "text")
    order = Window.partitionBy("doc_id", F.expr("if(doc_id is null, xxhash64(text), 0)")).orderBy(F.xxhash64("text"))
    return shared.written(docs.select("doc_id", (F.row_number().over(order) - 1).alias("copy"), "text"), "numbered")


def deduplicate(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES,
                fan_in: int = FAN_IN, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text), added to an index in ``batches``.

    Words are runs of characters other than ASCII white space.  A word is removed if a window of ``window`` words covers it
    whose words also start in a row with a smaller doc_id.  Rows with a null doc_id lose nothing and cost others nothing;
    rows with equal doc_id don't count against each other; null texts have no words, and those of fewer words than a window
    (empty ones too) lose nothing; long texts are taken whole.  kept_sha256 is of the kept words joined by one space;
    ``with_text`` adds them as kept_text.  An empty table gives an empty one; further columns of ``docs`` are left out.
    """
    rows = numbered(docs)
    index, lost = FingerprintIndex(docs.sparkSession, window=window, anchor=anchor, fan_in=fan_in), []
    edges = rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(x) for x in edges})
    known = rows.filter(F.col("doc_id").isNotNull())
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = known if low is None else known.filter(F.col("doc_id") > low)
        part = part if high is None else part.filter(F.col("doc_id") <= high)
        lost.append(index.add(part, None if low is None else known.filter(F.col("doc_id") <= low)))
    repeated = lost[0]
    for more in lost[1:]:
        repeated = repeated.union(more)
    index.forget_names()
    return cut(rows, repeated, window=window, with_text=with_text)


def cut(rows: DataFrame, repeated: DataFrame, *, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``rows`` (doc_id, copy, text; see ``numbered``) without the words of ``repeated`` windows, as ``deduplicate`` returns them."""
    run = F.shiftleft(F.col("place").bitwiseAND(0xFFFFFFFF), 32) + F.col("n")
    starts = repeated.groupBy(F.col("doc_id").alias("of_id"), F.shiftright("place", 32).cast("int").alias("of_copy")).agg(F.collect_list(run).alias("runs"))
    joined = rows.join(starts, (rows.doc_id == starts.of_id) & (rows.copy == starts.of_copy), "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tx.passes(batch.column(1)):
                raw, at = tx.utf8(batch.column(1).slice(lo, hi - lo))
                first, end, row = tx.word_spans(raw, at, tx.SPACE)
                n = np.bincount(row, minlength=hi - lo)
                begin = np.cumsum(n) - n
                cover = np.zeros(len(first) + 1, np.int64)
                lists = batch.column(2).slice(lo, hi - lo)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if len(flat):
                    from_word = np.repeat(begin, sizes) + (flat >> 32)
                    np.add.at(cover, from_word, 1)
                    np.add.at(cover, from_word + (flat & 0xFFFFFFFF) + window - 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                gone = np.bincount(row[~keep], minlength=hi - lo)
                first, end, row = first[keep], end[keep], row[keep]
                size = end - first
                place = np.zeros(len(first) + 1, np.int64)
                np.cumsum(size + 1, out=place[1:])
                joined = np.full(place[-1], 0x20, np.uint8)
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                joined[np.repeat(place[:-1], size) + offset] = raw[np.repeat(first, size) + offset]
                data = joined.tobytes()
                edge = place[np.searchsorted(row, np.arange(hi - lo + 1))].tolist()
                kept = [data[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if with_text:
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return joined.mapInArrow(run, schema)
