"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded piece of the documents.  Its words that some benchmark window holds are coded; runs of other words
become one separator, for no window crosses them.  The coded text gets a suffix array, its Burrows-Wheeler transform is
kept as a wavelet matrix (ranks by prefix counts of bits), and every ``RATE``-th suffix position is kept.  All windows are
searched backward at once, a step per word; occurrences are located by walking to a kept position.  Spans of occurrences
merge into the words to remove.

The benchmark is cut into blocks of bounded size, written once to the shared folder; each shard takes them in turn, so
neither side is ever held whole by the driver or by one task.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as tx

WINDOW = 10
#: Words of benchmark text in a block, about.
BLOCK_WORDS = 500_000
#: Suffix positions kept: one in so many.
RATE = 8


class FMIndex:
    """Self-index of a sequence of codes; code 0 separates.  Codes are held one higher, above a last symbol of its own."""

    def __init__(self, codes: np.ndarray, rate: int = RATE):
        text = np.concatenate([codes.astype(np.int64) + 1, [0]])
        n = len(text)
        self.n = n
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.size = int(text.max()) + 1
        self.before = np.zeros(self.size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.size), out=self.before[1:])
        self.levels = max(1, int(self.size - 1).bit_length())
        self.zeros, self.ranks, self.bits = [], [], []
        symbols = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ranks[1:])
            self.ranks.append(ranks)
            self.bits.append(bit.astype(bool))
            self.zeros.append(n - int(ranks[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.kept = order % rate == 0
        self.kept_rank = np.zeros(n + 1, np.int32)
        np.cumsum(self.kept, out=self.kept_rank[1:])
        self.position = order[self.kept].astype(np.int64)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            rank = new
            step *= 2
            if rank[order[-1]] == n - 1 or step >= n:
                return order

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``code`` in the first ``at`` symbols of the transform."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((code >> level) & 1).astype(bool)
            a, b = self.ranks[k][lo], self.ranks[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """Symbols of the transform at ``at``."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = self.bits[k][at]
            out = out * 2 + one
            r = self.ranks[k][at]
            at = np.where(one, self.zeros[k] + r, at - r)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each phrase (a row of codes); all phrases step backward together."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for k in range(phrases.shape[1] - 1, -1, -1):
            code = phrases[live, k] + 1
            known = (code > 1) & (code < self.size)
            hi[live[~known]] = lo[live[~known]]
            live, code = live[known], code[known]
            lo[live] = self.before[code] + self.rank(code, lo[live])
            hi[live] = self.before[code] + self.rank(code, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a kept one."""
        at, steps, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.kept[at[live]]
            done = live[here]
            out[done] = (self.position[self.kept_rank[at[done]]] + steps[done]) % self.n
            live = live[~here]
            code = self.symbol(at[live])
            at[live] = self.before[code] + self.rank(code, at[live])
            steps[live] += 1
        return out


class Block:
    """Windows of a block of benchmark items: distinct rows of word codes, by length, and the items of each.

    A word is known by two independent hashes of its bytes (``hashes`` has two rows), 128 bits in all.
    """

    def __init__(self, ids: list, hashes: list[np.ndarray], window: int):
        both = np.concatenate(hashes, axis=1) if hashes else np.zeros((2, 0), np.uint64)
        words, at = np.unique(both[0], return_index=True)
        self.words, self.checks = words, both[1][at]  # the code of words[k] is k + 1
        self.sets: list[tuple[np.ndarray, list[list]]] = []
        by_length: dict[int, list[tuple[np.ndarray, object]]] = {}
        for item, h in zip(ids, hashes, strict=True):
            if not h.shape[1]:
                continue
            code = np.searchsorted(words, h[0]) + 1
            width = min(window, len(code))
            rows = np.lib.stride_tricks.sliding_window_view(code, width)
            by_length.setdefault(width, []).append((rows, item))
        self.shortest = min(by_length, default=window)
        for width, found in sorted(by_length.items()):
            rows = np.concatenate([r for r, _ in found])
            owner = np.concatenate([np.full(len(r), k) for k, (r, _) in enumerate(found)])
            distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), owner]), axis=1)
            cut = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
            items = [[found[o][1] for o in pairs[1][cut[k] : cut[k + 1]]] for k in range(len(distinct))]
            self.sets.append((distinct, items))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words, 0 for those that no window holds."""
        if not len(self.words):
            return np.zeros(hashes.shape[1], np.int64)
        at = np.searchsorted(self.words, hashes[0])
        at[at == len(self.words)] = 0
        return np.where((self.words[at] == hashes[0]) & (self.checks[at] == hashes[1]), at + 1, 0)


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of each word, its row, first byte and end."""
    raw, at = tx.utf8(array)
    raw = tx.LOWER[raw]
    first, end, row = tx.word_spans(raw, at, tx.NOT_ALNUM)
    return np.stack([tx.word_hashes(raw, first, end, seed) for seed in (0, 1)]), row, first, end


def write_blocks(benchmark: DataFrame, *, block_words: int = BLOCK_WORDS) -> list[str]:
    """Files of the benchmark's blocks, as word hashes; the driver sees only their names."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    letters = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, round(letters / 6 / block_words))
    folder = shared.scratch(spark, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sizes = [], [], []
        for batch in batches:
            found, row, _, _ = _words(batch.column(1))
            size = np.bincount(row, minlength=len(batch))
            ids += batch.column(0).to_pylist()
            hashes.append(found)
            sizes.append(size)
        if ids:
            out = io.BytesIO()
            np.savez(out, hashes=np.concatenate(hashes, axis=1), sizes=np.concatenate(sizes), known=np.array([i is not None for i in ids]),
                     ids=np.array(["" if i is None else str(i) for i in ids]))
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            shared.write_bytes(name, out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    dealt = rows.repartition(blocks, F.xxhash64("item_id", "text"))
    return sorted(r["file"] for r in dealt.mapInArrow(write, "file string").collect())


def _block(file: str, window: int) -> Block:
    def make() -> Block:
        held = np.load(io.BytesIO(shared.read_bytes(file)))
        at = np.concatenate([[0], np.cumsum(held["sizes"])])
        hashes = [held["hashes"][:, at[k] : at[k + 1]] for k in range(len(at) - 1)]
        ids = [i if k else None for i, k in zip(held["ids"].tolist(), held["known"].tolist(), strict=True)]
        return Block(ids, hashes, window)

    return shared.kept(("benchmark", file, window), make, most=2)


def _hits(hashes: np.ndarray, row: np.ndarray, block: Block, hit: np.ndarray, items: dict[int, set]) -> None:
    """Mark the words of a shard that windows of the block cover, and note the items found in each row."""
    code = block.codes(hashes)
    n = len(code)
    # Runs of coded words within a row; those shorter than every window hold none.
    edge = np.flatnonzero(np.diff(row)) + 1
    starts = (code > 0) & np.concatenate([[True], code[:-1] == 0]) if n else np.zeros(0, bool)
    starts[edge] |= code[edge] > 0
    ends = (code > 0) & np.concatenate([code[1:] == 0, [True]]) if n else np.zeros(0, bool)
    ends[edge - 1] |= code[edge - 1] > 0
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = b - a >= block.shortest
    a, b = a[long], b[long]
    if not len(a):
        return
    size = b - a
    at = np.cumsum(size + 1) - (size + 1)
    origin = np.full(int((size + 1).sum()), -1, np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    origin[np.repeat(at, size) + inside] = np.repeat(a, size) + inside
    coded = np.where(origin >= 0, code[origin], 0)
    index = FMIndex(coded)
    cover = np.zeros(n + 1, np.int64)
    for phrases, owners in block.sets:
        lo, hi = index.search(phrases)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        count = hi[found] - lo[found]
        rows = np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = origin[index.locate(rows)]
        phrase = np.repeat(found, count)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + phrases.shape[1], -1)
        pairs = np.unique(np.stack([row[place], phrase]), axis=1)
        for r, p in pairs.T.tolist():
            items.setdefault(r, set()).update(owners[p])
    hit |= np.cumsum(cover[:-1]) > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, keep: list[str] | None = None,
                  with_text: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each row of ``docs`` (doc_id, text) shares with ``benchmark`` (item_id, text).

    Adds n_words, n_hit (words inside any occurrence of a window of ``window`` consecutive item words; an item of fewer
    words is one window), items (ids of items with occurring windows, as sorted strings), contaminated, and, if asked for,
    kept_text: the text with hit words, and the separators after them, removed.  Words are runs of 0-9, a-z (A-Z lower-cased)
    and characters beyond ASCII.  Null texts have no words; items with a null id mark words but aren't listed; doc_id may
    be null or repeat; an empty benchmark hits nothing.  ``keep`` names further columns to carry.
    """
    carried = ["doc_id", *(keep or [])]
    source = docs.select(*carried, *([] if "text" in carried else ["text"]))
    fields = [source.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", n_words long, n_hit long, items array<string>, contaminated boolean" + ", kept_text string" * with_text
    blocks = write_blocks(benchmark, block_words=block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*carried, "n_words", "n_hit", "items", "contaminated", *["kept_text"] * with_text]
        with shared.working():
            for batch in batches:
                whole = tx.column(batch, "text")
                for lo, hi in tx.passes(whole):
                    column = whole.slice(lo, hi - lo)
                    hashes, row, first, end = _words(column)
                    hit, items = np.zeros(hashes.shape[1], bool), {}
                    for file in blocks:
                        _hits(hashes, row, _block(file, window), hit, items)
                    n_words = np.bincount(row, minlength=hi - lo)
                    n_hit = np.bincount(row[hit], minlength=hi - lo)
                    listed = [sorted(x for x in items.get(k, ()) if x is not None) for k in range(hi - lo)]
                    cols = [tx.column(batch, c).slice(lo, hi - lo) for c in carried]
                    cols += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(n_hit > 0)]
                    if with_text:
                        cols.append(_kept(column, row, first, end, hit))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(run, schema)


def _kept(column: pa.Array, row: np.ndarray, first: np.ndarray, end: np.ndarray, hit: np.ndarray) -> pa.Array:
    """Texts without the merged spans of hit words, each span with the separators up to the next word."""
    raw, at = tx.utf8(column)
    texts = column.to_pylist()
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for r in np.unique(row[hit]).tolist():
        a, b = bounds[r], bounds[r + 1]
        data, start = raw[at[r] : at[r + 1]], at[r]
        drop = np.zeros(len(data) + 1, np.int64)
        begins = first[a:b] - start
        following = np.concatenate([begins[1:], [len(data)]])
        own = hit[a:b]
        np.add.at(drop, begins[own], 1)
        np.add.at(drop, following[own], -1)
        texts[r] = data[np.cumsum(drop[:-1]) == 0].tobytes().decode("utf-8", "replace")
    return pa.array(texts, pa.string())


def items_sha256(column: str = "items") -> object:
    """Digest of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(column, ",").cast("binary"), 256)


__all__ = ["Block", "FMIndex", "decontaminate", "items_sha256", "write_blocks"]
