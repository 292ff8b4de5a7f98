"""Encoding and decoding with merge-type SentencePiece vocabularies.

Each chunk of text keeps an agenda of its adjacent symbol pairs, ordered by the score of the piece they would form (the
leftmost first among equals); the best pair merges, its new neighbours join the agenda, and stale entries are skipped.
Long chunks have a heap for an agenda (``merge``); short ones, nearly all, go many at once, each with a row of a matrix for
its agenda, from which every round takes the best (``merge_many``).
Pieces of such vocabularies hold the space mark only at their start, so a text falls into chunks (a run of space marks and
what follows it) that never merge with one another.  Chunks repeat, so each task keeps the ids of recent ones; every new
chunk of an Arrow batch is checked against the sentencepiece library before its ids are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import shared
from . import text as tx
from .chunkmemory import LONGEST, ChunkMemory

MARK = "▁"
#: Chunks that a worker remembers, about; then it begins anew.
REMEMBERED = 1_000_000
#: Place in the order of scores of a pair that forms no piece.
NONE = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for k in range(lib.get_piece_size()):
            piece = lib.id_to_piece(k)
            if lib.is_byte(k):
                self.byte[int(piece[3:-1], 16)] = k
            elif not (lib.is_control(k) or lib.is_unknown(k) or lib.is_unused(k)):
                self.score[piece], self.id[piece] = lib.get_score(k), k
        self.unknown = lib.unk_id()
        #: Chunks hold only where no piece has the mark after another character.
        self.chunked = not any(MARK in p.lstrip(MARK) for p in self.id)
        #: Texts are taken as they are where the model's normaliser changes nothing but the space mark.
        self.plain = all(lib.decode(lib.encode(x)) == x for x in ("  ﬁ x  ", " a  b ", "a\tb\n", "Ⅷ e\u0301"))
        self.memory = ChunkMemory(REMEMBERED)
        digits = [f"{k},".encode() for k in range(lib.get_piece_size())]
        self.numerals = np.array(digits).view(np.uint8).reshape(len(digits), -1)
        self._pairs()

    def _pairs(self) -> None:
        """Symbols (pieces and characters of pieces) and an open-addressed table of the pairs that form a piece."""
        symbols = dict(self.id)
        for piece in self.id:
            for char in piece:
                symbols.setdefault(char, self.library.get_piece_size() + len(symbols))
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = k
        order = {x: k for k, x in enumerate(sorted({-v for v in self.score.values()}))}
        found = [
            (symbols[p[:k]] << 32 | symbols[p[k:]], order[-self.score[p]], self.id[p])
            for p in self.id for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        ]
        self.bits = max(4, (4 * len(found)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        for key, rank, made in found:
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.rank[at], self.made[at] = key, rank, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores, and piece, of each pair; NONE where the pair forms no piece."""
        key = (left.astype(np.int64) << 32) | right
        rank, made = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[at])
        while len(at):
            held = self.key[slot]
            same = held == key[at]
            rank[at[same]], made[at[same]] = self.rank[slot[same]], self.made[slot[same]]
            more = ~same & (held >= 0)
            at, slot = at[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def merge_many(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks: their agendas are rows of a matrix, and every chunk merges its best pair in each round."""
        out: list[bytes] = [b""] * len(chunks)
        size = np.array([len(c) for c in chunks])
        for low, width in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, LONGEST)):
            own = np.flatnonzero((size > low) & (size <= width))
            for lo in range(0, len(own), 20_000):
                self._rounds(chunks, own[lo : lo + 20_000], width, size, out)
        for k in np.flatnonzero(size > LONGEST):
            out[k] = np.array(self.merge(chunks[k]), np.int32).tobytes()
        return out

    def _rounds(self, chunks: list[str], own: np.ndarray, width: int, size: np.ndarray, out: list[bytes]) -> None:
        n, length = len(own), size[own].copy()
        chars = np.frombuffer("".join([chunks[k] for k in own]).encode("utf-32-le"), np.uint32)
        flat = self.symbol_of[chars]
        flat = np.where(flat < 0, -2 - chars.astype(np.int32), flat)  # no piece holds it: kept as a negative code point
        cols = np.arange(width)
        symbol = np.full((n, width), -1, np.int32)
        symbol[cols[None, :] < length[:, None]] = flat
        rank, made = self._look(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())
        rank, made = rank.reshape(n, width - 1), made.reshape(n, width - 1)
        live = np.arange(n)
        final = np.full((n, width), -1, np.int32)
        while len(live):
            best = rank.argmin(axis=1)  # the leftmost of equals
            rows = np.arange(len(live))
            going = rank[rows, best] < NONE
            if not going.all():
                final[live[~going]] = symbol[~going]
                live, symbol, rank, made, best = live[going], symbol[going], rank[going], made[going], best[going]
                rows = np.arange(len(live))
                if not len(live):
                    break
            symbol[rows, best] = made[rows, best]
            length[live] -= 1
            take = np.minimum(cols[None, :] + (cols[None, :] > best[:, None]), width - 1)
            symbol = np.take_along_axis(symbol, take, 1)
            symbol[:, -1] = -1
            take = np.minimum(cols[None, :-1] + (cols[None, :-1] >= best[:, None]), width - 2)
            rank, made = np.take_along_axis(rank, take, 1), np.take_along_axis(made, take, 1)
            rank[:, -1] = NONE
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                where = at[ok]
                rank[ok, where], made[ok, where] = self._look(symbol[ok, where], symbol[ok, where + 1])
        valid = cols[None, :] < length[:, None]
        plain = ~((valid & ((final < 0) | (final >= self.library.get_piece_size()))).any(axis=1))
        at = np.zeros(n + 1, np.int64)
        np.cumsum(length * 4, out=at[1:])
        data, at = final[valid].tobytes(), at.tolist()
        for row, (k, ok) in enumerate(zip(own.tolist(), plain.tolist(), strict=True)):
            if ok:
                out[k] = data[at[row] : at[row + 1]]
            elif (left := final[row, : length[row]].tolist()) and max(left) < self.library.get_piece_size():
                ids = []
                for x in left:  # characters that no piece holds become their bytes
                    ids += [x] if x >= 0 else [self.byte[b] for b in chr(-2 - x).encode()] if self.byte else [self.unknown]
                out[k] = np.array(ids, np.int32).tobytes()
            else:
                out[k] = np.array(self.merge(chunks[k]), np.int32).tobytes()

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk by the agenda of pairs."""
        whole = self.id.get(chunk)
        score = self.score
        symbols = list(chunk)
        n = len(symbols)
        if n == 1 and whole is not None:
            return [whole]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            pair = symbols[k] + symbols[k + 1]
            if pair in score:
                agenda.append((-score[pair], k, pair))
        heapify(agenda)
        while agenda:
            _, k, pair = heappop(agenda)
            left = symbols[k]
            if left is None:
                continue
            right_at = after[k]
            if right_at >= n or len(left) + len(symbols[right_at]) != len(pair) or left + symbols[right_at] != pair:
                continue
            symbols[k], symbols[right_at] = pair, None
            after[k] = following = after[right_at]
            if following < n:
                before[following] = k
                joined = pair + symbols[following]
                if joined in score:
                    heappush(agenda, (-score[joined], k, joined))
            prior = before[k]
            if prior >= 0:
                joined = symbols[prior] + pair
                if joined in score:
                    heappush(agenda, (-score[joined], prior, joined))
        out = []
        for s in symbols:
            if s is None:
                continue
            k = self.id.get(s)
            if k is not None:
                out.append(k)
            elif self.byte:
                out += [self.byte[b] for b in s.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of chunks not seen lately: by the agenda, then checked against the library, all of them."""
        texts = [c.decode() for c in chunks]
        made = self.merge_many([t.replace(" ", MARK) for t in texts])
        count = np.array([len(x) // 4 for x in made], np.int64)
        ours = np.frombuffer(b"".join(made), np.int32)
        # The library adds one mark in front itself; a chunk always starts with one.
        theirs = self.library.encode([t[1:] for t in texts], num_threads=1)
        # It has no ids for an empty text, so a single mark has nothing to be held against.
        check = np.array([len(x) for x in theirs], np.int64)
        held = np.array([t != " " for t in texts])
        same = np.array_equal(check[held], count[held])
        if not same or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int32, int(check.sum())), ours[np.repeat(held, count)]):
            raise ValueError("the agenda and the library differ on a chunk")
        return ours, count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: none), one after another, and each row's place among them, the end included."""
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # the mark and a space are one symbol
        raw, at = tx.utf8(column)
        # The mark in front of every text that isn't empty.
        full = at[1:] > at[:-1]
        raw = np.insert(raw, at[:-1][full], 0x20)
        at = at + np.concatenate([[0], np.cumsum(full)])
        begins = np.zeros(len(raw), bool)
        if self.chunked:
            space = raw == 0x20
            begins[1:] = space[1:] & ~space[:-1]
        begins[at[:-1][full]] = True
        first = np.flatnonzero(begins)
        ids, count = self.memory.encode(raw, first, np.append(first[1:], len(raw))[: len(first)], self.learn)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(first, at)]


def codec(model_file: str) -> Codec:
    """One codec per worker and file."""
    return shared.kept(("pieces", model_file), lambda: Codec(model_file))


def decimal_sha256(ids: np.ndarray, at: np.ndarray, numerals: np.ndarray) -> list[str]:
    """SHA-256 of each row's decimal ids joined by commas; ``numerals`` has each id's digits and a comma, then zeros."""
    wide = numerals[ids]
    used = wide != 0
    data = wide[used].tobytes()
    edge = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[at].tolist()
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, model_file: str, *, keep: list[str] | None = None, with_ids: bool = True,
           with_text: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with their token ids and digests of ids and decoded text.

    Adds n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (UTF-8 of the library's decode of the
    ids), and ids or decoded (text) if asked for.  A null text is an empty one: no ids.  Texts of any length are encoded
    whole; equal texts get equal ids; doc_id may be null or repeat.  ``keep`` names further columns to carry.  The model
    file must exist on every executor (as an installed package does) or be added with ``spark.addFile``.
    """
    carried = ["doc_id", *(keep or [])]
    source = docs.select(*carried, "text")
    fields = [source.schema[c] for c in carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        with shared.working():
            c = codec(model_file if os.path.exists(model_file) else SparkFiles.get(os.path.basename(model_file)))
            if not c.plain:
                raise ValueError("this operator is for models whose normaliser leaves texts as they are")
            names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
            for batch in batches:
                column = tx.column(batch, "text")
                for lo, hi in tx.passes(column):
                    ids, at = c.encode(column.slice(lo, hi - lo))
                    edge = at.tolist()
                    decoded = c.library.decode([ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)], num_threads=1)
                    cols = [tx.column(batch, k).slice(lo, hi - lo) for k in carried]
                    cols.append(pa.array(np.diff(at), pa.int64()))
                    cols.append(pa.array(decimal_sha256(ids, at, c.numerals), pa.string()))
                    cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()))
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                    if with_text:
                        cols.append(pa.array(decoded, pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(run, schema)
