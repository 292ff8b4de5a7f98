"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A text is parsed greedily against it: each phrase is the
longest match from where the last one ended.  The language that needs the fewest phrases, each weighed by the logarithm
of its training length (the Ziv-Merhav estimate of cross entropy), wins.

Parsing runs as a finite automaton over UTF-8 bytes: a missing transition counts a phrase and restarts at the root.  The
transitions of all languages lie in one numpy table, and many blocks of text advance through it together.  Whole texts
are parsed; a block boundary ends a phrase, alike in every language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import text as tx

#: Training text: at most this many bytes of all languages together, and of one language (a bounded labelled sample).
TOTAL_BYTES, LANGUAGE_BYTES = 256_000, 32_000
#: Labelled documents taken of a language, about, before their text is cut to the bytes above.
SAMPLE_DOCS = 60
#: Values of lang that can be learned; more are an error.
MOST_LANGUAGES = 1000
#: Bytes that one block of a text holds; blocks advance through the automata side by side.
BLOCK = 512

SCHEMA = "doc_id long, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
#: Bytes as parsed: ASCII letters keep their (lower) case, other ASCII is one separator, bytes from 0x80 stay.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def train(labelled: DataFrame, *, total_bytes: int = TOTAL_BYTES, language_bytes: int = LANGUAGE_BYTES,
          sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """Training text per language from (text, lang): a bounded sample, the same for the same texts.

    Rows with a null lang or a text without letters are left out; without any other, nothing is learned.  Distinct texts are
    taken in the order of their hashes, 2 * ``sample_docs`` of a language at most, so neither doc_ids (null, repeated), copies,
    row order nor partitions matter.  Of a long text the first bytes are learned from.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not counts:
        return []
    each = min(language_bytes, total_bytes // len(counts))
    # The share of a language's distinct texts gives the hash range that holds about twice sample_docs of them; all, if few.
    edges = [(lang, min(2**63 - 1, int(-(2**63) + min(1.0, 2 * sample_docs / max(1, n)) * 2**64))) for lang, n in counts.items()]
    edge = spark.createDataFrame(edges, "lang string, edge long")
    near = rows.join(F.broadcast(edge), "lang").filter("h <= edge").select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= 2 * sample_docs).drop("k")
    # 2 * sample_docs rows of each of MOST_LANGUAGES languages at most, of which each has its share of the bytes.
    taken = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, each)).alias("text"))
    texts: dict[str, list] = {}
    for r in taken.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = []
    for lang in sorted(texts):
        parts = [_fold(t) for _, t in sorted(texts[lang])]
        share = max(64, each // max(1, min(len(parts), sample_docs)))
        # Every document gives its share; what is left of the bytes is filled from the longer ones.
        joined = b" ".join([p[:share] for p in parts] + [p[share:] for p in parts if len(p) > share])
        out.append((lang, re.sub(rb" +", b" ", joined)[:each]))
    return out


def _automaton(data: list[int], symbols: int) -> np.ndarray:
    """Suffix automaton of a symbol sequence as rows of transitions (-1: none); state 0 is the root."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in data:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(moves), symbols), -1, np.int32)
    for s, m in enumerate(moves):
        table[s, list(m)] = list(m.values())
    return table


class Model:
    """Automata of all languages in one transition table."""

    def __init__(self, training: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in training]
        self.weight = np.array([math.log2(len(data) + 1) for _, data in training])
        seen = sorted({c for _, data in training for c in data} | {0x20})
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(1, len(seen) + 1) if len(seen) < 256 else np.arange(256)
        symbols = len(seen) + 1
        tables, at, self.root = [], 0, []
        for _, data in training:
            table = _automaton(self.code[np.frombuffer(data, np.uint8)].tolist(), symbols)
            missing = table < 0
            start = np.where(table[0] < 0, 0, table[0])
            full = (np.where(missing, start[None, :], table).astype(np.int64) + at) * symbols
            # The lowest bit says that this step ended a phrase; the rest is the next state's place in the table.
            tables.append(((full << 1) | missing).astype(np.int32).ravel())
            self.root.append(at * symbols)
            at += len(table)
        self.table = np.concatenate(tables)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases that each text (folded bytes) needs in each language."""
        size = np.array([len(t) for t in texts])
        blocks = -(-size // BLOCK)
        raw = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        row = np.repeat(np.arange(len(texts)), blocks)
        first = np.repeat(np.cumsum(size) - size, blocks) + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        length = np.minimum(BLOCK, np.repeat(np.cumsum(size), blocks) - first)
        order = np.argsort(-length, kind="stable")
        first, length, row = first[order], length[order], row[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        count = np.zeros((len(self.langs), len(row)), np.int32)
        for k in range(len(self.langs)):
            state = np.full(len(row), self.root[k], np.int32)
            for step in range(BLOCK):
                n = active[step]
                if not n:
                    break
                moved = self.table[state[:n] + raw[first[:n] + step]]
                count[k, :n] += moved & 1
                state[:n] = moved >> 1
            count[k] += 1  # the phrase that the block's end cuts
        out = np.zeros((len(self.langs), len(texts)))
        for k in range(len(self.langs)):
            out[k] = np.bincount(row, count[k], minlength=len(texts))
        return out


def identify(docs: DataFrame, training: list[tuple[str, bytes]], *, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score, one row per row; ``keep`` names further columns to carry.

    lang_pred is ``und`` and the score 0 where the text is null or has no letter, or nothing was learned.  The score is
    the winner's share of the inverse entropies of all languages (1 with one language).  Ties go to the language that
    sorts first.  Equal texts get equal results; doc_id may be null or repeat.
    """
    keep = list(keep or [])
    given = docs.sparkSession.sparkContext.broadcast(training)
    source = docs.select("doc_id", "text", *[c for c in keep if c != "text"])
    kept = [source.schema[c] for c in ["doc_id", *keep]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    # The text is sent back only if it is among the columns to keep.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        training = given.value
        key = tuple((lang, hash(data)) for lang, data in training)
        model = shared.kept(("languages", key), lambda: Model(training)) if training else None
        names = [f.name for f in kept] + ["lang_pred", "score"]
        with shared.working():
            for batch in batches:
                column = tx.column(batch, "text")
                pred, score = [], []
                for lo, hi in tx.passes(column):
                    texts = column.slice(lo, hi - lo).to_pylist()
                    ok = [t is not None and bool(_LETTER.search(t)) and model is not None for t in texts]
                    if not any(ok):
                        pred += ["und"] * len(texts)
                        score += [0.0] * len(texts)
                        continue
                    cost = model.phrases([_fold(t) if o else b"" for t, o in zip(texts, ok, strict=True)]) * model.weight[:, None]
                    best = cost.argmin(axis=0)
                    inverse = 1 / np.maximum(cost, 1e-9)
                    share = inverse[best, np.arange(len(texts))] / inverse.sum(axis=0)
                    pred += [model.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                    score += [float(x) if o else 0.0 for x, o in zip(share, ok, strict=True)]
                columns = [tx.column(batch, f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    """Column: crc32 of doc_id as text is a multiple of 5 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_and_identify(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents that aren't held out, then identify all of them."""
    training = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, training, keep=keep)
