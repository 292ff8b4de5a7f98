"""Token files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed by zstandard.

A file is a run of chunks followed by nothing; the index (a Parquet table beside the files) has a row per chunk with its
place, and a row per document with its place in the stream of ids.  A chunk is decoded alone, so a reader fetches only the
chunks that its documents touch.

Chunk: magic ``TLP1``, plane kind (1 byte: 1 bit planes, 8 byte planes), number of ids (uint32), number of planes
(1 byte), the compressed size of each plane (uint32 each), then the planes, lowest first.  Planes above the highest set bit
or byte are left out.  Integers are little-endian.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as tx
from .chunkmemory import LONGEST, ChunkMemory

MAGIC = b"TLP1"
#: Ids of a block.
BLOCK = 1 << 16
#: Chunks that a worker remembers, about; then it begins anew.
REMEMBERED = 1_300_000


def pack(ids: np.ndarray, *, bits: bool = False, level: int = 3) -> bytes:
    """One chunk of uint32 ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    high = int(ids.max()) if len(ids) else 0
    if bits:
        count = high.bit_length()
        planes = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(count)]
    else:
        count = (high.bit_length() + 7) // 8
        by = ids.view(np.uint8).reshape(-1, 4)
        planes = [by[:, k].tobytes() for k in range(count)]
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) for p in planes]
    head = MAGIC + struct.pack("<BIB", 1 if bits else 8, len(ids), count) + struct.pack(f"<{count}I", *map(len, packed))
    return head + b"".join(packed)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; raises ValueError if it isn't one."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of a token file")
    kind, n, count = struct.unpack_from("<BIB", chunk, 4)
    sizes = struct.unpack_from(f"<{count}I", chunk, 10)
    at = 10 + 4 * count
    press = zstandard.ZstdDecompressor()
    out = np.zeros(n, np.uint32)
    for k, size in enumerate(sizes):
        plane = np.frombuffer(press.decompress(chunk[at : at + size], max_output_size=max(1, n)), np.uint8)
        if kind == 1:
            out |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        else:
            out |= plane.astype(np.uint32) << np.uint32(8 * k)
        at += size
    return out


#: ASCII white space, the rarer separators included.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the bytes a, b, c (UTF-8) begin with a white-space character."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    quad = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    wide = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return _WHITE[a] | two | quad | wide


class ByteEncoder:
    """Whole texts to ids with the tokenizers library, remembering the ids of chunks that repeat.

    Byte-level vocabularies split a text before each single space that a non-space follows, whatever stands around it, so
    the chunks between such spaces are encoded apart with the same result.  A text with added tokens, with white space
    around a space, or with a space at its end goes to the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else b""
        spec = spec if isinstance(spec, bytes) else str(spec).encode()
        self.chunked = b"ByteLevel" in spec and b'"add_prefix_space":false' in spec and self.library.normalizer is None
        #: Ids whose piece begins with the byte-level sign of a space.
        size = self.library.get_vocab_size()
        self.spaced = np.array([(self.library.id_to_token(k) or "")[:1] == "\u0120" for k in range(size)])
        self.memory = ChunkMemory(REMEMBERED)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of new chunks.  Those that begin with their only space go many in one call, cut where a piece
        begins with a space; white space at a chunk's end would meet the next one's space, so those go apart."""
        texts = [c.decode() for c in chunks]
        inner = [k for k, t in enumerate(texts) if t.rfind(" ") == 0 and not t[-1].isspace() and not t[1].isspace() and len(t) <= LONGEST]
        order, ids, count = [], [], []
        for lo in range(0, len(inner), 2000):
            part = inner[lo : lo + 2000]
            found = np.array(self._library(["".join([texts[k] for k in part])])[0], np.int32)
            at = np.flatnonzero(self.spaced[found])
            if len(at) == len(part):
                order += part
                ids.append(found)
                count.append(np.diff(np.append(at, len(found))))
        together = set(order)  # without those of a part that the cut doesn't fit
        apart = [k for k in range(len(texts)) if k not in together]
        found = self._library([texts[k] for k in apart])
        ids += [np.array(x, np.int32) for x in found]
        count.append(np.array([len(x) for x in found], np.int64))
        count, ids = np.concatenate(count), np.concatenate([np.zeros(0, np.int32), *ids])
        start = np.cumsum(count) - count
        back = np.argsort(np.array(order + apart, np.int64), kind="stable")
        count = count[back]
        total = np.cumsum(count)
        return ids[np.repeat(start[back] - (total - count), count) + np.arange(len(ids))], count

    def _whole(self, column: pa.Array, raw: np.ndarray, at: np.ndarray, space: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows whose chunks can't be told by their spaces."""
        if not self.chunked:
            return np.ones(len(column), bool)
        out = np.zeros(len(column), bool)
        edged = np.zeros(len(raw) + 6, np.uint8)
        edged[3:-3] = raw
        s = space + 3
        after = _white(edged[s + 1], edged[s + 2], edged[s + 3]) | (space + 1 == at[row + 1])
        before = (space > at[row]) & (
            _WHITE[edged[s - 1]] | (_white(edged[s - 2], edged[s - 1], edged[s]) & (edged[s - 2] == 0xC2)) | (_white(edged[s - 3], edged[s - 2], edged[s - 1]) & (edged[s - 3] >= 0xE1))
        )
        out[row[after | before]] = True
        for token in self.added:
            out |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: none), one after another, and each row's place among them, the end included."""
        raw, at = tx.utf8(column)
        space = np.flatnonzero(raw == 0x20)
        row = np.searchsorted(at, space, "right") - 1
        whole = self._whole(column, raw, at, space, row)
        begins = np.zeros(len(raw), bool)
        begins[at[:-1][at[1:] > at[:-1]]] = True
        begins[space[~whole[row]]] = True
        first = np.flatnonzero(begins)
        ids, count = self.memory.encode(raw, first, np.append(first[1:], len(raw))[: len(first)], self._learn)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(first, at)]


def encoder(file: str) -> ByteEncoder:
    return shared.kept(("tokens", file), lambda: ByteEncoder(file))


ROW = "file string, part int, kind string, doc_id long, number long, start long, n long, offset long, length long"


def write_tokens(docs: DataFrame, tokenizer_file: str, folder: str, *, end_id: int = 0, bits: bool = False,
                 block: int = BLOCK, level: int = 3) -> DataFrame:
    """Write the ids of every text in ascending doc_id order; returns the index as a written table.

    Each text's ids are followed by ``end_id``.  Null texts are empty; null doc_ids come first; rows with equal doc_id come
    in the order of their texts' hashes.  Files are numbered by ``part``; the order of parts, and of documents within them,
    is the order of doc_ids.  Index rows are of kind ``doc`` (start: ids before it in its file, n: its ids) or ``chunk``
    (start, n: ids; offset, length: bytes).
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    names = [x.split()[0] for x in ROW.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_file if os.path.exists(tokenizer_file) else SparkFiles.get(os.path.basename(tokenizer_file)))
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bin"
        files, path = shared.filesystem(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        held, done, offset, number, written_ids = np.zeros(0, np.int32), 0, 0, 0, 0
        out = None
        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("kind", pa.string()), *[(c, pa.int64()) for c in names[3:]]])

        def rows_of(kind: str, size: int, **columns: object) -> pa.RecordBatch:
            fixed = {"file": name, "part": part, "kind": kind}
            return pa.RecordBatch.from_arrays(
                [pa.array([fixed[f.name]] * size, f.type) if f.name in fixed else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema],
                schema=schema,
            )

        def chunks(data: np.ndarray) -> pa.RecordBatch:
            nonlocal out, done, offset
            if out is None:
                out = files.open_output_stream(path, compression=None)
            start, count, place, length = [], [], [], []
            for k in range(0, len(data), block):
                packed = pack(data[k : k + block], bits=bits, level=level)
                out.write(packed)
                for x, v in ((start, done), (count, len(data[k : k + block])), (place, offset), (length, len(packed))):
                    x.append(v)
                done, offset = done + count[-1], offset + len(packed)
            return rows_of("chunk", len(start), start=start, n=count, offset=place, length=length)

        with shared.working():
            for batch in batches:
                column, doc_ids = tx.column(batch, "text"), tx.column(batch, "doc_id")
                for lo, hi in tx.passes(column):
                    ids, at = enc.encode(column.slice(lo, hi - lo))
                    n = np.diff(at) + 1
                    yield rows_of("doc", hi - lo, doc_id=doc_ids.slice(lo, hi - lo), number=number + np.arange(hi - lo), start=written_ids + np.cumsum(n) - n, n=n)
                    number, written_ids = number + hi - lo, written_ids + int(n.sum())
                    held = np.concatenate([held, np.insert(ids, at[1:], end_id)])
                    full = len(held) // block * block
                    if full:
                        yield chunks(held[:full])
                        held = held[full:]
            if len(held):
                yield chunks(held)
            if out is not None:
                out.close()

    path = f"{folder}/index"
    ordered.mapInArrow(write, ROW).write.parquet(path)
    return spark.read.schema(ROW).parquet(path)


def read_tokens(index: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the index as read back from the files: doc_id, start (ids of all before), n_tokens, ids_crc32.

    ``start`` adds the totals of the files before; there is one total per file, so few rows pass the driver.  With
    ``with_ids`` the ids come as an array too.
    """
    spark = index.sparkSession
    totals = index.filter("kind = 'doc'").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, sums = 0, []
    for r in totals:
        sums.append((r["part"], before))
        before += r["n"]
    base = spark.createDataFrame(sums, "part int, base long")
    # In a file's order, a document comes after the chunks that it lies in: by its last id, chunks by their first.
    rows = (
        index.withColumn("at", F.when(F.col("kind") == "doc", F.col("start") + F.col("n") - 1).otherwise(F.col("start")))
        .join(F.broadcast(base), "part")
        .select("file", "at", "kind", "doc_id", "start", "n", "offset", "length", "base")
        .repartition("file").sortWithinPartitions("file", "at", "kind")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, near, unpacked = None, None, deque(), {}
        for batch in batches:
            got = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)}
            for r in batch.to_pylist():
                if r["file"] != opened:
                    if source is not None:
                        source.close()
                    files, path = shared.filesystem(r["file"])
                    opened, source, near, unpacked = r["file"], files.open_input_file(path), deque(), {}
                if r["kind"] == "chunk":
                    near.append(r)
                    continue
                while near and near[0]["start"] + near[0]["n"] <= r["start"]:
                    unpacked.pop(near.popleft()["offset"], None)
                parts = []
                for c in near:
                    if c["offset"] not in unpacked:
                        unpacked[c["offset"]] = unpack(source.read_at(c["length"], c["offset"]))
                    lo = max(0, r["start"] - c["start"])
                    parts.append(unpacked[c["offset"]][lo : r["start"] + r["n"] - c["start"]])
                ids = np.concatenate(parts)
                if len(ids) != r["n"]:
                    raise ValueError(f"{r['file']} lacks ids of document {r['doc_id']}")
                got["doc_id"].append(r["doc_id"])
                got["start"].append(r["base"] + r["start"])
                got["n_tokens"].append(r["n"])
                got["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    got["ids"].append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k, v in got.items()], names=list(got)
            )
        if source is not None:
            source.close()

    return rows.mapInArrow(read, schema)
