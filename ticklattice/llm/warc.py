"""WARC archives: an index first, then coalesced byte-range reads of the records it selects.

``write_archives`` stores one gzip member per page, so that each record can be read alone, and returns an index row per
record (file, offset, length, URL, digest).  ``read_archives`` sorts the selected index rows by place, joins neighbouring
ranges into one read and cuts the records out of it.  Tasks name their files by a random id and report them in the index
rows, so that a task that runs twice leaves a file that no index row points to, never a wrong one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 100
#: Ranges closer than GAP are read at once, up to RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of an archive that stay with one task, bytes that a task reads where there are many, and tasks a core where there are few.
SLOT_BYTES, TASK_BYTES, TASKS = 4 << 20, 256 << 20, 4


def _header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
        if _header(url) != url:  # the url as it came, for the reader
            lines.append(f"Target-URI-Base64: {base64.b64encode(url.encode()).decode()}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    """The record that opens a file; the index doesn't name it."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files in ``folder``; returns the index as a written table.

    Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with the smallest page_id is the response and
    the others are revisits of it.  Null html is an empty payload, a null url writes no target, one with control characters is
    read back as it was; payloads may be of any length, an empty table writes no file.  Rows with a null page_id are responses; a page_id that repeats is written as often (its smallest copy counts by payload alone, so copies of the
    response's own id stay responses).  Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Only digests that repeat are kept, in a written table: the join below is a plain one that Spark may split or broadcast.
    repeated = shared.written(
        rows.filter((F.length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "first_id"),
        "warc-repeated",
    )
    joined = rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.expr("nullif(first_id, page_id)").alias("refers_to")
    )
    joined = joined.withColumn("refers_to", F.expr("if(page_id is null, null, refers_to)"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
        files, path = shared.filesystem(name)
        out, at = None, 0
        for batch in batches:
            index = {k: [] for k in ("offset", "length", "record_type")}
            ids, urls, payloads, digests, refers = (batch.column(k) for k in range(5))
            for k in range(len(batch)):
                record = _record(ids[k].as_py(), urls[k].as_py(), payloads[k].as_py(), digests[k].as_py(), refers[k].as_py())
                member = _member(record, level)
                if out is None:
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                    first = _member(_info(name.rpartition("/")[2]), level)
                    out.write(first)
                    at = len(first)
                out.write(member)
                index["offset"].append(at)
                index["length"].append(len(member))
                index["record_type"].append("response" if refers[k].as_py() is None else "revisit")
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(batch), pa.string()), pa.array(index["offset"], pa.int64()),
                    pa.array(index["length"], pa.int64()), ids, urls, digests,
                    pa.array(index["record_type"], pa.string()), refers,
                ],
                names=["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"],
            )
        if out is not None:
            out.close()

    index = joined.mapInArrow(write, INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": base64.b64decode(fields["Target-URI-Base64"]).decode() if "Target-URI-Base64" in fields else fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": int(fields["Payload-Length"]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def read_archives(index: DataFrame, *, with_payload: bool = True, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """Records of the given index rows (any selection of them), read by coalesced ranges and checked by digest.

    A row that the selection names twice is read twice; no rows, no records.  Payloads may be of any length; those of revisits
    are null.
    """
    # Dealt by bytes of the archives, for the index itself is small: neighbours in a file lie together and in order, and a
    # large file goes to several tasks.  There is a task for each TASK_BYTES asked for; of less, TASKS a core at most.
    places = index.select("file", "offset", "length")
    asked = places.agg(F.sum("length").alias("n")).first()["n"] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = 1 + max(asked // TASK_BYTES, min(2 * asked // SLOT_BYTES, TASKS * cores))
    slot = F.floor(F.col("offset") / SLOT_BYTES)
    places = places.repartition(tasks, F.col("file"), slot).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        opened, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            k = 0
            while k < len(places):
                name, start, length = places[k]
                last, end = k + 1, start + length
                while last < len(places) and places[last][0] == name and places[last][1] <= end + gap and places[last][1] + places[last][2] - start <= most:
                    end = max(end, places[last][1] + places[last][2])
                    last += 1
                if name != opened:
                    if source is not None:
                        source.close()
                    files, path = shared.filesystem(name)
                    opened, source = name, files.open_input_file(path)
                data = source.read_at(end - start, start)
                rows = [_parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in places[k:last]]
                if not with_payload:
                    for row in rows:
                        row["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                k = last
        if source is not None:
            source.close()

    return places.mapInArrow(read, RECORD)
