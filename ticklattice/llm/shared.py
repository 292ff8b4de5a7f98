"""The folder that driver and executors share, and plain files in it.

``spark.checkpoint.dir`` names the folder.  Executors keep nothing that another task needs in local folders: tables are
written by Spark, other files through ``pyarrow.fs``, which opens local, HDFS and object-store paths by their URI.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one is set only where the session names none (local runs, tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ticklattice-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI; no two calls return the same one, so a rerun never reads an earlier run's files."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, *, dealt: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder that joins on ``key`` without being shuffled again.

    Its name is dropped at once: what is planned on it, and its files, stay.  A frame that is ``dealt`` lies by ``key`` already.
    """
    spark = df.sparkSession
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), "ticklattice_" + uuid.uuid4().hex
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    found = spark.table(table)
    found.schema  # noqa: B018 (resolved before the name goes)
    spark.sql(f"drop table {table}")
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later read needs."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path within it (``file:/x``, as Hadoop writes it, included)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write one file, its folder included."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path, compression=None) as src:
        return src.read()


#: What a Python worker keeps for the tasks that come after this one, oldest first, and when it was last asked for.
_KEPT: dict[tuple, object] = {}
#: Seconds after which an idle worker forgets it, and how often it looks.
IDLE_S, LOOK_S = 4.0, 1.0
_USE = {"busy": 0, "last": 0.0, "watched": False}
_LOCK = threading.Lock()


def kept(key: tuple, make: Callable[[], object], *, most: int = 1) -> object:
    """The object of ``key``, made if this worker lacks it: at most ``most`` of one kind (``key[0]``), none of other kinds.

    Workers serve stage after stage, so what an earlier operator left would stay in memory beside what the next one needs.
    """
    with _LOCK:
        for other in [k for k in _KEPT if k[0] != key[0]]:
            del _KEPT[other]
        _USE["last"] = time.monotonic()
        if key not in _KEPT:
            while len(_KEPT) >= most:
                del _KEPT[next(iter(_KEPT))]
            _KEPT[key] = make()
        if not _USE["watched"]:
            _USE["watched"] = True
            threading.Thread(target=_forget_when_idle, daemon=True).start()
        return _KEPT[key]


class working:  # noqa: N801
    """Context of a task that uses what is kept; a worker outside of any forgets it soon and gives its memory back."""

    def __enter__(self) -> None:
        with _LOCK:
            _USE["busy"] += 1

    def __exit__(self, *_: object) -> None:
        with _LOCK:
            _USE["busy"] -= 1
            _USE["last"] = time.monotonic()


def _forget_when_idle() -> None:
    while True:
        time.sleep(LOOK_S)
        with _LOCK:
            if _USE["busy"] or time.monotonic() - _USE["last"] < IDLE_S:
                continue
            _KEPT.clear()
            _USE["watched"] = False
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass
        return
