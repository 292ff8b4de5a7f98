"""Tables that micro-batches change a little of: dealt by a hash of the key, of which a batch reads and writes only the parts it touches.

A batch's parts lie in a folder of its number; a manifest of a row a part names the batch that last wrote it.  A batch that runs
again starts from the manifest before it and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders

c = F.col


class KeyedTable:
    """A table at ``path`` by ``keys``, in ``parts`` parts: the number of parts, not that of batches or keys, bounds a manifest."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def batches(self) -> list[int]:
        """Numbers of the batches that ended, rising."""
        if not self._files.exists(self._at("_manifest")):
            return []
        names = [s.getPath() for s in self._files.listStatus(self._at("_manifest"))]
        done = [p for p in names if self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch that last wrote each part, as of the last batch (before number ``before``)."""
        done = [b for b in self.batches() if before is None or b < before]
        if not done:
            return {}
        return {r["part"]: r["batch"] for r in self.spark.read.parquet(f"{self.path}/_manifest/{done[-1]}").collect()}  # a row a part

    def _folders(self, manifest: dict[int, int], parts: list[int] | None = None) -> list[str]:
        return [f"{self.path}/{b}/__part={p}" for p, b in sorted(manifest.items()) if parts is None or p in parts]

    def read(self, schema, *, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows as of the last batch (before number ``before``), of all parts or some."""
        found = self._folders(self.manifest(before), parts)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in self.dealt(rows).select("__part").distinct().collect())  # ``parts`` rows at most

    def update(self, rows: DataFrame, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge ``rows`` into the parts that hold their keys; ``merge`` gets the old and new rows of whole parts, of which each key's
        result depends on that key's rows alone."""
        old = self.manifest(batch_id)
        with folders.held(rows, "batch") as new:
            parts = self.touched(new)
            both = new.unionByName(self.read(new.schema, before=batch_id, parts=parts))
            self.dealt(merge(both)).write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/{batch_id}")
        now = old | dict.fromkeys(parts, batch_id)
        table = self.spark.createDataFrame(sorted(now.items()), "part int, batch int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/{batch_id}")

    def expire(self, keep: int = 2) -> None:
        """Delete the parts that the last ``keep`` manifests don't name, and older manifests."""
        done = self.batches()
        named = {(b, p) for m in done[-keep:] for p, b in self.manifest(m + 1).items()}
        for b in done:
            if not self._files.exists(self._at(b)):
                continue
            held = [s.getPath() for s in self._files.listStatus(self._at(b)) if s.getPath().getName().startswith("__part=")]
            for p in held:
                if (b, int(p.getName().split("=")[1])) not in named:
                    self._files.delete(p, True)
        for b in done[:-keep]:
            self._files.delete(self._at("_manifest", b), True)


def last_rows(rows: DataFrame, key: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The last ``n`` rows of each key; every task cuts its own down first."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter(c("__n") <= n).drop("__n")
