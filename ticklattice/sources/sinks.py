"""Batch sinks: feature tables, compaction, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, *, mode: str = "append") -> None:
    """Feature rows (feature_id, entity_id, event_ts, value), by feature and date of the event."""
    rows = features.withColumn("_ingestion_time", F.current_timestamp()).withColumn("_partition_date", F.to_date("event_ts"))
    rows.repartition("feature_id", "_partition_date").write.mode(mode).partitionBy("feature_id", "_partition_date").parquet(path)


def compact(rows: DataFrame, path: str, *, files: int, keep_from: str | None = None) -> None:
    """Few sorted files by symbol and time; rows before ``keep_from`` go."""
    kept = rows if keep_from is None else rows.filter(F.col("ts") >= F.lit(keep_from).cast(rows.schema["ts"].dataType))
    kept.repartitionByRange(files, "symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode("overwrite").parquet(path)


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    writer = rows.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def to_kafka(messages: DataFrame, servers: str) -> None:
    """Messages (topic, key, value); needs Spark's Kafka package on the class path.  Keys keep a symbol in one partition."""
    messages.selectExpr("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()
