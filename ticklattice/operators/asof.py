"""Point-in-time reads: as-of joins by a union of both sides and a running last value, one shuffle by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(spine: DataFrame, values: DataFrame, *, key: str = "symbol", ts: str = "ts", columns: list[str], within: str | None = None, part: str | None = None) -> DataFrame:
    """Each spine row with the latest values at or before its time.

    At equal times a value counts for the spine.  ``within`` (an interval such as ``60 minutes``) makes older values null.
    Values carry their time as ``value_ts``.  ``part`` (a duration) splits long series: the value before each part is
    carried into it, so that no key's whole history is one task's.
    """
    held = F.struct(F.col(ts).alias("value_ts"), *columns)
    kind = values.select(held.alias("v")).schema["v"].dataType
    left = spine.withColumn("__v", F.lit(None).cast(kind)).withColumn("__side", F.lit(1))
    right = values.select(F.col(key), F.col(ts), held.alias("__v")).withColumn("__side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    keys = [F.col(key)]
    if part:
        both = both.withColumn("__part", F.window(F.col(ts), part).start)
        keys.append(F.col("__part"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    if part:
        ends = both.filter("__side = 0").groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.max_by("__v", ts).alias("__e"))
        spans = both.select(F.col(key).alias("__key"), F.col("__part").alias("__p")).distinct().join(ends, ["__key", "__p"], "left")
        before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        carry = spans.select("__key", "__p", F.last("__e", ignorenulls=True).over(before).alias("__c"))
        found = found.join(carry, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p"))).withColumn("__v", F.coalesce("__v", "__c"))
    out = found.filter("__side = 1")
    value: Column = F.col("__v")
    if within:
        value = F.when(F.col(ts) - F.col("__v.value_ts") <= F.expr(f"interval {within}"), F.col("__v"))
    return out.withColumn("__v", value).select(*spine.columns, "__v.*")


def bitemporal(spine: DataFrame, features: DataFrame, *, key: str = "entity_id") -> DataFrame:
    """As-of read by two clocks: the value with the latest event time among those ingested by the spine's time.

    ``spine``: (key, ts); ``features``: (key, event_ts, ingested, value).  A value is known from the later of both times; a
    running maximum by event time over that order gives the newest of the known ones.
    """
    known = features.select(F.col(key), F.greatest("event_ts", "ingested").alias("ts"), F.struct("event_ts", "ingested", "value").alias("__v"), F.lit(0).alias("__side"))
    kind = known.schema["__v"].dataType
    left = spine.withColumn("__v", F.lit(None).cast(kind)).withColumn("__side", F.lit(1))
    w = Window.partitionBy(key).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(known, allowMissingColumns=True).withColumn("__best", F.max("__v").over(w))
    return both.filter("__side = 1").select(*spine.columns, F.col("__best.event_ts").alias("event_ts"), F.col("__best.value").alias("value"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a map-side combined max_by."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last writer wins: rows of ``new`` replace those of equal keys."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys aren't there yet are added."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def delete_where(rows: DataFrame, condition: str) -> DataFrame:
    """Rows but those for which the condition holds; an unknown condition keeps the row."""
    return rows.filter(~F.coalesce(F.expr(condition), F.lit(False)))


def convert_currency(prices: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """``prices`` (symbol, ts, price, currency) in the base currency, by the rate in force for the pair at the time."""
    found = as_of(prices, rates, key="currency", columns=["rate"])
    rate = F.when(F.col("currency") == base, 1.0).otherwise(F.col("rate"))
    return found.select(*prices.columns, (F.col("price") * rate).alias("price_base"))
