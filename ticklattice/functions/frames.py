"""Windows over long series in many tasks: a series is cut into blocks that carry their neighbours' nearest rows.

Frames of a fixed number of rows need no more than those.  A row's place in its series comes from its place within a part and
the small table of parts; parts are spans of time so short that the densest series has about a block's worth of rows in one.
Series that fit a block are not cut at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Rows of a block, and rows of the blocks around it that come along: at least the longest frame, nested ones added up.
BLOCK, BEFORE, AFTER = 1 << 16, 512, 64


def micros(df: DataFrame, ts: str) -> Column:
    """``ts`` as whole microseconds (numbers as they are), in the same order whatever the session's time zone."""
    kind = df.schema[ts].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(c(ts))
    if kind in ("timestamp_ntz", "date"):
        days = F.datediff(c(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
        if kind == "date":
            return days
        seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
        return days + seconds + (F.extract(F.lit("SECOND"), c(ts)) * 1_000_000).cast("long")
    return F.floor(c(ts)).cast("long")


def measured(df: DataFrame, *, key: str, ts: str, rows: int) -> tuple[int, int]:
    """Rows of the longest series, and the span of ``ts`` that holds about ``rows`` rows of the densest; one aggregation."""
    at = micros(df, ts)
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    longest, dense = each.agg(F.max("n"), F.max(c("n") / F.greatest(c("span"), F.lit(1)))).first()
    return longest or 0, max(1, int(rows / dense)) if dense else 1


def placed(df: DataFrame, span: int, *, key: str = "symbol", ts: str = "ts", tie: str | None = None, start: Column | None = None) -> DataFrame:
    """Adds ``__part``, the place of the row's span of time, and ``__n``, its place (from 0) in its key's series.

    The order is that of (ts, tie), and of a hash of the whole row where both repeat; a null ts comes first.
    """
    rows = df.withColumn("__part", F.floor(micros(df, ts) / span).cast("long"))
    inside = Window.partitionBy(key, "__part").orderBy(ts, *([tie] if tie else []), F.xxhash64(*[c(f"`{x}`") for x in df.columns]))
    sizes = rows.groupBy(c(key).alias("__key"), c("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("__key", "__p", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    local = rows.withColumn("__local", F.row_number().over(inside) - 1)
    joined = local.join(carry, c(key).eqNullSafe(c("__key")) & c("__part").eqNullSafe(c("__p")))
    return joined.select(*df.columns, "__part", (c("__before") + c("__local")).alias("__n"))


def numbered(df: DataFrame, *, key: str = "symbol", ts: str = "ts", tie: str | None = None, block: int | None = None) -> DataFrame:
    """Adds ``__n``, each row's place (from 0) in its key's series; no task holds a series longer than a block."""
    longest, span = measured(df, key=key, ts=ts, rows=block or BLOCK)
    if longest <= (block or BLOCK):
        order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []), F.xxhash64(*[c(f"`{x}`") for x in df.columns]))
        return df.withColumn("__n", (F.row_number().over(order) - 1).cast("long"))
    return placed(df, span, key=key, ts=ts, tie=tie).drop("__part")


def _cut(rows: DataFrame, own: Column, block: int, before: int, after: int) -> DataFrame:
    """Adds ``__own``, the row's block, and ``__block``, a block it comes to: once more for each neighbour that needs it."""
    n = c("__n")
    blocks = F.array_compact(F.array(own, F.when(n >= (own + 1) * block - before, own + 1), F.when((n - own * block < after) & (own > 0), own - 1)))
    return rows.select("*", own.alias("__own"), F.explode(blocks).alias("__block"))


def framed(df: DataFrame, build: Callable[[DataFrame], DataFrame], *, key: str = "symbol", ts: str = "ts", tie: str | None = None,
           before: int = BEFORE, after: int = AFTER, block: int | None = None) -> DataFrame:
    """``build(df)``, computed by blocks of each key's series.

    ``build`` makes columns of windows partitioned by ``key`` and ordered by (ts, tie), whose frames reach at most ``before``
    rows back and ``after`` ahead, nested ones added up; it keeps rows, and ``key``, ``ts`` and ``tie`` among the columns.
    A build that also keeps ``__mine`` may get rows that repeat (ts, tie) in two blocks; for one that drops it, such rows stay in
    one block.  Null keys are a series, a null ts comes first, an empty table stays empty.
    """
    block = block or BLOCK
    if block < max(before, after):
        raise ValueError(f"a block of {block} rows is shorter than the rows around it")
    longest, span = measured(df, key=key, ts=ts, rows=block)
    if longest <= block:
        return build(df)
    rows = placed(df, span, key=key, ts=ts, tie=tie)

    def built(cut: DataFrame) -> DataFrame:
        named = F.struct(c(key).alias("key"), c("__block").alias("block"))
        return build(cut.select(*[named.alias(key) if x == key else c(f"`{x}`") for x in df.columns], (c("__own") == c("__block")).alias("__mine")))

    back = lambda out: out.select(*[c(f"{key}.key").alias(key) if x == key else c(f"`{x}`") for x in out.columns if x != "__mine"])
    out = built(_cut(rows, F.floor(c("__n") / block), block, before, after))
    if "__mine" in out.columns:
        return back(out.filter("__mine"))
    # Rows that repeat (ts, tie) belong to the block of their first; then a block's own rows lie between two of them.
    at = [ts, *([tie] if tie else [])]
    first = F.min("__n").over(Window.partitionBy(key, *at))
    cut = _cut(rows.withColumn("__n0", first), F.floor(c("__n0") / block), block, before, after)
    mine, of = c("__own") == c("__block"), Window.partitionBy(key, "__block")
    ends = [f(F.when(mine, F.struct(*at))).over(of) for f in (F.min, F.max)]
    named = F.struct(c(key).alias("key"), c("__block").alias("block"), ends[0].alias("first"), ends[1].alias("last"))
    out = build(cut.select(*[named.alias(key) if x == key else c(f"`{x}`") for x in df.columns]))
    here = F.struct(*at)
    return back(out.filter((here >= c(f"{key}.first")) & (here <= c(f"{key}.last"))))


def columns(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """``keep`` and the window columns ``made`` of ``df``, computed by blocks."""
    return framed(df, lambda rows: rows.select(*keep, *[v.alias(k) for k, v in made.items()], *[x for x in rows.columns if x == "__mine"]))
