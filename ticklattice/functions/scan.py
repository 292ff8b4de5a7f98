"""Recurrences and running sums over long series, without holding a series in one task.

A series is cut into parts of a bounded number of rows.  Each part is summed on its own, the small table of parts is carried
forward per key, and the carry is added back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import frames

#: Rows after which powers of a decay start anew, to stay within what doubles hold, and such chunks of a part.
CHUNK, CHUNKS = 128, 512
#: Decays between 0 and this are refused: their powers over a chunk leave the range of doubles.
LEAST_DECAY = 0.01
#: Logarithm of the least positive double: what decays below it is gone.
GONE = -745.0


def running_sums(df: DataFrame, sums: dict[str, Column], *, key: str = "symbol", ts: str = "ts", tie: str | None = None, rows: int | None = None, greatest: bool = False) -> DataFrame:
    """Adds cumulative sums per key in the order of (ts, tie), or with ``greatest`` running maxima; null terms count as nothing (a
    maximum of nothing is null), a null ts comes first."""
    add = F.max if greatest else F.sum
    nothing = F.lit(None).cast("double") if greatest else F.lit(0)
    _, span = frames.measured(df, key=key, ts=ts, rows=rows or frames.BLOCK)
    cut = df.select("*", F.floor(frames.micros(df, ts) / span).cast("long").alias("__part"), *[e.alias(f"__{n}") for n, e in sums.items()])
    order = [ts, *([tie] if tie else [])]
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(*[add(f"__{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__key", "__p", *[F.coalesce(add(f"__t_{n}").over(before), nothing).alias(f"__c_{n}") for n in sums])
    local = cut.select("*", *[F.coalesce(add(f"__{n}").over(inside), nothing).alias(f"__l_{n}") for n in sums])
    joined = local.join(carry, F.col(key).eqNullSafe(F.col("__key")) & F.col("__part").eqNullSafe(F.col("__p")))
    both = (lambda n: F.greatest(f"__l_{n}", f"__c_{n}")) if greatest else (lambda n: F.col(f"__l_{n}") + F.col(f"__c_{n}"))
    return joined.select(*df.columns, *[both(n).alias(n) for n in sums])


def decayed_sums(df: DataFrame, sums: dict[str, tuple[Column, float]], *, key: str = "symbol", ts: str = "ts", tie: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds y[t] = decay * y[t-1] + x[t] per key in the order of (ts, tie), for each name: (x, decay); also ``__n``, the place.

    Null x count as 0; decays are 0 (x itself), LEAST_DECAY to 1 (a running sum), and none leaves anything out.  Within a chunk y is
    a weighted window sum; a chunk takes over what the chunks before it in its part leave, and a part what the parts before it
    leave: two tables, each a small fraction of the one below.  Rows that have ``__n`` already keep it.
    """
    for _, d in sums.values():
        if d != 0 and not LEAST_DECAY <= d <= 1:
            raise ValueError(f"decay {d}")
    c = F.col
    at = df if "__n" in df.columns else frames.numbered(df, key=key, ts=ts, tie=tie, block=rows)
    kept = [x for x in df.columns if x != "__n"]
    at = at.select("*", *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"__x_{n}") for n, (x, _) in sums.items()])
    at = at.withColumn("__chunk", F.floor(c("__n") / CHUNK).cast("long")).withColumn("__j", (c("__n") % CHUNK).cast("int"))
    real = {n: d for n, (_, d) in sums.items() if d}
    if not real:
        return at.select(*kept, "__n", *[c(f"__x_{n}").alias(n) for n in sums])
    inside = Window.partitionBy(key, "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    local = at.select("*", *[(F.sum(c(f"__x_{n}") * F.pow(F.lit(1 / d), c("__j"))).over(inside) * F.pow(F.lit(d), c("__j"))).alias(f"__l_{n}") for n, d in real.items()])
    # What a chunk leaves at its end, counted as full; only the last of a series is not, and nothing follows that.
    ends = at.groupBy(c(key).alias("__key"), c("__chunk").alias("__k")).agg(*[F.sum(c(f"__x_{n}") * F.pow(F.lit(d), F.lit(CHUNK - 1) - c("__j"))).alias(f"__s_{n}") for n, d in real.items()])
    ends = ends.withColumn("__part", F.floor(c("__k") / CHUNKS)).withColumn("__i", (c("__k") % CHUNKS).cast("int"))
    near = Window.partitionBy("__key", "__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)

    def left(name: str, d: float) -> Column:
        """Of the chunks before in the part; at most CHUNKS of them."""
        held = F.collect_list(F.struct(c("__i").alias("i"), c(f"__s_{name}").alias("s"))).over(near)
        return F.aggregate(held, F.lit(0.0), lambda a, e: a + e["s"] * F.pow(F.lit(d), (c("__i") - 1 - e["i"]) * CHUNK))

    parts = ends.groupBy(c("__key").alias("__pk"), c("__part").alias("__p")).agg(*[F.sum(c(f"__s_{n}") * F.pow(F.lit(d), (F.lit(CHUNKS - 1) - c("__i")) * CHUNK)).alias(f"__t_{n}") for n, d in real.items()])

    def before(name: str, d: float) -> Column:
        """Of the parts before; those from which not even the least double is left are not asked."""
        size = CHUNK * CHUNKS
        reach = Window.unboundedPreceding if d == 1 else -math.ceil(GONE / (size * math.log(d))) - 1
        far = F.collect_list(F.struct(c("__p").alias("p"), c(f"__t_{name}").alias("t"))).over(Window.partitionBy("__pk").orderBy("__p").rangeBetween(reach, -1))
        return F.aggregate(far, F.lit(0.0), lambda a, e: a + e["t"] * F.pow(F.lit(d), (c("__p") - 1 - e["p"]) * size))

    parts = parts.select("__pk", "__p", *[before(n, d).alias(f"__b_{n}") for n, d in real.items()])
    carried = ends.select("*", *[left(n, d).alias(f"__c_{n}") for n, d in real.items()]).join(parts, c("__key").eqNullSafe(c("__pk")) & (c("__part") == c("__p")))
    carried = carried.select("__key", "__k", *[(c(f"__c_{n}") + c(f"__b_{n}") * F.pow(F.lit(d), c("__i") * CHUNK)).alias(f"__c_{n}") for n, d in real.items()])
    joined = local.join(carried, c(key).eqNullSafe(c("__key")) & (c("__chunk") == c("__k")))
    value = lambda n: c(f"__l_{n}") + c(f"__c_{n}") * F.pow(F.lit(real[n]), c("__j") + 1) if n in real else c(f"__x_{n}")
    return joined.select(*kept, "__n", *[value(n).alias(n) for n in sums])


def known(df: DataFrame, *xs: str, key: str = "symbol", ts: str = "ts", tie: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds the place ``__n`` of each row in its series, and the nearest rows with a value of ``x``: ``__back`` and ``__ahead``,
    structs (n, x), the row itself included; null where no such row is on that side.  Of several ``xs`` the names end in them
    (``__ahead_x``), and all are found in one go.

    What a part of the series knows last and first is carried over the table of parts, one way each; a part without a value
    hands on what came to it.
    """
    c = F.col
    _, span = frames.measured(df, key=key, ts=ts, rows=rows or frames.BLOCK)
    at = frames.placed(df, span, key=key, ts=ts, tie=tie)
    has = {x: F.when(c(x).isNotNull(), F.struct(c("__n").alias("n"), c(x).alias("x"))) for x in xs}
    # Ahead by the order turned round: a frame to the end of a part is gone through anew for each of its rows.
    part, series = Window.partitionBy(key, "__part"), Window.partitionBy("__key")
    so_far = lambda value, order: F.last(value, True).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    local = at.select("*", *[so_far(v, F.asc("__n")).alias(f"__in_back_{x}") for x, v in has.items()], *[so_far(v, F.desc("__n")).alias(f"__in_ahead_{x}") for x, v in has.items()])
    parts = at.groupBy(c(key).alias("__key"), c("__part").alias("__p")).agg(*[f(v).alias(f"__{n}_{x}") for x, v in has.items() for n, f in (("last", F.max), ("first", F.min))])
    earlier = lambda value, order: F.last(value, True).over(series.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = [(earlier(f"__last_{x}", F.asc_nulls_first("__p")).alias(f"__before_{x}"), earlier(f"__first_{x}", F.desc_nulls_last("__p")).alias(f"__after_{x}")) for x in xs]
    carry = parts.select("__key", "__p", *[e for pair in ends for e in pair])
    joined = local.join(carry, c(key).eqNullSafe(c("__key")) & c("__part").eqNullSafe(c("__p")))
    name = lambda side, x: f"__{side}_{x}" if len(xs) > 1 else f"__{side}"
    found = [(F.coalesce(f"__in_back_{x}", f"__before_{x}").alias(name("back", x)), F.coalesce(f"__in_ahead_{x}", f"__after_{x}").alias(name("ahead", x))) for x in xs]
    return joined.select(*df.columns, "__n", *[f for pair in found for f in pair])


def ema(df: DataFrame, columns: dict[str, tuple[Column, int]], *, key: str = "symbol", ts: str = "ts", adjust: bool = True, tie: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds exponential moving averages, name: (x, span), with alpha = 2 / (span + 1); a span of 1 gives x itself.

    ``adjust`` weighs by the terms seen so far (the mean of a growing series); without it the first value seeds the series.
    """
    decay = {n: 1 - 2 / (span + 1) for n, (_, span) in columns.items()}
    at = frames.numbered(df, key=key, ts=ts, tie=tie, block=rows)
    terms = {f"__y_{n}": (x if adjust else F.when(F.col("__n") == 0, x).otherwise(x * (1 - decay[n])), decay[n]) for n, (x, _) in columns.items()}
    summed = decayed_sums(at, terms, key=key, ts=ts, tie=tie)
    value = lambda n: F.col(f"__y_{n}") * (1 - decay[n]) / (1 - F.pow(F.lit(decay[n]), F.col("__n") + 1)) if adjust else F.col(f"__y_{n}")
    return summed.select(*df.columns, *[value(n).alias(n) for n in columns])
