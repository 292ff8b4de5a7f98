"""Cleaning of ticks and bars: typing, filling, outliers, error repair and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import folders, frames, quantiles, scan


def clean_symbol(x: Column) -> Column:
    """Upper case without an exchange suffix such as ``.US``, anything but letters and digits dropped."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)\.US$", ""), "[^A-Za-z0-9]", ""))


def clean_number(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9.-]", "")


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def typed(rows: DataFrame) -> DataFrame:
    """Untyped ticks (symbol, size: strings) with clean symbol, price as DECIMAL(18,8) and size as LONG; failed casts are null."""
    return rows.select(
        clean_symbol(F.col("symbol")).alias("symbol"), "ts", "trade_id", F.col("price").cast("decimal(18,8)").alias("price_decimal"),
        clean_number(F.col("size")).try_cast("long").alias("size_long"), "ingested",
    )


def keep_latest(rows: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """One row per key, that with the greatest ``latest``."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in latest])
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def flag_exact_duplicates(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Adds content_hash and is_duplicate: true for all but the first row of equal content."""
    content = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    w = Window.partitionBy("content_hash").orderBy(order)
    return rows.withColumn("content_hash", content).withColumn("is_duplicate", F.row_number().over(w) > 1)


def _order() -> Window:
    return Window.partitionBy("symbol").orderBy("ts", "trade_id")


def with_around(rows: DataFrame, x: str, reach: int, name: str) -> DataFrame:
    """Adds the mean of ``x`` over the rows up to ``reach`` before and after, by blocks of a series."""
    mean = F.avg(x).over(_order().rowsBetween(-reach, reach)).alias(name)
    return frames.framed(rows, lambda r: r.select("*", mean), tie="trade_id", before=reach, after=reach)


def fill_centred_mean(rows: DataFrame, x: str, name: str = "centred", reach: int = 10) -> DataFrame:
    """Adds ``x`` with nulls filled by the mean of the rows around."""
    return with_around(rows, x, reach, "__around").withColumn(name, F.coalesce(F.col(x), F.col("__around"))).drop("__around")


def fill_nearest(rows: DataFrame, x: str) -> DataFrame:
    """Adds forward, backward and linear: ``x`` with nulls filled by the last value before, the first after, and the line between.

    The line goes by row position, and takes the nearest value at the ends.  Series are split into parts; a part without a value
    hands on what came to it.  Without any value all three stay null.
    """
    at = scan.known(rows, x, tie="trade_id")
    a, i, b, j = F.col("__back.x"), F.col("__back.n"), F.col("__ahead.x"), F.col("__ahead.n")
    line = a + (b - a) * (F.col("__n") - i) / (j - i)
    linear = F.when(F.col(x).isNotNull(), F.col(x)).when(a.isNull(), b).when(b.isNull(), a).otherwise(line)
    return at.select(*rows.columns, a.alias("forward"), b.alias("backward"), linear.alias("linear"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def with_symbol_statistics(rows: DataFrame, x: str, *, quartiles: bool = True) -> DataFrame:
    """Rows beside their symbol's mean and deviation, with ``quartiles`` also q1, median and q3; Spark broadcasts the small side
    where it is small."""
    stats = rows.groupBy(F.col("symbol").alias("__symbol")).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    if quartiles:
        found = quantiles.by_key(rows, "symbol", x, QUARTILES)
        stats = stats.join(found, F.col("__symbol").eqNullSafe(F.col("symbol"))).drop("symbol")
    return rows.join(stats, F.col("symbol") == F.col("__symbol"), "left").drop("__symbol")


def fill_statistics(rows: DataFrame, x: str) -> DataFrame:
    """Nulls of x filled by the symbol's median and mean, in columns of their own."""
    s = with_symbol_statistics(rows, x)
    return s.select(*rows.columns, F.coalesce(x, "median").alias(f"{x}_median"), F.coalesce(x, "mean").alias(f"{x}_mean"))


def _fenced(rows: DataFrame, x: str, width: float) -> DataFrame:
    """Adds is_outlier and capped by the fences of the symbol's quartiles."""
    s = with_symbol_statistics(rows, x)
    low, high = F.col("q1") - (F.col("q3") - F.col("q1")) * width, F.col("q3") + (F.col("q3") - F.col("q1")) * width
    out = F.coalesce((F.col(x) < low) | (F.col(x) > high), F.lit(False))
    return s.select(*rows.columns, out.alias("is_outlier"), F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), low), high)).alias("capped"))


def outliers_iqr(rows: DataFrame, x: str, width: float = 1.5) -> DataFrame:
    """Flag beyond the quartiles' fences per symbol, and the capped, nulled and neighbour-mean values."""
    s = with_around(folders.written(_fenced(rows, x, width), "fenced"), x, 5, "__around")
    out = F.col("is_outlier")
    return s.select(*rows.columns, "is_outlier", "capped", F.when(~out, F.col(x)).alias("nulled"), F.when(out, F.col("__around")).otherwise(F.col(x)).alias("smoothed"))


def outliers_z(rows: DataFrame, x: str, width: float = 3.0) -> DataFrame:
    s = with_symbol_statistics(rows, x, quartiles=False)
    low, high = F.col("mean") - F.col("std") * width, F.col("mean") + F.col("std") * width
    out = F.coalesce((F.col(x) < low) | (F.col(x) > high), F.lit(False))
    return s.select(*rows.columns, out.alias("is_outlier"), F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), low), high)).alias("capped"))


def outliers_global(rows: DataFrame, x: str) -> DataFrame:
    """Flags over the whole table: IQR 1.5, z 3 and modified z 3.5 (median and median absolute deviation)."""
    one = rows.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first()
    number = lambda v: F.lit(v).cast("double")
    q1, med, q3 = (number(v) for v in quantiles.quantiles(rows, {x: x}, [0.25, 0.5, 0.75])[x])
    mad = number(quantiles.quantiles(rows, {x: F.abs(F.col(x) - med)}, [0.5])[x][0])
    no = lambda v: F.coalesce(v, F.lit(False))
    return rows.select(
        "*", no((F.col(x) < q1 - (q3 - q1) * 1.5) | (F.col(x) > q3 + (q3 - q1) * 1.5)).alias("is_iqr"),
        no(F.abs(F.try_divide(F.col(x) - number(one["mean"]), number(one["std"]))) > 3).alias("is_z"),
        no(F.abs(F.try_divide((F.col(x) - med) * 0.6745, mad)) > 3.5).alias("is_modified_z"),
    )


def repair_ticks(rows: DataFrame) -> DataFrame:
    """A price that is not positive becomes null, a negative size 0; both rounded (4 and 0 digits)."""
    return rows.withColumn("price_fixed", F.round(F.when(F.col("price") > 0, F.col("price")), 4)).withColumn("size_fixed", F.greatest(F.col("size"), F.lit(0)))


def repair_bars(bars: DataFrame) -> DataFrame:
    """High and low stretched to hold open and close; negative volume 0."""
    return bars.select(
        "symbol", "ts", "open", F.greatest("open", "high", "low", "close").alias("high"), F.least("open", "high", "low", "close").alias("low"), "close", F.greatest("volume", F.lit(0)).alias("volume")
    )


def clean_ticks(rows: DataFrame) -> DataFrame:
    """The whole chain on untyped ticks: type, deduplicate, repair, fill, cap, and say what was done.

    What the steps need several times (measuring and numbering of series, scans for quantiles) is written once before each.
    """
    t = keep_latest(typed(rows), ["symbol", "ts", "trade_id"], ["ingested"])
    t = t.select("symbol", "ts", "trade_id", F.col("price_decimal").cast("double").alias("price"), F.col("size_long").alias("size"))
    t = repair_ticks(t).select("symbol", "ts", "trade_id", F.col("price_fixed").alias("price"), F.col("size_fixed").alias("size"))
    t = folders.written(t.withColumn("was_filled", F.col("price").isNull()), "repaired")
    t = fill_centred_mean(t, "price").select("symbol", "ts", "trade_id", "size", "was_filled", F.col("centred").alias("price"))
    capped = _fenced(folders.written(t, "filled"), "price", 1.5)
    return capped.select(
        "symbol", "ts", "trade_id", "size", F.col("capped").alias("price"), F.col("is_outlier").cast("int").alias("outliers_detected"), (F.col("is_outlier") | F.col("was_filled")).alias("data_cleaned")
    )
