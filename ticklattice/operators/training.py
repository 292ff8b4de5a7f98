"""From bars and features to what a model is trained on: preparation, splits by time, scaling by the training part, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import frames, quantiles, scan
from ticklattice.functions import rolling as R
from ticklattice.functions.indicators import full, rows

c = F.col


def filled(df: DataFrame, x: str, *, key: str = "symbol", both: bool = False) -> DataFrame:
    """``df`` with nulls of ``x`` taken from the row before that has one, with ``both`` else from the row after."""
    at = scan.known(df, x, key=key)
    return at.select(*[(F.coalesce("__back.x", "__ahead.x") if both else c("__back.x")).alias(x) if k == x else c(f"`{k}`") for k in df.columns])


def prepare(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, ts, close, ret, log_ret, mean_n, std_n, vol_n, z_n) of bars (symbol, ts, high, low, close).

    Closes that are not positive, or of a bar with high below low, are lost and filled from the bars around; what lies beyond the
    symbol's fences (1.5 quartile widths) is clipped to them; then returns and rolling statistics.
    """
    valid = bars.filter("symbol is not null and ts is not null").select("symbol", "ts", F.when((c("close") > 0) & (c("high") >= c("low")), c("close")).alias("close"))
    whole = filled(valid, "close", both=True)
    q = quantiles.by_key(whole, "symbol", "close", {"q1": 0.25, "q3": 0.75}).withColumnRenamed("symbol", "__s")
    wide = (c("q3") - c("q1")) * 1.5
    clipped = whole.join(q, c("symbol") == c("__s")).select("symbol", "ts", F.least(F.greatest("close", c("q1") - wide), c("q3") + wide).alias("close"))

    def build(b: DataFrame) -> DataFrame:
        one = b.select("*", *[v.alias(k) for k, v in R.returns().items()])
        mean, sd = F.avg("close").over(rows(n)), F.stddev_samp("close").over(rows(n))
        return one.select("*", full("close", n, mean).alias(f"mean_{n}"), full("close", n, sd).alias(f"std_{n}"), R.realized_volatility("ret", n).alias(f"vol_{n}"), R.z_score("close", n).alias(f"z_{n}"))

    return frames.framed(clipped, build)


def split_by_days(ts: Column, last: str, days: tuple[int, int, int] = (365, 90, 30)) -> Column:
    """train, validation or test: the last days test, those before validate, those before train; older rows are null."""
    end = F.lit(last).cast("timestamp_ntz")
    age = F.datediff(end.cast("date"), F.to_date(ts))
    train, validation, test = days
    return F.when(age < test, "test").when(age < test + validation, "validation").when(age < test + validation + train, "train")


def split_at(ts: Column, validation: str, test: str) -> Column:
    """train before ``validation``, test from ``test`` on."""
    return F.when(ts < F.lit(validation).cast("timestamp_ntz"), "train").when(ts < F.lit(test).cast("timestamp_ntz"), "validation").otherwise("test")


#: Targets made of a value and that ``ahead`` rows on.
TARGETS = {
    "value": lambda now, then: then,
    "difference": lambda now, then: then - now,
    "return": lambda now, then: F.try_divide(then, now) - 1,
    "log": lambda now, then: F.log1p(then),
    "direction": lambda now, then: F.when(then.isNotNull(), (then > now).cast("double")),
}


def training_set(features: DataFrame, columns: list[str], split: Column, target: str, *, kind: str = "return", ahead: int = 1, fences: float | None = 1.5) -> DataFrame:
    """(symbol, ts, split, each column scaled, target) of ``features`` (symbol, ts, columns, target's column).

    Columns are filled forward; training rows with a value beyond the training part's fences are dropped; columns are scaled by the
    mean and deviation of the training rows left, so nothing of the later parts is learned.  The target is made of the value
    ``ahead`` rows on; rows without one, or without a split, are left out.
    """
    rows_ = features
    for x in columns:
        rows_ = filled(rows_, x)
    then = F.lead(target, ahead).over(Window.partitionBy("symbol").orderBy("ts"))
    plain = rows_.columns
    rows_ = frames.framed(rows_, lambda r: r.select("*", then.alias("__then")), before=1, after=ahead)
    rows_ = rows_.select(*plain, split.alias("split"), TARGETS[kind](c(target), c("__then")).alias("target")).filter("split is not null and target is not null")
    if fences is not None:
        bounds = quantiles.quantiles(rows_.filter("split = 'train'"), {x: x for x in columns}, [0.25, 0.75])
        for x, (a, b) in bounds.items():
            if a is not None:
                rows_ = rows_.filter((c("split") != "train") | F.coalesce(c(x).between(a - (b - a) * fences, b + (b - a) * fences), F.lit(True)))
    fit = rows_.filter("split = 'train'").agg(*[f(x).alias(f"{x}__{n}") for x in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = rows_.crossJoin(F.broadcast(fit))  # one row
    return both.select("symbol", "ts", "split", *[F.try_divide(c(x) - c(f"{x}__m"), c(f"{x}__s")).alias(f"{x}_scaled") for x in columns], "target")
