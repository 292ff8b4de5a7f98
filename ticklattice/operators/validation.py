"""Validation rules as boolean columns, severity reports, quality scores and feature checks: one aggregation per report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import frames

c = F.col


def between(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x >= low) & (x <= high), F.lit(False))


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


#: Rule names and conditions of each kind of record.
RULES: dict[str, dict[str, Column | object]] = {
    "quotes": {
        "has_symbol": lambda: c("symbol").isNotNull() & (F.length("symbol") > 0), "has_ts": lambda: c("ts").isNotNull(),
        "price_range": lambda: between(c("bid"), 0.01, 100000) & between(c("ask"), 0.01, 100000), "ask_above_bid": lambda: _true(c("ask") >= c("bid")),
        "spread_ok": lambda: _true(F.try_divide(c("ask") - c("bid"), (c("ask") + c("bid")) / 2) * 10000 <= 1000), "size_ok": lambda: between(c("bid_size"), 1, 1e9),
    },
    "trades": {
        "has_symbol": lambda: c("symbol").isNotNull() & c("symbol").rlike("^[A-Z0-9._-]+$"), "has_ts": lambda: c("ts").isNotNull(),
        "price_range": lambda: between(c("price"), 0.01, 100000), "size_range": lambda: between(c("size"), 1, 1e9),
    },
    "bars": {
        "has_symbol": lambda: c("symbol").isNotNull(), "price_range": lambda: between(c("close"), 0.01, 100000), "volume_range": lambda: between(c("volume"), 0, 1e12),
        "ohlc": lambda: _true((c("high") >= F.greatest("open", "close", "low")) & (c("low") <= F.least("open", "close", "high"))),
    },
}


def validate(rows: DataFrame, kind: str, passing: float = 0.8) -> DataFrame:
    """Adds a column ``is_valid_<rule>`` per rule, rules_passed, validation_score and is_valid (score >= ``passing``)."""
    rules = RULES[kind]
    flags = rows.select("*", *[r().alias(f"is_valid_{n}") for n, r in rules.items()])
    passed = reduce(lambda a, b: a + b, [c(f"is_valid_{n}").cast("int") for n in rules])
    flags = flags.withColumn("rules_passed", passed).withColumn("validation_score", c("rules_passed") / len(rules))
    return flags.withColumn("is_valid", c("validation_score") >= passing)


def summary(rows: DataFrame, kind: str) -> DataFrame:
    """(rule, passed, total, pass_rate) in one aggregation, unpivoted."""
    rules = [f"is_valid_{n}" for n in RULES[kind]] + ["is_valid"]
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(r).alias(r) for r in rules])
    long = one.unpivot("total", rules, "rule", "passed")
    return long.select("rule", "passed", "total", F.try_divide("passed", "total").alias("pass_rate"))


def _issue(when: Column, field: str, severity: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def severity_report(quotes: DataFrame) -> DataFrame:
    """Issues of each quote as an array, counts by severity, and the quality they amount to."""
    issues = F.filter(
        F.array(
            _issue(c("symbol").isNull() | (F.length("symbol") == 0), "symbol", "error", "empty symbol"),
            _issue(c("bid") <= 0, "bid", "error", "bid is not positive"), _issue(c("bid") > c("ask"), "bid", "error", "bid above ask"),
            _issue(c("bid") == c("ask"), "ask", "warning", "zero spread"), _issue(c("bid_size") <= 0, "bid_size", "error", "size is not positive"),
            _issue(F.try_divide(c("ask") - c("bid"), c("bid")) > 0.1, "ask", "warning", "wide spread"),
        ), lambda x: x.isNotNull(),
    )
    out = quotes.withColumn("issues", issues)
    errors, warnings = (F.size(F.filter("issues", f)) for f in (lambda x: x.severity == "error", lambda x: x.severity == "warning"))
    quality = F.when(errors > 1, "QUESTIONABLE").when(errors == 1, "LOW").when(warnings > 0, "MEDIUM").otherwise("HIGH")
    return out.select("*", errors.alias("errors"), warnings.alias("warnings"), quality.alias("quality"))


#: Places of the qualities in their order.
QUALITY_ORDER = {"QUESTIONABLE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}


def quality_gate(rows: DataFrame, least: str = "MEDIUM") -> DataFrame:
    place = F.create_map(*[x for k, v in QUALITY_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return rows.filter(place[c("quality")] >= QUALITY_ORDER[least])


def order_book_checks(books: DataFrame) -> DataFrame:
    """Best prices, spread, depth and order of the levels of books (bids, asks: arrays of (price, size))."""
    bid, ask = F.transform("bids", lambda x: x.price), F.transform("asks", lambda x: x.price)
    falls = F.forall(F.zip_with(F.slice("bids", 1, F.greatest(F.size("bids") - 1, F.lit(0))), F.slice("bids", 2, F.size("bids")), lambda a, b: a.price >= b.price), lambda x: x)
    rises = F.forall(F.zip_with(F.slice("asks", 1, F.greatest(F.size("asks") - 1, F.lit(0))), F.slice("asks", 2, F.size("asks")), lambda a, b: a.price <= b.price), lambda x: x)
    depth = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v["size"])
    return books.select(
        "symbol", "ts", F.array_max(bid).alias("best_bid"), F.array_min(ask).alias("best_ask"), (F.array_min(ask) - F.array_max(bid)).alias("spread"),
        falls.alias("bids_sorted"), rises.alias("asks_sorted"), depth("bids").alias("bid_depth"), depth("asks").alias("ask_depth"),
    )


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, total, completeness) of all columns by one aggregation; NaN counts as null in doubles."""
    kinds = dict(rows.dtypes)
    null = lambda n: c(n).isNull() | F.isnan(n) if kinds[n] in ("double", "float") else c(n).isNull()
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(null(n)).alias(n) for n in columns])
    long = one.unpivot("total", columns, "column", "nulls")
    return long.select("column", "nulls", "total", (1 - F.try_divide("nulls", "total")).alias("completeness"))


def uniqueness(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct share of the key and of each column."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.struct(*keys)).alias("key"), *[F.count_distinct(n).alias(n) for n in columns])
    long = one.unpivot("total", ["key", *columns], "column", "distinct_values")
    return long.select("column", "distinct_values", "total", F.try_divide("distinct_values", "total").alias("uniqueness"))


def with_in_order(rows: DataFrame) -> DataFrame:
    """Adds in_order: ts is not before that of the row with the previous trade_id of its symbol."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("trade_id"))
    return frames.framed(rows, lambda r: r.withColumn("in_order", c("ts") >= before), ts="trade_id", before=1, after=0)


def assess(rows: DataFrame) -> DataFrame:
    """One row of completeness, accuracy, consistency, timeliness, uniqueness, overall score, grade and recommendations.

    ``rows``: (symbol, ts, trade_id, price, size, ingested).
    """
    latency = (F.unix_micros(c("ingested").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp"))) / 1e6
    timely = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (latency - 300) / 300))
    given = with_in_order(rows)
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    one = given.agg(
        F.avg((c("symbol").isNotNull().cast("int") + c("ts").isNotNull().cast("int") + c("price").isNotNull().cast("int")) / 3).alias("completeness"),
        ((share(c("price") > 0) + share(c("size") >= 0) + share(c("symbol").rlike("^[A-Z]{1,10}$"))) / 3).alias("accuracy"),
        F.avg(F.coalesce(c("in_order"), F.lit(True)).cast("double")).alias("consistency"), F.avg(timely).alias("timeliness"),
        F.avg((latency > 600).cast("double") * 100).alias("late_pct"),
        (F.count_distinct(F.struct("symbol", "ts", "trade_id")) / F.count(F.lit(1))).alias("uniqueness"),
    )
    parts = ("completeness", "accuracy", "consistency", "timeliness", "uniqueness")
    one = one.withColumn("overall", reduce(lambda a, b: a + b, [c(p) for p in parts]) / len(parts))
    grade = F.when(c("overall") >= 0.95, "A").when(c("overall") >= 0.85, "B").when(c("overall") >= 0.75, "C").when(c("overall") >= 0.65, "D").otherwise("F")
    low = F.concat_ws(",", *[F.when(c(p) < 0.8, F.lit(p)) for p in parts])
    return one.select("*", grade.alias("grade"), low.alias("recommendations"))


def check_features(long: DataFrame) -> DataFrame:
    """Checks of each feature of (feature_id, value): completeness, variance, outlier and distinct shares, and whether all pass."""
    fences = long.groupBy(c("feature_id").alias("f")).agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    iqr = c("q3") - c("q1")
    out = (c("value") < c("q1") - iqr * 1.5) | (c("value") > c("q3") + iqr * 1.5)
    one = long.join(fences, c("feature_id") == c("f")).groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count("value") / F.count(F.lit(1))).alias("completeness"), F.var_samp("value").alias("variance"),
        F.avg(F.coalesce(out, F.lit(False)).cast("double")).alias("outlier_ratio"), (F.count_distinct("value") / F.count(F.lit(1))).alias("distinct_ratio"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )
    return one.withColumn("passes", (c("completeness") >= 0.95) & (c("variance") > 0) & (c("outlier_ratio") <= 0.05))


def check_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Custom rules (name, column, SQL condition) as one aggregation: rows that fail and the pass rate of each."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~F.coalesce(F.expr(cond), F.lit(False))).alias(n) for n, _, cond in rules])
    long = one.unpivot("total", [n for n, _, _ in rules], "rule", "failed")
    return long.select("rule", "failed", "total", (1 - F.try_divide("failed", "total")).alias("pass_rate"))


def conform(rows: DataFrame, schema: dict[str, tuple[str, bool]], *, keep_extra: bool = False) -> DataFrame:
    """Rows in a declared layout {name: (type, nullable)}, with ``conform_errors``: columns that were required or failed to cast.

    Missing nullable columns become null; a missing required one is an error of every row.
    """
    have = set(rows.columns)
    out, errors = [], []
    for name, (kind, nullable) in schema.items():
        value = c(name).try_cast(kind) if name in have else F.lit(None).cast(kind)
        out.append(value.alias(name))
        bad = (c(name).isNotNull() & value.isNull()) if name in have else F.lit(False)
        if not nullable:
            bad = bad | value.isNull()
        errors.append(F.when(bad, F.lit(name)))
    extra = [c(n) for n in rows.columns if n not in schema] if keep_extra else []
    return rows.select(*out, *extra, F.array_compact(F.array(*errors)).alias("conform_errors"))
