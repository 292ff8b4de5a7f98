"""URL filter: rules first, then a ratio of character language models.

Two smoothed variable-order Markov models, of the URLs that the rules allow and of those they block, give each other URL a
log-likelihood difference per character.  Each order's estimate falls back on the next lower one by the weight of its
context's count.  Counts are exact: a written table keyed by symbols (the longest context and the symbol after it), from
which the lower orders are summed; it grows with the input and stays in Spark's tables.  What a symbol adds depends on the
longest context and the symbol alone, so every distinct such gram is scored once, by joins order by order, and URLs meet
the scores in blocks: a gram that all URLs hold is one row a block.  The threshold is calibrated on labelled URLs that the
models did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as tx

#: (host, path, verdict): the longest rule that fits a URL decides; ties in length are settled by the order of the text.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Longest context (a gram of it and a symbol is packed into one long, so 6 at most), weight of the lower order.
ORDER, WEIGHT = 4, 2.0
#: Bytes of URLs that meet their grams' scores in one group; a longer URL is a block of its own.
BLOCK_BYTES = 1 << 18
#: Orders whose tables are broadcast: at most (SYMBOLS + 2) ** 2 rows, whatever the input.
BOUNDED = 1
#: One labelled URL in so many is kept for the threshold.
CALIBRATION = 5
#: Classes of characters beyond ASCII fall into one; a URL has as many symbols.
SYMBOLS = 128
BINS = 2000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.substring_index(url, "://", 1)
    has = F.instr(url, "://") > 0
    after = F.when(has, url.substr(F.length(rest) + 4, F.length(url)))
    host = F.regexp_extract(after, r"(?s)\A[^/?#]*", 0)
    tail = after.substr(F.length(host) + 1, F.length(after))
    path = F.regexp_extract(tail, r"(?s)\A[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (like ``net/de/``; null if none fits) and ruled (its verdict)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one wrapped around is asked first: the longest.
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def _grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and gram of all symbols of the URLs, an end mark included.

    A gram holds the symbol in its lowest eight bits and the ``order`` symbols in front of it, nearest first, above.
    """
    raw, at = tx.utf8(column)
    n = len(at) - 1
    size = np.diff(at) + 1
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(n), size)
    symbol = np.ones(int(size.sum()), np.int64)  # 1 is the end
    place = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(at))
    symbol[place] = np.minimum(raw, 127).astype(np.int64) + 2
    inside = np.arange(len(symbol)) - np.repeat(begin, size)
    gram = symbol.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(symbol), np.int64)
        before[k:] = symbol[:-k]
        before[inside < k] = 0  # in front of a URL stand zeros
        gram |= before << (8 * k)
    return row, gram


#: Counts of a gram: of URLs for the calibrated model and of all labelled URLs, blocked and allowed.
COUNTS = ("block_part", "allow_part", "block_all", "allow_all")


def count(labelled: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(gram, COUNTS) of all labelled URLs (url, ruled, kept_back); the first two leave out those that are kept back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.array([v == "allow" for v in batch.column(1).to_pylist()], np.int64)
            part = ~np.array(batch.column(2).to_pylist(), bool)
            for lo, hi in tx.passes(batch.column(0)):
                row, gram = _grams(batch.column(0).slice(lo, hi - lo), order)
                found, which = np.unique(gram, return_inverse=True)
                label, seen = side[lo:hi][row], part[lo:hi][row]
                sums = [np.bincount(which[(label == k) & (seen | whole)], minlength=len(found)) for whole in (False, True) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["gram", *COUNTS])

    sums = labelled.select("url", "ruled", "kept_back").mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in COUNTS))
    return sums.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def scores(grams: DataFrame, counts: DataFrame, *, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """(gram, part, whole) of each distinct gram of ``grams``: what its symbol adds to the ratio, allowed less blocked.

    ``part`` is by the counts without the URLs kept back, ``whole`` by all.  A key of a lower order meets at most
    SYMBOLS + 2 rows of the next, so no join has a hot key.
    """
    probabilities = [f"p_{c}" for c in COUNTS]

    def last(k: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))

    needed, joined = {order: grams.select("gram").distinct()}, {order: counts}
    for k in range(order - 1, -1, -1):
        needed[k] = needed[k + 1].select(last(k).alias("gram")).distinct()
        lower = joined[k + 1].groupBy(last(k).alias("gram")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        joined[k] = shared.written(lower, f"order-{k}")
    below = None
    for k in range(order + 1):
        hint = F.broadcast if k <= BOUNDED else lambda df: df
        contexts = joined[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(*[F.sum(c).alias(f"n_{c}") for c in COUNTS])
        rows = needed[k].join(hint(joined[k]), "gram", "left").withColumn("context", F.shiftright("gram", 8))
        rows = rows.join(F.broadcast(contexts) if k <= BOUNDED + 1 else contexts, "context", "left")
        if below is None:
            rows = rows.withColumns({p: F.lit(1.0 / (SYMBOLS + 2)) for p in probabilities})
        else:
            rows = rows.withColumn("shorter", last(k - 1)).join(F.broadcast(below) if k - 1 <= BOUNDED else below, "shorter")
        made = [
            ((F.coalesce(F.col(c), F.lit(0)) + weight * F.col(p)) / (F.coalesce(F.col(f"n_{c}"), F.lit(0)) + weight)).alias(p)
            for c, p in zip(COUNTS, probabilities, strict=True)
        ]
        level = shared.written(rows.select("gram", *made), f"scored-{k}")
        below = level.withColumnRenamed("gram", "shorter")
    return level.select("gram", (F.log("p_allow_part") - F.log("p_block_part")).alias("part"), (F.log("p_allow_all") - F.log("p_block_all")).alias("whole"))


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (url among them) with ``block``: at most BLOCK_BYTES of URLs, or one URL, share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for lo, hi in tx.passes(tx.column(batch, "url"), BLOCK_BYTES):
                at[lo:hi] = block
                block += 1
            yield batch.append_column("block", pa.array(at))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, kinds + ", block long")


def pairs(rows: DataFrame, *, order: int = ORDER) -> DataFrame:
    """(block, gram): the distinct grams of each block of ``rows`` (url, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                gram = np.unique(_grams(batch.column(0).slice(lo, hi - lo), order)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block[lo])), pa.array(gram)], names=["block", "gram"])

    return rows.select("url", "block").mapInArrow(run, "block long, gram long")


def scored(rows: DataFrame, counts: DataFrame, *, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """``rows`` (url, block among them) with each URL's log-likelihood difference per symbol, allowed less blocked:
    ``ratio_part`` and ``ratio``, as ``scores`` has part and whole.  A null or empty URL has its lone end."""
    held = shared.written(pairs(rows, order=order), "grams")
    given = held.join(shared.written(scores(held, counts, order=order, weight=weight), "scores"), "gram").select("block", "gram", "part", "whole")

    def run(urls: pa.Table, table: pa.Table) -> pa.Table:
        urls = urls.combine_chunks()
        known = table["gram"].to_numpy()
        by = np.argsort(known)
        known, values = known[by], [table[c].to_numpy()[by] for c in ("part", "whole")]
        column = urls["url"].combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out = [[np.zeros(0)], [np.zeros(0)]]
        for lo, hi in tx.passes(column):
            row, gram = _grams(column.slice(lo, hi - lo), order)
            place = np.searchsorted(known, gram)
            n = np.bincount(row, minlength=hi - lo)
            for k in range(2):
                out[k].append(np.bincount(row, values[k][place], minlength=hi - lo) / n)
        for name, found in zip(("ratio_part", "ratio"), out, strict=True):
            urls = urls.append_column(name, pa.array(np.concatenate(found)))
        return urls

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, kinds + ", ratio_part double, ratio double")


def calibrate(labelled: DataFrame) -> float:
    """The ratio at or above which a URL passes: least balanced error on labelled URLs, by a histogram of fixed size."""
    bins = labelled.select("ruled", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("ratio") + 10) * (BINS / 20)))).alias("bin"))
    found = np.zeros((2, BINS))
    for r in bins.groupBy("ruled", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        found[int(r["ruled"] == "allow"), int(r["bin"])] = r["n"]
    blocked, allowed = found
    if not blocked.sum() or not allowed.sum():
        return 0.0
    # Error at each edge: blocked URLs at or above it, allowed ones below.
    over = 1 - np.concatenate([[0], np.cumsum(blocked)]) / blocked.sum()
    under = np.concatenate([[0], np.cumsum(allowed)]) / allowed.sum()
    error = over + under
    best = np.flatnonzero(error == error.min())
    return float(best[len(best) // 2] * (20 / BINS) - 10)


def judge(pages: DataFrame, *, rules: tuple = RULES, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) of each row of ``pages`` (page_id, url).

    The verdict is the rule's, else the models': allow where the ratio reaches the threshold.  Where the rules label URLs
    of one class only, the others get that class; where they label none, all are allowed.  A null or empty url fits no rule
    and is scored as an empty text.  page_id may be null or repeat.
    """
    rows = apply_rules(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    labelled = rows.filter("ruled is not null")
    classes = {r["ruled"] for r in labelled.select("ruled").distinct().collect()}
    if len(classes) < 2:
        other = F.lit(next(iter(classes), "allow"))
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), F.lit(0.0).alias("ratio"))
    kept_back = F.coalesce(F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0, F.lit(False))
    # Written: a block must hold the same URLs whenever it is read.
    rows = shared.written(blocks(rows.withColumn("kept_back", kept_back)), "urls")
    counts = shared.written(count(rows.filter("ruled is not null"), order=order), "counts")
    rows = shared.written(scored(rows, counts, order=order, weight=weight), "ratios")
    # The threshold is found by the model without the URLs kept back; the final one knows them too.
    edge = calibrate(rows.filter("ruled is not null and kept_back").select("ruled", F.col("ratio_part").alias("ratio")))
    verdict = F.coalesce("ruled", F.when(F.col("ratio") >= edge, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
