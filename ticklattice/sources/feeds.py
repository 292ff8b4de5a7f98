"""Sources and layers of a feed: raw messages to typed rows, vendor payloads, CSV files, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: Fields of the messages of each topic; all arrive as strings.
QUOTE_JSON = "symbol string, timestamp string, bid_price string, ask_price string, bid_size string, ask_size string, data_source string"
TRADE_JSON = "symbol string, timestamp string, price string, size string, trade_id string, data_source string"
BAR_JSON = "symbol string, timestamp string, open string, high string, low string, close string, volume string, timeframe string"
TOPIC_JSON = {"quotes": QUOTE_JSON, "trades": TRADE_JSON, "bars": BAR_JSON}

#: Patterns of dates in the order they are tried.
DATE_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy")


def messages(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Messages (topic, key, value) with JSON values of trades and quotes: what a producer sends, keyed by symbol."""
    t = trades.select(F.lit("trades").alias("topic"), c("symbol").alias("key"), F.to_json(F.struct(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), c("price").cast("string").alias("price"), c("size").cast("string").alias("size"),
        c("trade_id").cast("string").alias("trade_id"))).alias("value"))
    q = quotes.select(F.lit("quotes").alias("topic"), c("symbol").alias("key"), F.to_json(F.struct(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), c("bid").cast("string").alias("bid_price"), c("ask").cast("string").alias("ask_price"),
        c("bid_size").cast("string").alias("bid_size"), c("ask_size").cast("string").alias("ask_size"))).alias("value"))
    return t.unionByName(q)


#: Columns of a message source that stay beside what is parsed, where they are there.
SOURCE = ("partition", "offset", "kafka_timestamp")


def bronze(raw: DataFrame, *, job: str = "bronze", ingested: Column | None = None) -> DataFrame:
    """Messages parsed by topic into one wide row of strings, with flags, score, date parts, and who took them in when.

    Each topic has its own schema; fields of one name come together.  ``raw`` keeps its columns, those of SOURCE among them;
    ``ingested`` is the time of intake (now, if not given).
    """
    # Parsed by a generator of one row, so that later filters on what is parsed stay behind it and don't parse each message again.
    topics = F.struct(*[F.when(c("topic") == t, F.from_json("value", s)).alias(t) for t, s in TOPIC_JSON.items()])
    parsed = raw.select("*", F.explode(F.array(topics)).alias("__parsed"))
    fields: dict[str, list[Column]] = {}
    for t, s in TOPIC_JSON.items():
        for f in (x.split()[0] for x in s.split(", ")):
            fields.setdefault(f, []).append(c(f"__parsed.{t}.{f}"))
    out = parsed.select(*raw.columns, *[F.coalesce(*x).alias(f) for f, x in fields.items()], F.md5("value").alias("content_hash"))
    ts = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    ok_symbol = F.coalesce(F.length(F.trim("symbol")) > 0, F.lit(False))
    score = (ok_symbol.cast("double") + ts.isNotNull().cast("double")) / 2
    return out.select(
        "*", ok_symbol.alias("has_valid_symbol"), ts.isNotNull().alias("has_valid_timestamp"), score.alias("quality_score"), (score >= 0.8).alias("is_high_quality"),
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"),
        (F.current_timestamp() if ingested is None else ingested).alias("ingestion_timestamp"), F.lit(job).alias("ingestion_job"),
    )


def silver(rows: DataFrame, *, job: str = "silver", processed: Column | None = None, version: str = "1.0") -> DataFrame:
    """Bronze rows of high quality, typed and enriched: mid, spread, time features, flags and overall score, and the run's metadata.

    ``record_id`` is a hash of the message's place in its topic (of its content where the source names no place), so a record that
    is processed again keeps its id.
    """
    place = [c(x).cast("string") for x in ("topic", "partition", "offset") if x in rows.columns]
    record = F.sha2(F.concat_ws("|", *(place if len(place) == 3 else [c("topic"), c("content_hash")])), 256).alias("record_id")
    number = lambda n: F.regexp_replace(n, "[^0-9.-]", "").try_cast("decimal(18,8)")
    t = rows.filter("is_high_quality").select(
        "topic", F.upper(F.trim("symbol")).alias("symbol"), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        *[number(n).cast("double").alias(n) for n in ("price", "bid_price", "ask_price")], F.coalesce("size", "volume").try_cast("double").cast("long").alias("volume"), "content_hash", *[x for x in SOURCE if x in rows.columns], record,
    )
    mid = (c("bid_price") + c("ask_price")) / 2
    spread = c("ask_price") - c("bid_price")
    t = t.select(
        "*", mid.alias("mid_price"), spread.alias("spread"), F.when(c("bid_price") > 0, F.try_divide(spread, mid) * 100).alias("spread_pct"), F.when(c("bid_price") > 0, F.try_divide(spread, mid) * 10000).alias("spread_bps"),
        F.hour("ts").alias("hour_of_day"), F.dayofweek("ts").alias("day_of_week"), F.hour("ts").between(9, 16).alias("is_market_hours"),
    )
    flags = {"is_valid_price": F.coalesce(F.coalesce("price", "mid_price").between(0.01, 100000), F.lit(False)), "is_valid_volume": F.coalesce(c("volume") >= 0, F.lit(True)), "is_valid_spread": F.coalesce(c("spread_pct") <= 10, F.lit(True))}
    t = t.select("*", *[v.alias(k) for k, v in flags.items()])
    score = sum((c(k).cast("double") for k in flags), F.lit(0.0)) / len(flags)
    done = F.current_timestamp() if processed is None else processed
    return t.select("*", score.alias("overall_score"), (score >= 0.8).alias("is_silver_quality"), done.alias("silver_processed_timestamp"), F.lit(job).alias("silver_job_id"), F.lit(version).alias("data_version"))


def market_session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(F.weekday(ts) >= 5, "closed").when((h >= 9) & (h < 16), "regular").when((h >= 4) & (h < 9), "pre_market").otherwise("after_hours")


def detect_date_pattern(rows: DataFrame, column: str) -> DataFrame:
    """(pattern, parsed, total) of every known pattern, in one aggregation."""
    names = [f"p{k}" for k in range(len(DATE_PATTERNS))]
    one = rows.agg(F.count(column).alias("total"), *[F.count(F.try_to_timestamp(column, F.lit(p))).alias(n) for n, p in zip(names, DATE_PATTERNS, strict=True)])
    long = one.unpivot("total", names, "n", "parsed")
    pattern = F.element_at(F.array(*map(F.lit, DATE_PATTERNS)), F.substring("n", 2, 2).cast("int") + 1)
    return long.select(pattern.alias("pattern"), "parsed", "total")


def infer_types(rows: DataFrame) -> DataFrame:
    """(column, type) of a table of strings: the first of integer, decimal, datetime, boolean that all values fit."""
    kinds = {"integer": lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"), "decimal": lambda x: x.try_cast("double").isNotNull(), "datetime": lambda x: x.try_cast("timestamp").isNotNull(), "boolean": lambda x: F.lower(x).isin("true", "false")}
    one = rows.agg(*[F.coalesce(F.bool_and(test(c(n))), F.lit(False)).alias(f"{n}\x1f{k}") for n in rows.columns for k, test in kinds.items()])
    pick = lambda n: F.coalesce(*[F.when(c(f"`{n}\x1f{k}`"), k) for k in kinds], F.lit("string"))
    return one.select(*[pick(n).alias(n) for n in rows.columns]).unpivot([], rows.columns, "column", "type")


def classify_header(columns: list[str]) -> str:
    """Kind of the rows of a file by its header: bars first, for they have a volume too."""
    have = {x.lower() for x in columns}
    if {"open", "high", "low", "close"} <= have:
        return "bar"
    if have & {"bid", "bid_price"} and have & {"ask", "ask_price"}:
        return "quote"
    return "trade" if have & {"price", "trade_price", "last", "last_price"} else "unknown"


ALIASES = {
    "price": ("price", "trade_price", "last_price", "last"), "size": ("size", "volume", "quantity"), "symbol": ("symbol", "ticker"), "ts": ("timestamp", "ts", "datetime", "time"),
    "bid": ("bid", "bid_price"), "ask": ("ask", "ask_price"),
}


def with_aliases(rows: DataFrame) -> DataFrame:
    """Columns under their one name, from the aliases that the file has."""
    have = {x.lower(): x for x in rows.columns}
    found = {n: [c(have[a]) for a in names if a in have] for n, names in ALIASES.items()}
    return rows.select(*[F.coalesce(*x).alias(n) for n, x in found.items() if x], *[c(x) for x in rows.columns if x.lower() not in {a for v in ALIASES.values() for a in v}])


def read_csv(spark: SparkSession, path: str, schema: str, *, most_bad: int | None = None, **options: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of CSV files (a file, folder or pattern; gzip by name), and those with a field that its type doesn't hold.

    Bad rows come as (record: JSON, errors: names of the fields); more of them than ``most_bad`` raise.
    """
    fields = [x.strip().split(None, 1) for x in schema.split(",")]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n, _ in fields), header=True, **options)
    errors = F.array_compact(F.array(*[F.when(c(n).isNotNull() & c(n).try_cast(t).isNull(), F.lit(n)) for n, t in fields]))
    rows = raw.withColumn("__errors", errors)
    bad = rows.filter(F.size("__errors") > 0).select(F.to_json(F.struct(*[n for n, _ in fields])).alias("record"), c("__errors").alias("errors"))
    if most_bad is not None and (n := bad.limit(most_bad + 1).count()) > most_bad:
        raise ValueError(f"more than {most_bad} bad rows in {path} (at least {n})")
    return rows.filter(F.size("__errors") == 0).select(*[c(n).cast(t).alias(n) for n, t in fields]), bad


def flatten_arrays(payloads: DataFrame) -> DataFrame:
    """Bars from payloads of parallel arrays (timestamp[], open[] ...): entries without a close go, a missing open is the close."""
    schema = "timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<bigint>"
    p = payloads.select("symbol", F.from_json("payload", schema).alias("p"))
    x = p.select("symbol", F.inline(F.arrays_zip("p.timestamp", "p.open", "p.high", "p.low", "p.close", "p.volume")))
    return x.filter("close is not null").select(
        "symbol", F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("ts"), F.round(F.coalesce("open", "close"), 2).alias("open"), F.round("high", 2).alias("high"), F.round("low", 2).alias("low"), F.round("close", 2).alias("close"), "volume"
    )


def flatten_map(payloads: DataFrame) -> DataFrame:
    """Bars from payloads keyed by time with numbered field names."""
    p = payloads.select("symbol", F.explode(F.from_json("payload", "map<string, map<string, string>>")).alias("at", "bar"))
    return p.select("symbol", F.try_to_timestamp("at", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"), c("bar")["1. open"].cast("double").alias("open"), c("bar")["4. close"].cast("double").alias("close"))


def flatten_ticks(payloads: DataFrame) -> DataFrame:
    """Ticks from payloads whose ``data`` is an array of (ev, s, p, v, t in milliseconds); trades only."""
    p = payloads.select(F.explode(F.from_json("payload", "data array<struct<ev:string, s:string, p:double, v:bigint, t:bigint>>").getField("data")).alias("d"))
    return p.filter("d.ev = 'T'").select(c("d.s").alias("symbol"), F.timestamp_millis("d.t").cast("timestamp_ntz").alias("ts"), c("d.p").alias("price"), c("d.v").alias("size"))


def split_dead_letters(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and dead letters of the rest: the row as JSON, why, and how often it was tried."""
    dead = rows.filter(~F.coalesce(ok, F.lit(False))).select(F.to_json(F.struct("*")).alias("record"), F.lit("validation failed").alias("error"), F.lit(0).alias("retries"))
    return rows.filter(ok), dead


def changes_since(rows: DataFrame, batch: int) -> DataFrame:
    """Rows written after a batch, for a consumer that has seen it."""
    return rows.filter(c("_batch_id") > batch)


def kafka_source(spark: SparkSession, servers: str, topics: list[str], **options: str) -> DataFrame:
    """A stream of messages; needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    reader = reader.option("startingOffsets", "latest").option("failOnDataLoss", "false").option("maxOffsetsPerTrigger", "10000")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select("topic", c("key").cast("string").alias("key"), c("value").cast("string").alias("value"), c("timestamp").alias("kafka_timestamp"))
