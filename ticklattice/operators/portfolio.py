"""Portfolios from transactions: positions, weights, risk, rebalancing, lots and alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklattice.functions import frames, scan

c = F.col
ANNUAL = math.sqrt(252)


def positions(transactions: DataFrame) -> DataFrame:
    """Shares bought less sold and the average cost of what was bought, per user and symbol, where shares are left."""
    buy = F.when(c("type") == "BUY", c("qty")).otherwise(0.0)
    one = transactions.groupBy("user", "symbol").agg(
        F.sum(F.when(c("type") == "BUY", c("qty")).otherwise(-c("qty"))).alias("shares"), F.try_divide(F.sum(buy * c("price")), F.sum(buy)).alias("avg_cost"), F.max("date").alias("last_date")
    )
    return one.filter("shares > 0")


def valued(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with market value, cost, gain and weight; a missing price is the average cost.  ``prices``: (symbol, price, sector)."""
    p = held.join(prices.withColumnRenamed("symbol", "__s"), c("symbol") == c("__s"), "left").drop("__s")
    price = F.coalesce("price", "avg_cost")
    p = p.select("user", "symbol", "shares", "avg_cost", F.coalesce("sector", F.lit("Other")).alias("sector"), (c("shares") * price).alias("market_value"), (c("shares") * c("avg_cost")).alias("cost_basis"))
    gain = c("market_value") - c("cost_basis")
    return p.select("*", gain.alias("gain"), (F.try_divide(gain, "cost_basis") * 100).alias("gain_pct"), (F.try_divide("market_value", F.sum("market_value").over(Window.partitionBy("user"))) * 100).alias("weight"))


def summary(values: DataFrame) -> DataFrame:
    one = values.groupBy("user").agg(F.count(F.lit(1)).alias("positions"), F.sum("market_value").alias("total_value"), F.sum("cost_basis").alias("total_cost"), F.max("weight").alias("largest_weight"), F.sum(F.pow(c("weight") / 100, 2)).alias("herfindahl"))
    return one.select("*", (c("total_value") - c("total_cost")).alias("gain"), (F.try_divide(c("total_value") - c("total_cost"), "total_cost") * 100).alias("gain_pct"))


def allocation(values: DataFrame) -> DataFrame:
    one = values.groupBy("user", "sector").agg(F.sum("market_value").alias("value"))
    return one.withColumn("percentage", F.try_divide("value", F.sum("value").over(Window.partitionBy("user"))) * 100)


def risk(returns: DataFrame, *, key: str = "symbol", rf: float = 0.02) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, maximum drawdown and 95 % value at risk of (key, ts, ret, close).

    The drawdown is of the close against its running maximum.
    """
    top = scan.running_sums(returns, {"__top": c("close").cast("double")}, key=key, greatest=True)
    r = top.withColumn("__dd", F.try_divide(c("close"), c("__top")) - 1)
    one = r.groupBy(key).agg(
        (F.avg("ret") * 252).alias("annual_return"), (F.stddev_samp("ret") * ANNUAL).alias("annual_volatility"), (F.stddev_samp(F.when(c("ret") < 0, c("ret"))) * ANNUAL).alias("downside"),
        F.min("__dd").alias("max_drawdown"), F.percentile("ret", F.lit(0.05)).alias("var_95"),
    )
    return one.select(key, "annual_return", "annual_volatility", F.try_divide(c("annual_return") - rf, "annual_volatility").alias("sharpe"), F.try_divide(c("annual_return") - rf, "downside").alias("sortino"), "max_drawdown", "var_95")


def against_benchmark(rows: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Beta, correlation, tracking error and information ratio of ret against market."""
    d = c("ret") - c("market")
    one = rows.groupBy(key).agg(F.regr_slope("ret", "market").alias("beta"), F.corr("ret", "market").alias("correlation"), (F.stddev_samp(d) * ANNUAL).alias("tracking_error"), (F.avg(d) * 252).alias("active_return"))
    return one.withColumn("information_ratio", F.try_divide("active_return", "tracking_error"))


def rebalance(values: DataFrame, targets: DataFrame, *, least: float = 2.0, cost: float = 0.001) -> DataFrame:
    """Trades that bring sector weights to ``targets`` (sector, target): where they differ by more than ``least`` points."""
    now = allocation(values)
    users = now.groupBy(c("user").alias("u")).agg(F.sum("value").alias("total"))
    # Every user meets every target: targets are a fixed small table.
    want = users.crossJoin(F.broadcast(targets))
    both = want.join(now, (c("u") == c("user")) & (want.sector == now.sector), "left").select(c("u").alias("user"), want.sector.alias("sector"), "total", "target", F.coalesce("percentage", F.lit(0.0)).alias("current"))
    gap = c("target") - c("current")
    return both.filter(F.abs(gap) > least).select(
        "user", "sector", "current", "target", F.when(gap > 0, "BUY").otherwise("SELL").alias("action"), (F.abs(gap) / 100 * c("total")).alias("value"), (F.abs(gap) / 100 * c("total") * cost).alias("cost")
    )


def tax_lots(transactions: DataFrame, as_of: str) -> DataFrame:
    """FIFO lots that are left per user and symbol at ``as_of``, with holding term and what they cost.

    Running sums of bought and sold shares place each lot against all that was sold: no loop over sales.
    """
    keys = ("user", "symbol")
    w = Window.partitionBy(*keys).orderBy("date", "tx_id").rowsBetween(Window.unboundedPreceding, 0)
    sold = transactions.filter("type = 'SELL'").groupBy(*[c(k).alias(f"__{k}") for k in keys]).agg(F.sum("qty").alias("sold"))
    lots = transactions.filter("type = 'BUY'").withColumn("upto", F.sum("qty").over(w))
    lots = lots.join(sold, (c("user") == c("__user")) & (c("symbol") == c("__symbol")), "left")
    left = F.greatest(F.lit(0.0), F.least(c("qty"), c("upto") - F.coalesce("sold", F.lit(0.0))))
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date("date"))
    return lots.withColumn("left", left).filter("left > 0").select("user", "symbol", "tx_id", "date", "left", (c("left") * c("price")).alias("cost"), F.when(days > 365, "long").otherwise("short").alias("term"))


def drop_flagged_effect(returns: DataFrame) -> DataFrame:
    """What leaving out flagged rows (mask) does to Sharpe, volatility and drawdown of a series (symbol, ts, ret, mask)."""

    def measures(rows: DataFrame, suffix: str) -> DataFrame:
        grown = scan.running_sums(rows, {"__log": F.log1p("ret")})
        top = scan.running_sums(grown, {"__top": c("__log")}, greatest=True)
        r = top.withColumn("__dd", F.exp(c("__log") - c("__top")) - 1)
        one = r.groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.min("__dd").alias(f"drawdown_{suffix}"))
        return one.select("symbol", (F.try_divide("m", "s") * ANNUAL).alias(f"sharpe_{suffix}"), (c("s") * ANNUAL).alias(f"volatility_{suffix}"), f"drawdown_{suffix}")

    base = returns.filter("ret is not null and ret > -1")
    return measures(base, "all").join(measures(base.filter(~c("mask")), "kept"), "symbol")


def evaluate_alerts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert rows of ``rules`` (rule_id, kind, symbol or null, threshold) over ticks (symbol, ts, trade_id, price, size).

    Kinds: above, below, crosses (the price before was on the other side), volume (times the mean of the last 20), z (of the last 50).
    """
    order = Window.partitionBy("symbol").orderBy("ts", "trade_id")
    w20, w50 = order.rowsBetween(-20, -1), order.rowsBetween(-49, 0)
    made = {
        "prior": F.lag("price").over(order), "mean_size": F.avg("size").over(w20),
        "z": F.abs(F.try_divide(c("price") - F.avg("price").over(w50), F.stddev_samp("price").over(w50))),
    }
    given = rows.select("symbol", "ts", "trade_id", "price", "size")
    r = frames.framed(given, lambda x: x.select("*", *[v.alias(k) for k, v in made.items()]), tie="trade_id", before=50, after=0)
    r = r.select(*given.columns, *made)
    rule = rules.withColumnRenamed("symbol", "rule_symbol")
    met = F.broadcast(rule)  # rules are a fixed small table
    fires = (
        F.when(c("kind") == "above", c("price") > c("threshold")).when(c("kind") == "below", c("price") < c("threshold"))
        .when(c("kind") == "crosses", ((c("prior") < c("threshold")) & (c("price") >= c("threshold"))) | ((c("prior") > c("threshold")) & (c("price") <= c("threshold"))))
        .when(c("kind") == "volume", c("size") > c("mean_size") * c("threshold")).when(c("kind") == "z", c("z") > c("threshold"))
    )
    return r.join(met, c("rule_symbol").isNull() | (c("rule_symbol") == c("symbol"))).filter(fires).select("rule_id", "kind", "symbol", "ts", "trade_id", "price")


def dividend_income(values: DataFrame, dividends: DataFrame) -> DataFrame:
    """Income of the year and yield per user from ``dividends`` (symbol, per_share) on valued positions; none counts as 0."""
    d = dividends.withColumnRenamed("symbol", "__s")
    both = values.join(d, c("symbol") == c("__s"), "left").withColumn("income", c("shares") * F.coalesce("per_share", F.lit(0.0)))
    one = both.groupBy("user").agg(F.sum("income").alias("income"), F.sum("market_value").alias("value"), F.count_if(c("income") > 0).alias("payers"))
    return one.select("user", "income", "payers", (F.try_divide("income", "value") * 100).alias("yield_pct"))


def alert_list(alerts: DataFrame, *, kinds: list[str] | None = None, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """The newest alerts of the kinds and symbol asked for."""
    kept = alerts if kinds is None else alerts.filter(c("kind").isin(kinds))
    kept = kept if symbol is None else kept.filter(c("symbol") == symbol)
    return kept.orderBy(F.desc("ts"), "trade_id", "rule_id").limit(limit)


def rebalance_shares(values: DataFrame, targets: DataFrame, prices: DataFrame, *, band: float = 2.0, fee: float = 0.001) -> DataFrame:
    """Trades of each user's positions that bring weights to ``targets`` (user, symbol, target in percent; none: sell all).

    Only weights more than ``band`` points off are traded.  Shares come from the price, or the average cost where none is known.
    """
    p = prices.select(c("symbol").alias("__s"), "price")
    t = targets.select(c("user").alias("__u"), c("symbol").alias("__t"), "target")
    rows = values.join(p, c("symbol") == c("__s"), "left").join(t, (c("user") == c("__u")) & (c("symbol") == c("__t")), "left")
    total = F.sum("market_value").over(Window.partitionBy("user"))
    off = c("weight") - F.coalesce("target", F.lit(0.0))
    rows = rows.select("user", "symbol", "weight", F.coalesce("target", F.lit(0.0)).alias("target"), off.alias("__off"), total.alias("__total"), F.coalesce("price", "avg_cost").alias("__price"))
    value = F.abs("__off") / 100 * c("__total")
    return rows.filter(F.abs("__off") > band).select(
        "user", "symbol", "weight", "target", F.when(c("__off") > 0, "SELL").otherwise("BUY").alias("action"), F.try_divide(value, c("__price")).alias("shares"), value.alias("value"), (value * fee).alias("cost")
    )


def _met(value: Column, prior: Column, rules: dict[str, Column]) -> Column:
    """Whether a rule's condition (above, below, crosses) holds for a value and the one before."""
    condition, threshold = rules["condition"], rules["threshold"]
    crosses = ((prior < threshold) & (value >= threshold)) | ((prior > threshold) & (value <= threshold))
    return F.when(condition == "above", value > threshold).when(condition == "below", value < threshold).when(condition == "crosses", crosses)


def indicator_alerts(rows: DataFrame, rules: list[tuple], indicators: list[str]) -> DataFrame:
    """Alerts of ``rules`` (rule_id, indicator, symbol or None, condition, threshold) over (symbol, ts, one column an indicator).

    Conditions: above, below, crosses (the bar before was on the other side).  An indicator that is null fires nothing.
    """
    spark = rows.sparkSession
    order = Window.partitionBy("symbol").orderBy("ts")
    # The bar before travels with its bar, by blocks of a series.
    held = frames.framed(rows.select("symbol", "ts", *indicators), lambda r: r.select("*", *[F.lag(x).over(order).alias(f"__{x}") for x in indicators]), before=1, after=0)
    table = spark.createDataFrame(rules, "rule_id int, indicator string, rule_symbol string, condition string, threshold double")
    each = F.array(*[F.struct(F.lit(x).alias("indicator"), c(x).cast("double").alias("value"), c(f"__{x}").cast("double").alias("prior")) for x in indicators])
    long = held.select("symbol", "ts", F.explode(each).alias("e")).select("symbol", "ts", "e.value", "e.prior", c("e.indicator").alias("__of"))
    both = long.join(F.broadcast(table), (c("__of") == c("indicator")) & (c("rule_symbol").isNull() | (c("rule_symbol") == c("symbol"))))  # a row a rule
    return both.filter(_met(c("value"), c("prior"), {x: c(x) for x in ("condition", "threshold")})).select("rule_id", "indicator", "symbol", "ts", "value")


def portfolio_alerts(summaries: DataFrame, rules: list[tuple]) -> DataFrame:
    """Alerts of ``rules`` (rule_id, metric, condition above or below, threshold) over one row of metrics a user."""
    spark = summaries.sparkSession
    metrics = sorted({r[1] for r in rules})
    table = spark.createDataFrame(rules, "rule_id int, metric string, condition string, threshold double")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("value")) for m in metrics])
    long = summaries.select("user", F.explode(each).alias("e")).select("user", "e.value", c("e.metric").alias("__of"))
    both = long.join(F.broadcast(table), c("__of") == c("metric"))  # a row a rule
    return both.filter(_met(c("value"), F.lit(None).cast("double"), {x: c(x) for x in ("condition", "threshold")})).select("rule_id", "metric", "user", "value")
