"""Evaluation, splits, portfolios, alerts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.operators import evaluate as E
from ticklattice.operators import portfolio as P
from ticklattice.plans import Queries
from ticklattice.plans.q_detect import FEATURES, LONG, MATRIX, matrix
from ticklattice.plans.q_indicators import Q as INDICATOR_QUERIES
from ticklattice.plans.q_rolling import MARKET, RET, _returns, with_market
from ticklattice.sources import fixtures as X

Q = Queries()
INDICATORS = INDICATOR_QUERIES.sql


def scored(spark, d):
    """Trades as labelled scores: errors are the true class, the price is the score."""
    t = X.trades(spark, d)
    return t.select("symbol", "ts", "trade_id", "price", F.col("price").alias("score"), (F.col("size") % 5 == 0).alias("y"), (F.col("price") > 80).alias("pred"), (F.col("size") > 60).alias("pred_b"))


SCORED = f"{X.TRADES}, sc as (select symbol, ts, trade_id, price, price as score, size % 5 = 0 as y, price > 80 as pred, size > 60 as pred_b from trades)"
_CONF = "count(*) filter (y and pred) as tp, count(*) filter (not y and pred) as fp, count(*) filter (not y and not pred) as tn, count(*) filter (y and not pred) as fn"
_RATES = """(tp + tn) / nullif(tp + fp + tn + fn, 0) as accuracy, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall,
  2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) as f1, tn / nullif(tn + fp, 0) as specificity, tn / nullif(tn + fn, 0) as npv,
  fp / nullif(fp + tn, 0) as fpr, fn / nullif(fn + tp, 0) as fnr"""


@Q.add("ml3_confusion", f"with {SCORED}, k as (select symbol, {_CONF} from sc group by 1) select *, {_RATES} from k")
def confusion(spark, d):
    return E.confusion(scored(spark, d), "symbol")


@Q.add("ml3_labels_confusion", f"""with l as (select source, toxic = 1 as y, n_chars > 3000 as pred from labels join documents using (doc_id)), k as (select source, {_CONF} from l group by 1) select *, {_RATES} from k""")
def labels_confusion(spark, d):
    rows = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return E.confusion(rows.select("source", (F.col("toxic") == 1).alias("y"), (F.col("n_chars") > 3000).alias("pred")), "source")


_CURVE = f"{SCORED}, g as (select score, count(*) filter (y) as pos, count(*) filter (not y) as neg from sc group by 1), cu as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from g window w as (order by score desc rows unbounded preceding))"


@Q.add("ml4_ranking", f"with {_CURVE} select sum(neg * (tp - pos) + neg * pos * 0.5) / nullif(max(p) * max(n), 0) as roc_auc, sum(pos * tp / (tp + fp)) / nullif(max(p), 0) as average_precision from cu")
def ranking(spark, d):
    return E.ranking(scored(spark, d))


_F1 = "coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(p, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(p, 0), 0), 0)"


@Q.add("ml5_thresholds", f"with {_CURVE} select score as threshold, tp / nullif(tp + fp, 0) as precision, tp / nullif(p, 0) as recall, {_F1} as f1 from cu")
def thresholds(spark, d):
    return E.thresholds(scored(spark, d))


@Q.add("ml5_best_threshold", f"with {_CURVE} select {_F1} as f1, score as threshold, tp / nullif(tp + fp, 0) as precision, tp / nullif(p, 0) as recall from cu order by f1 desc, threshold desc limit 1")
def best(spark, d):
    return E.best_threshold(scored(spark, d))


@Q.add("ml5_target_thresholds", f"""with {_CURVE}, t as (select score as threshold, tp / nullif(tp + fp, 0) as precision, tp / nullif(p, 0) as recall from cu)
(select 'precision' as target, * from t where precision >= 0.2 order by recall desc, threshold desc limit 1) union all (select 'recall', * from t where recall >= 0.9 order by precision desc, threshold desc limit 1)""")
def target_thresholds(spark, d):
    return E.target_thresholds(scored(spark, d), precision=0.2, recall=0.9)


@Q.add("ml5_metric_threshold", f"""with {SCORED}, c as (select unnest(quantile_cont(score, [{", ".join(str(k / 100) for k in range(1, 100))}])) as threshold from sc),
k as (select threshold, count(*) filter (y and score >= threshold) as tp, count(*) filter (not y and score >= threshold) as fp, count(*) filter (y) as p, count(*) filter (not y) as n from sc, c group by 1)
select threshold, tp / p - fp / n as score from k order by score desc, threshold limit 1""")
def metric_threshold(spark, d):
    return E.metric_threshold(scored(spark, d), "youden")


@Q.add("ml5_contamination", f"with {SCORED}, q as (select quantile_cont(score, 0.95) as edge from sc) select trade_id, score > edge as is_anomaly from sc, q")
def contamination_threshold(spark, d):
    """The twentieth of the rows with the highest scores."""
    rows = scored(spark, d)
    return rows.select("trade_id", (F.col("score") > F.lit(E.contamination_threshold(rows, 0.05))).alias("is_anomaly"))


@Q.add("sl7_precision_at_k", f"with {SCORED} select avg(cast(y as integer)) as precision_at_k from (select y from sc order by score desc, trade_id limit 100)")
def precision_at_k(spark, d):
    return E.precision_at_k(scored(spark, d), 100, tie="trade_id")


O = "partition by symbol order by ts, trade_id"  # noqa: E741


@Q.add("j8_coverage", f"with {SCORED}, n as (select *, max(cast(pred as integer)) over ({O} rows between 5 preceding and 5 following) = 1 as near from sc) select symbol, avg(cast(near as integer)) as coverage, count(*) as anomalies from n where y group by 1")
def coverage(spark, d):
    return E.coverage(scored(spark, d))


@Q.add("j9_detection_delay", f"""with {SCORED}, r as (select *, row_number() over ({O}) as pos, y and not coalesce(lag(y) over ({O}), false) as starts, case when y <> coalesce(lag(y) over ({O}), false) then 1 else 0 end as ch from sc),
s as (select *, sum(ch) over ({O}) as segment, case when pred then pos end as hit from r),
m as (select *, min(hit) over (partition by symbol, segment) as a, min(hit) over ({O} rows between current row and 49 following) as b from s)
select symbol, trade_id, cast(a - pos as integer) as delay_segment, cast(b - pos as integer) as delay_horizon from m where starts""")
def delay(spark, d):
    return E.detection_delay(scored(spark, d))


_R30 = f"({O} rows between 29 preceding and current row)"


@Q.add("ml6_rolling_metrics", f"""with {SCORED} select symbol, trade_id, sum(cast(y and pred as integer)) over w / nullif(sum(cast(pred as integer)) over w, 0) as precision, sum(cast(y and pred as integer)) over w / nullif(sum(cast(y as integer)) over w, 0) as recall,
  pred = lag(pred) over ({O}) as consistent from sc window w as {_R30}""")
def rolling_metrics(spark, d):
    return E.rolling_metrics(scored(spark, d))


def _erfc(x: str) -> str:
    """Complementary error function of ``x`` >= 0 (nothing is left beyond 6): a series of positive terms, from the last one inwards."""
    x = f"least({x}, 6.0)"
    return f"""greatest(0.0, 1 - 2 / sqrt(pi()) * {x} * exp(-1 * ({x}) * ({x})) * list_reduce(list_prepend(cast(1 as double), list_reverse(list_transform(range(1, 200), lambda k: cast(k as double)))),
      lambda acc, k: 1 + acc * 2 * ({x}) ** 2 / (2 * k + 1)))"""


@Q.add("ml8_mcnemar", f"""with {SCORED}, k as (select count(*) filter (pred = y and pred_b = y) as both, count(*) filter (pred = y and pred_b <> y) as only_a, count(*) filter (pred <> y and pred_b = y) as only_b, count(*) filter (pred <> y and pred_b <> y) as neither from sc)
select *, (abs(only_a - only_b) - 1) ** 2 / nullif(only_a + only_b, 0) as chi_square,
  case when only_a + only_b <= 10000 then least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
    lambda j: exp(lgamma(only_a + only_b + 1) - lgamma(j + 1) - lgamma(only_a + only_b - j + 1) - (only_a + only_b) * ln(2)))))
  else {_erfc("sqrt((abs(only_a - only_b) - 1) ** 2 / (only_a + only_b) / 2)")} end as p_value from k""")
def mcnemar(spark, d):
    return E.mcnemar(scored(spark, d), "pred", "pred_b")


@Q.add("ml8_mann_whitney", f"""with {_CURVE}, u as (select sum(neg * (tp - pos) + neg * pos * 0.5) as u, cast(max(p) as bigint) as n1, cast(max(n) as bigint) as n2, sum(cast(pos + neg as double) ** 3 - (pos + neg)) as ties from cu),
s as (select *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(cast(n1 as double) * n2 / 12 * (n1 + n2 + 1 - ties / (cast(n1 + n2 as double) * (n1 + n2 - 1)))) as cz from u)
select u, n1, n2, (u - n1 * n2 / 2) / nullif(sqrt(cast(n1 as double) * n2 * (n1 + n2 + 1) / 12), 0) as z, {_erfc("greatest(cz, 0.0) / sqrt(2)")} as p_value from s""")
def mann_whitney(spark, d):
    return E.mann_whitney(scored(spark, d))


@Q.add("ml8_wilcoxon", f"""with {X.bars_sql()}, d as (select open - close as d from bars where open - close <> 0),
g as (select abs(d) as size, count(*) filter (d > 0) as up, count(*) as t from d group by 1),
r as (select *, sum(t) over (order by size rows unbounded preceding) - (t - 1) / 2.0 as rank from g),
w as (select cast(sum(t) as bigint) as n, cast(sum(rank * up) as double) as w_plus, cast(sum(rank * (t - up)) as double) as w_minus, sum(cast(t as double) ** 3 - t) as ties from r),
z as (select *, (w_plus - cast(n as double) * (n + 1) / 4) / sqrt(cast(n as double) * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from w)
select n, w_plus, w_minus, z, {_erfc("abs(z) / sqrt(2)")} as p_value from z""")
def wilcoxon(spark, d):
    return E.wilcoxon(X.bars(spark, d), "open", "close")


@Q.add("ml8_paired_t", f"with {X.bars_sql()} select count(*) as n, avg(open - close) as mean_difference, avg(open - close) / nullif(stddev_samp(open - close) / sqrt(count(*)), 0) as t from bars")
def paired_t(spark, d):
    return E.paired_t(X.bars(spark, d), "open", "close")


_POS = f"{X.TRADES}, po as (select *, row_number() over (order by ts, trade_id) as position, count(*) over () as n from trades)"
_SPLIT = "case when position <= floor(n * 0.7) then 'train' when position <= floor(n * 0.85) then 'validation' else 'test' end"


@Q.add("ml1_time_split", f"with {_POS} select trade_id, position, {_SPLIT} as split from po")
def time_split(spark, d):
    return E.time_split(X.trades(spark, d)).select("trade_id", "position", "split")


@Q.add("ml1_time_folds", f"""with {_POS}, pa as (select *, least(floor((position - 1) / floor(n / 6)), 5) as part from po), f as (select * from pa, (values (1), (2), (3), (4), (5)) v(fold) where part <= fold)
select fold, case when part = fold then 'test' else 'train' end as role, count(*) as n, min(position) as first_row, max(position) as last_row from f group by 1, 2""")
def time_folds(spark, d):
    rows = E.time_split(X.trades(spark, d)).select("trade_id", "position")
    return E.time_folds(rows).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_row"), F.max("position").alias("last_row"))


@Q.add("ml2_scaling", f"""with {LONG}, s as (select k, avg(x) as m, stddev_pop(x) as sd, min(x) as lo, max(x) as hi, quantile_cont(x, 0.5) as med, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from long group by 1)
select vec_id, 'f' || k as feature, (x - m) / nullif(sd, 0) as standard, (x - lo) / nullif(hi - lo, 0) as minmax, (x - med) / nullif(q3 - q1, 0) as robust from long join s using (k)""")
def scaling(spark, d):
    kinds = ("standard", "minmax", "robust")
    wide = E.scale(matrix(spark, d), FEATURES)
    scaled = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}_{k}").alias(k) for k in kinds]) for f in FEATURES])
    return wide.select("vec_id", F.explode(scaled).alias("s")).select("vec_id", "s.*")


@Q.add("a20_correlation_matrix", f"with {LONG} select 'f' || p.k as a, 'f' || q.k as b, corr(p.x, q.x) as corr from long p join long q on p.vec_id = q.vec_id and p.k < q.k group by p.k, q.k")
def correlation_matrix(spark, d):
    return E.correlations(matrix(spark, d), FEATURES)


@Q.add("a21_variance", f"with {LONG} select 'f' || k as feature, var_samp(x) as variance, var_samp(x) < 0.01 as low_variance from long group by k")
def variance(spark, d):
    one = matrix(spark, d).agg(*[F.var_samp(f).alias(f) for f in FEATURES])
    return one.unpivot([], FEATURES, "feature", "variance").withColumn("low_variance", F.col("variance") < 0.01)


@Q.add("a22_histogram", f"""with {X.TRADES}, e as (select min(price) as lo, max(price) as hi from trades)
select symbol, cast(least(floor((price - lo) / nullif(hi - lo, 0) * 20), 19) as integer) as bin, count(*) as n, avg(price) as mean, stddev_samp(price) as std from trades, e group by 1, 2""")
def histogram(spark, d):
    t = X.trades(spark, d)
    e = t.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    bin_ = F.least(F.floor(F.try_divide(F.col("price") - F.col("lo"), F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("int")
    return t.crossJoin(F.broadcast(e)).groupBy("symbol", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"))


@Q.add("a12_metric_summary", f"""with {X.TRADES}, r as (select *, row_number() over (partition by symbol order by price, trade_id) as rn, count(*) over (partition by symbol) as n from trades)
select symbol, count(*) as count, min(price) as min, max(price) as max, avg(price) as mean, quantile_cont(price, 0.5) as median, stddev_samp(price) as std, arg_max(price, (ts, trade_id)) as latest,
  max(price) filter (rn = least(cast(floor(0.95 * n) as bigint) + 1, n)) as p95, max(price) filter (rn = least(cast(floor(0.99 * n) as bigint) + 1, n)) as p99 from r group by 1""")
def metric_summary(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol")
    r = X.trades(spark, d).select("*", F.row_number().over(w.orderBy("price", "trade_id")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    rank = lambda p: F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * p) + 1, F.col("n")), F.col("price")))
    return r.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("count"), F.min("price").alias("min"), F.max("price").alias("max"), F.avg("price").alias("mean"), F.percentile("price", F.lit(0.5)).alias("median"), F.stddev_samp("price").alias("std"),
        F.max_by("price", F.struct("ts", "trade_id")).alias("latest"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )


@Q.add("ml7_bootstrap")
def bootstrap(spark, d):
    return E.bootstrap(scored(spark, d))


@Q.add("ml9_backtest", f"""with {SCORED}, p as (select *, cast(floor((row_number() over (order by ts, trade_id) - 1) / 500) as integer) as part from sc), s as (select part, count(*) as n, sum(price) as s, sum(price * price) as q from p group by 1),
e as (select part, sum(n) over w as n, sum(s) over w as s, sum(q) over w as q from s window w as (order by part rows between unbounded preceding and 1 preceding)),
k as (select part, s / n as m, sqrt((q - s * s / n) / (n - 1)) as sd from e where n > 1), c as (select p.part, p.y, coalesce(abs(price - m) > sd, false) as pred from p join k using (part)),
f as (select part, count(*) filter (y and pred) as tp, count(*) filter (not y and pred) as fp, count(*) filter (y and not pred) as fn from c group by 1),
g as (select part, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) as f1 from f)
select *, coalesce(f1 < lag(f1) over (order by part) * 0.9, false) as degraded from g""")
def backtest(spark, d):
    rows = E.time_split(scored(spark, d))
    return E.backtest(rows)


@Q.add("ml9_backtest_summary", f"""with b as ({Q.sql["ml9_backtest"]}), k as (select part, coalesce(f1, 0) as f1, coalesce(precision, 0) as precision, coalesce(recall, 0) as recall, degraded from b),
s as (select count(*) as parts, avg(f1) as mean_f1, stddev_pop(f1) as std_f1, min(f1) as min_f1, max(f1) as max_f1, avg(precision) as mean_precision, avg(recall) as mean_recall, corr(part, f1) as r, count(*) filter (degraded) as alerts from k)
select * exclude (r), case when parts < 3 then 'insufficient_data' when r > 0.1 then 'improving' when r < -0.1 then 'declining' else 'stable' end as trend,
  case when mean_f1 > 0 then 1 - std_f1 / mean_f1 else 0 end as stability from s""")
def backtest_summary(spark, d):
    return E.backtest_summary(backtest(spark, d))


@Q.add("ml2_inverse", f"with {MATRIX} select vec_id, " + ", ".join(FEATURES) + " from matrix")
def inverse_scaling(spark, d):
    """Scaled and scaled back, by each kind in turn over the features."""
    m = matrix(spark, d)
    params = E.scale_params(m, FEATURES)
    scaled = E.scale(m, FEATURES, params)
    kinds = ("standard", "minmax", "robust")
    for k, kind in enumerate(kinds):
        scaled = E.unscale(scaled, {f: params[f] for f in FEATURES[k :: len(kinds)]}, kind)
    return scaled.select("vec_id", *[F.col(f"{f}_back").alias(f) for f in FEATURES])


# Portfolios.


def prices(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("sector"))


POSITIONS = X.TRANSACTIONS + """, po as (select user_id, symbol, sum(case when type = 'BUY' then qty else -qty end) as shares, sum(case when type = 'BUY' then qty * price end) / nullif(sum(case when type = 'BUY' then qty end), 0) as avg_cost, max(date) as last_date
  from transactions group by 1, 2 having sum(case when type = 'BUY' then qty else -qty end) > 0)"""
VALUED = POSITIONS + """, va0 as (select user_id, symbol, shares, avg_cost, coalesce(p_brand, 'Other') as sector, shares * coalesce(p_retailprice, avg_cost) as market_value, shares * avg_cost as cost_basis from po left join part on p_partkey = symbol),
va as (select *, market_value - cost_basis as gain, (market_value - cost_basis) / nullif(cost_basis, 0) * 100 as gain_pct, market_value / nullif(sum(market_value) over (partition by user_id), 0) * 100 as weight from va0)"""


def valued(spark, d):
    return P.valued(P.positions(X.transactions(spark, d)), prices(spark, d))


@Q.add("pr5_positions", f"with {POSITIONS} select user_id as \"user\", symbol, shares, avg_cost, last_date from po")
def positions(spark, d):
    return P.positions(X.transactions(spark, d))


@Q.add("pr1_j6_valued_positions", f"with {VALUED} select user_id as \"user\", * exclude (user_id) from va")
def valued_positions(spark, d):
    return valued(spark, d)


@Q.add("a10_pr3_summary", f"""with {VALUED} select user_id as "user", count(*) as positions, sum(market_value) as total_value, sum(cost_basis) as total_cost, max(weight) as largest_weight, sum((weight / 100) ** 2) as herfindahl,
sum(market_value) - sum(cost_basis) as gain, (sum(market_value) - sum(cost_basis)) / nullif(sum(cost_basis), 0) * 100 as gain_pct from va group by 1""")
def summary(spark, d):
    return P.summary(valued(spark, d))


_ALLOC = VALUED + ", al as (select user_id, sector, sum(market_value) as value from va group by 1, 2)"


@Q.add("a9_allocation", f"with {_ALLOC} select user_id as \"user\", sector, value, value / nullif(sum(value) over (partition by user_id), 0) * 100 as percentage from al")
def allocation(spark, d):
    return P.allocation(valued(spark, d))


@Q.add("pr4_rebalance", f"""with {_ALLOC}, u as (select user_id, sum(value) as total from al group by 1), t(sector, target) as (values ('Brand#1', 50.0), ('Brand#2', 30.0), ('Brand#3', 20.0)),
b as (select u.user_id, t.sector, u.total, t.target, coalesce(al.value / nullif(u.total, 0) * 100, 0) as current from u cross join t left join al on al.user_id = u.user_id and al.sector = t.sector)
select user_id as "user", sector, current, target, case when target > current then 'BUY' else 'SELL' end as action, abs(target - current) / 100 * total as value, abs(target - current) / 100 * total * 0.001 as cost from b where abs(target - current) > 2""")
def rebalance(spark, d):
    targets = spark.createDataFrame([("Brand#1", 50.0), ("Brand#2", 30.0), ("Brand#3", 20.0)], "sector string, target double")
    return P.rebalance(valued(spark, d), targets)


@Q.add("pr4_rebalance_shares", f"""with {VALUED}, t as (select user_id, symbol, 100.0 / count(*) over (partition by user_id) as target, count(*) over (partition by user_id) as n from va),
b as (select va.user_id, va.symbol, weight, case when va.symbol % 10 = 0 then 0.0 else target end as target, sum(market_value) over (partition by va.user_id) as total, coalesce(p_retailprice, avg_cost) as price
  from va join t using (user_id, symbol) left join part on p_partkey = va.symbol)
select user_id as "user", symbol, weight, target, case when weight > target then 'SELL' else 'BUY' end as action, abs(weight - target) / 100 * total / nullif(price, 0) as shares, abs(weight - target) / 100 * total as value,
  abs(weight - target) / 100 * total * 0.001 as cost from b where abs(weight - target) > 2""")
def rebalance_shares(spark, d):
    """Equal weights, but none of every tenth symbol."""
    from pyspark.sql import Window

    held = valued(spark, d)
    share = 100.0 / F.count(F.lit(1)).over(Window.partitionBy("user"))
    targets = held.select("user", "symbol", share.alias("target")).filter(F.col("symbol") % 10 != 0)
    return P.rebalance_shares(held, targets, prices(spark, d))


_SQ = 15.874507866387544


@Q.add("pr2_risk", f"""with {X.bars_sql()}{RET}, m as (select *, close / max(close) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from x),
a as (select symbol, avg(ret) * 252 as annual_return, stddev_samp(ret) * {_SQ} as annual_volatility, stddev_samp(ret) filter (ret < 0) * {_SQ} as down, min(dd) as max_drawdown, quantile_cont(ret, 0.05) as var_95 from m group by 1)
select symbol, annual_return, annual_volatility, (annual_return - 0.02) / nullif(annual_volatility, 0) as sharpe, (annual_return - 0.02) / nullif(down, 0) as sortino, max_drawdown, var_95 from a""")
def risk(spark, d):
    return P.risk(_returns(spark, d))


@Q.add("pr3_benchmark", f"""with {X.bars_sql()}{MARKET} select symbol, regr_slope(ret, market) as beta, corr(ret, market) as correlation, stddev_samp(ret - market) * {_SQ} as tracking_error, avg(ret - market) * 252 as active_return,
avg(ret - market) * 252 / nullif(stddev_samp(ret - market) * {_SQ}, 0) as information_ratio from j group by 1""")
def benchmark(spark, d):
    return P.against_benchmark(with_market(_returns(spark, d)))


@Q.add("pr5_tax_lots", f"""with {X.TRANSACTIONS}, s as (select user_id, symbol, sum(qty) as sold from transactions where type = 'SELL' group by 1, 2),
l as (select t.*, sum(qty) over (partition by user_id, symbol order by date, tx_id rows unbounded preceding) as upto from transactions t where type = 'BUY'),
k as (select l.*, greatest(0.0, least(qty, upto - coalesce(sold, 0))) as left_qty from l left join s using (user_id, symbol))
select user_id as "user", symbol, tx_id, date, left_qty as "left", left_qty * price as cost, case when date_diff('day', cast(date as date), date '2001-08-01') > 365 then 'long' else 'short' end as term from k where left_qty > 0""")
def tax_lots(spark, d):
    return P.tax_lots(X.transactions(spark, d), "2001-08-01")


def _effect(which: str, name: str) -> str:
    return f"""(select symbol, avg(ret) / nullif(stddev_pop(ret), 0) * {_SQ} as sharpe_{name}, stddev_pop(ret) * {_SQ} as volatility_{name}, min(dd) as drawdown_{name} from (
  select *, wealth / max(wealth) over (partition by symbol order by ts rows unbounded preceding) - 1 as dd from (
    select *, exp(sum(ln(1 + ret)) over (partition by symbol order by ts rows unbounded preceding)) as wealth from m where {which})) group by symbol)"""


@Q.add("ml11_mask_effect", f"""with {X.bars_sql()}{RET}, m as (select *, coalesce(abs(ret) > 5, false) as mask from x where ret > -1)
select * from {_effect("true", "all")} join {_effect("not mask", "kept")} using (symbol)""")
def mask_effect(spark, d):
    return P.drop_flagged_effect(_returns(spark, d).withColumn("mask", F.coalesce(F.abs("ret") > 5, F.lit(False))))


def rules(spark):
    return spark.createDataFrame([(1, "above", "VIEW", 95.0), (2, "below", None, 2.0), (3, "crosses", "CLICK", 50.0), (4, "volume", None, 1.9), (5, "z", "ERROR", 2.5)], "rule_id int, kind string, symbol string, threshold double")


@Q.add("st11_alerts", f"""with {X.TRADES}, r(rule_id, kind, rs, th) as (values (1, 'above', 'VIEW', 95.0), (2, 'below', null, 2.0), (3, 'crosses', 'CLICK', 50.0), (4, 'volume', null, 1.9), (5, 'z', 'ERROR', 2.5)),
f as (select *, lag(price) over ({O}) as prior, avg(size) over ({O} rows between 20 preceding and 1 preceding) as ms, abs((price - avg(price) over ({O} rows between 49 preceding and current row)) / nullif(stddev_samp(price) over ({O} rows between 49 preceding and current row), 0)) as z from trades)
select cast(rule_id as integer) as rule_id, kind, symbol, ts, trade_id, price from f join r on rs is null or rs = symbol
where case kind when 'above' then price > th when 'below' then price < th when 'crosses' then (prior < th and price >= th) or (prior > th and price <= th) when 'volume' then size > ms * th else z > th end""")
def alerts(spark, d):
    return P.evaluate_alerts(X.trades(spark, d), rules(spark))


@Q.add("st11_indicator_alerts", f"""with i as ({INDICATORS["ti4_rsi"]}), m as ({INDICATORS["ti5_macd"]}), j as (select symbol, ts, rsi_ml as rsi_14, macd_hist from i join m using (symbol, ts)),
p as (select *, lag(rsi_14) over (partition by symbol order by ts) as r0, lag(macd_hist) over (partition by symbol order by ts) as m0 from j)
select 1 as rule_id, 'rsi_14' as indicator, symbol, ts, rsi_14 as value from p where rsi_14 > 70 union all select 2, 'rsi_14', symbol, ts, rsi_14 from p where rsi_14 < 30 and symbol = 'VIEW'
union all select 3, 'macd_hist', symbol, ts, macd_hist from p where (m0 < 0 and macd_hist >= 0) or (m0 > 0 and macd_hist <= 0)""")
def indicator_alerts(spark, d):
    from ticklattice.functions import indicators as I  # noqa: E741

    rows = I.indicator_set(X.bars(spark, d), ("rsi_14", "macd"))
    rules = [(1, "rsi_14", None, "above", 70.0), (2, "rsi_14", "VIEW", "below", 30.0), (3, "macd_hist", None, "crosses", 0.0)]
    return P.indicator_alerts(rows, rules, ["rsi_14", "macd_hist"])


@Q.add("st11_portfolio_alerts", f"""with s as ({Q.sql["a10_pr3_summary"]}) select 1 as rule_id, 'largest_weight' as metric, "user", largest_weight as value from s where largest_weight > 60
union all select 2, 'gain_pct', "user", gain_pct from s where gain_pct < -5""")
def portfolio_alerts(spark, d):
    return P.portfolio_alerts(summary(spark, d), [(1, "largest_weight", "above", 60.0), (2, "gain_pct", "below", -5.0)])


def alert_rows(spark, d):
    return P.evaluate_alerts(X.trades(spark, d), rules(spark))


@Q.add("a8_sector_performance", """select p_brand as sector, avg((p_retailprice - ps) / nullif(ps, 0) * 100) as mean_change_pct, sum(vol) as volume, count(*) as symbols from part join
 (select l_partkey, avg(l_extendedprice / l_quantity) as ps, sum(l_quantity) as vol from lineitem group by 1) on l_partkey = p_partkey group by 1""")
def sectors(spark, d):
    lines = X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps"), F.sum("l_quantity").alias("vol"))
    both = X.table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    change = F.try_divide(F.col("p_retailprice") - F.col("ps"), F.col("ps")) * 100
    return both.groupBy(F.col("p_brand").alias("sector")).agg(F.avg(change).alias("mean_change_pct"), F.sum("vol").alias("volume"), F.count(F.lit(1)).alias("symbols"))


@Q.add("a13_alert_statistics", f"""with {X.TRADES} select symbol, cast(hour(ts) as integer) as hour, count(*) as n, avg(price) as mean_price from trades where price > 90 group by grouping sets ((symbol), (hour(ts)), ())""")
def alert_statistics(spark, d):
    t = X.trades(spark, d).filter("price > 90").withColumn("hour", F.hour("ts"))
    return t.groupingSets([["symbol"], ["hour"], []], "symbol", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"))


@Q.add("a16_source_counters", "select source, count(*) as records, count(*) filter (n_chars > 100) as ok, count(*) filter (n_chars > 100) / count(*) as success_rate from documents group by 1")
def counters(spark, d):
    return X.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("n_chars") > 100).alias("ok"), (F.count_if(F.col("n_chars") > 100) / F.count(F.lit(1))).alias("success_rate"))


@Q.add("a17_log_rates", f"""with {X.TRADES} select symbol, time_bucket(interval '5 minutes', ts) as window_start, count(*) / 300.0 as rate, count(*) filter (price < 5) / count(*) as error_ratio, quantile_cont(price, 0.95) as p95, max(ts) as freshest from trades group by 1, 2""")
def log_rates(spark, d):
    t = X.trades(spark, d).groupBy("symbol", F.window("ts", "5 minutes").alias("w")).agg(
        (F.count(F.lit(1)) / 300.0).alias("rate"), (F.count_if(F.col("price") < 5) / F.count(F.lit(1))).alias("error_ratio"), F.percentile("price", F.lit(0.95)).alias("p95"), F.max("ts").alias("freshest")
    )
    return t.select("symbol", F.col("w.start").alias("window_start"), "rate", "error_ratio", "p95", "freshest")


@Q.add("st12_threshold_alerts", f"""with {X.TRADES}, m as (select symbol, avg(price) as value from trades group by 1), t(level, place, th) as (values ('critical', 1, 51.0), ('warning', 2, 50.0), ('info', 3, 49.0))
select symbol, value, level from m join t on value > th qualify row_number() over (partition by symbol order by place) = 1""")
def threshold_alerts(spark, d):
    from pyspark.sql import Window

    levels = spark.createDataFrame([("critical", 1, 51.0), ("warning", 2, 50.0), ("info", 3, 49.0)], "level string, place int, th double")
    m = X.trades(spark, d).groupBy("symbol").agg(F.avg("price").alias("value"))
    hit = m.join(F.broadcast(levels), F.col("value") > F.col("th"))
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("place"))).filter("n = 1").select("symbol", "value", "level")


@Q.add("st14_alert_lifecycle", f"""with {X.TRADES_FINE}, e as (select symbol as alert_id, ts, trade_id, case trade_id % 3 when 0 then 'active' when 1 then 'acknowledged' else 'resolved' end as status from trades_fine)
select alert_id, arg_max(status, (ts, trade_id)) as status, min(ts) as opened, date_diff('second', min(ts), max(ts) filter (status = 'resolved')) / 60.0 as resolution_minutes from e group by 1""")
def lifecycle(spark, d):
    e = X.trades_fine(spark, d).select(F.col("symbol").alias("alert_id"), "ts", "trade_id", F.expr("case trade_id % 3 when 0 then 'active' when 1 then 'acknowledged' else 'resolved' end").alias("status"))
    one = e.groupBy("alert_id").agg(F.max_by("status", F.struct("ts", "trade_id")).alias("status"), F.min("ts").alias("opened"), F.max(F.when(F.col("status") == "resolved", F.col("ts"))).alias("done"))
    seconds = F.unix_timestamp(F.col("done").cast("timestamp")) - F.unix_timestamp(F.col("opened").cast("timestamp"))
    return one.select("alert_id", "status", "opened", (seconds / 60.0).alias("resolution_minutes"))


@Q.add("sl3_top_movers", f"with {X.TRADES_FINE}, m as (select symbol, (arg_max(price, (ts, trade_id)) - arg_min(price, (ts, trade_id))) / nullif(arg_min(price, (ts, trade_id)), 0) * 100 as change_pct from trades_fine group by 1) select * from m order by change_pct desc nulls last, symbol limit 5")
def movers(spark, d):
    o = F.struct("ts", "trade_id")
    m = X.trades_fine(spark, d).groupBy("symbol").agg((F.try_divide(F.max_by("price", o) - F.min_by("price", o), F.min_by("price", o)) * 100).alias("change_pct"))
    return m.orderBy(F.desc_nulls_last("change_pct"), "symbol").limit(5)


@Q.add("sl4_market_overview", f"""with {X.bars_sql("1 day")}, l as (select symbol, ts, close, lag(close) over (partition by symbol order by ts) as prior, row_number() over (partition by symbol order by ts desc) as n from bars)
select symbol, ts, close, prior, close - prior as change, (close - prior) / nullif(prior, 0) * 100 as change_pct from l where n = 1""")
def overview(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol")
    l = X.bars(spark, d, "1 day").select("symbol", "ts", "close", F.lag("close").over(w.orderBy("ts")).alias("prior"), F.row_number().over(w.orderBy(F.desc("ts"))).alias("n"))  # noqa: E741
    return l.filter("n = 1").select("symbol", "ts", "close", "prior", (F.col("close") - F.col("prior")).alias("change"), (F.try_divide(F.col("close") - F.col("prior"), F.col("prior")) * 100).alias("change_pct"))


@Q.add("sl6_paged_transactions", f"with {X.TRANSACTIONS} select user_id as \"user\", symbol, tx_id, date from transactions order by date desc, tx_id limit 20 offset 40")
def paged(spark, d):
    return X.transactions(spark, d).orderBy(F.desc("date"), "tx_id").offset(40).limit(20).select("user", "symbol", "tx_id", "date")


@Q.add("sl8_rank_models", f"with {SCORED}, m as (select 'price' as model, count(*) filter (y and pred) * 2 / nullif(count(*) filter (pred) + count(*) filter (y), 0) as f1 from sc union all select 'size', count(*) filter (y and pred_b) * 2 / nullif(count(*) filter (pred_b) + count(*) filter (y), 0) from sc) select *, cast(rank() over (order by f1 desc) as integer) as place from m")
def rank_models(spark, d):
    from pyspark.sql import Window

    long = scored(spark, d).select("y", F.explode(F.array(F.struct(F.lit("price").alias("model"), F.col("pred").alias("p")), F.struct(F.lit("size").alias("model"), F.col("pred_b").alias("p")))).alias("m"))
    f1 = long.groupBy(F.col("m.model").alias("model")).agg(F.try_divide(F.count_if(F.col("y") & F.col("m.p")) * 2, F.count_if("m.p") + F.count_if("y")).alias("f1"))
    return f1.withColumn("place", F.rank().over(Window.orderBy(F.desc("f1"))))  # one row per model


@Q.add("j2_reference_enrichment", "select l_orderkey * 10 + l_linenumber as quote_id, coalesce(p_brand, 'Other') as sector, p_type as asset_class, coalesce(n_name, 'Other') as exchange, r_name as region from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def enrichment(spark, d):
    lines = X.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("quote_id"), "l_partkey", "l_suppkey")
    place = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    both = lines.join(X.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(place, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return both.select("quote_id", F.coalesce("p_brand", F.lit("Other")).alias("sector"), F.col("p_type").alias("asset_class"), F.coalesce("n_name", F.lit("Other")).alias("exchange"), F.col("r_name").alias("region"))


@Q.add("so3_set_difference", f"with {X.TRADES} select symbol, size from trades where price > 50 except select symbol, size from trades where price < 10")
def difference(spark, d):
    t = X.trades(spark, d)
    return t.filter("price > 50").select("symbol", "size").subtract(t.filter("price < 10").select("symbol", "size"))


@Q.add("pr6_dividend_income", f"""with {VALUED}, i as (select user_id, shares * case when symbol % 3 = 0 then 0 else p_retailprice * 0.02 end as income, market_value from va join part on p_partkey = symbol)
select user_id as "user", sum(income) as income, count(*) filter (income > 0) as payers, sum(income) / nullif(sum(market_value), 0) * 100 as yield_pct from i group by 1""")
def dividends(spark, d):
    per_share = X.table(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("symbol"), (F.col("p_retailprice") * 0.02).alias("per_share"))
    return P.dividend_income(valued(spark, d), per_share)


@Q.add("pf15_alert_list", f"""with {X.TRADES}, f as (select *, avg(size) over ({O} rows between 20 preceding and 1 preceding) as ms from trades),
a as (select 2 as rule_id, 'below' as kind, symbol, ts, trade_id, price from f where price < 2 union all select 4, 'volume', symbol, ts, trade_id, price from f where size > ms * 1.9)
select cast(rule_id as integer) as rule_id, kind, symbol, ts, trade_id, price from a order by ts desc, trade_id, rule_id limit 20""")
def alert_list(spark, d):
    return P.alert_list(alert_rows(spark, d), kinds=["below", "volume"])
