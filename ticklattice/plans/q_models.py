"""Fitted detectors and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklattice.functions import folders, quantiles
from ticklattice.operators import ensemble as N
from ticklattice.operators import evaluate as E
from ticklattice.operators import forest as M
from ticklattice.operators import training as T
from ticklattice.plans import Queries
from ticklattice.plans.q_detect import _DETECT as DETECT
from ticklattice.plans.q_detect import FEATURES, MATRIX, matrix
from ticklattice.plans.q_evaluate import SCORED, scored
from ticklattice.plans.q_rolling import RET, _returns
from ticklattice.sources import fixtures as X

Q = Queries()
c = F.col


@Q.add("ad13_isolation_forest")
def isolation_forest(spark, d):
    m = matrix(spark, d)
    scored = M.score(m, M.grow(m, FEATURES, key="vec_id"), FEATURES)
    return M.normalised(scored, M.score_bounds(scored)).select("vec_id", "iforest_score", "iforest_share")


_OUT = lambda f: f"avg(cast({f} < {f}a - ({f}b - {f}a) * 1.5 or {f} > {f}b + ({f}b - {f}a) * 1.5 as double))"


@Q.add("ad13_contamination", f"""with {MATRIX}, q as (select {", ".join(f"quantile_cont({f}, 0.25) as {f}a, quantile_cont({f}, 0.75) as {f}b" for f in FEATURES)} from matrix),
r as (select unnest([{", ".join(_OUT(f) for f in FEATURES)}]) as rate from matrix, q) select least(greatest(quantile_cont(rate, 0.5), 0.01), 0.5) as contamination from r""")
def contamination(spark, d):
    return M.contamination(matrix(spark, d), FEATURES)


@Q.add("ad14_sequence_errors")
def sequence_errors(spark, d):
    return M.sequence_errors(X.bars(spark, d))


@Q.add("ad16_batch_scoring")
def batch_scoring(spark, d):
    """The forest's rows above the 99th percentile of scores: alerts of a batch."""
    m = isolation_forest(spark, d)
    edge = quantiles.quantiles(m, {"s": "iforest_score"}, [0.99])["s"][0]
    return m.filter(c("iforest_score") > F.lit(edge).cast("double"))


@Q.add("ml10_search", f"""with {SCORED}, p as (select *, row_number() over (order by ts, trade_id) as position, count(*) over () as n from sc),
w as (select y, least(floor((position - 1) * 5 / n), 4) as fold, {", ".join(f"abs((price - avg(price) over w{k}) / nullif(stddev_samp(price) over w{k}, 0)) as z{k}" for k in (20, 50, 100))} from p
  window {", ".join(f"w{k} as (partition by symbol order by ts, trade_id rows between {k - 1} preceding and current row)" for k in (20, 50, 100))}),
g as (select y, fold, span, width, coalesce(case span when 20 then z20 when 50 then z50 else z100 end > width, false) as pred from w, (values (20), (50), (100)) a(span), (values (2.0::double), (2.5::double), (3.0::double)) b(width)),
f as (select span, width, fold, 2 * count(*) filter (y and pred) / nullif(count(*) filter (pred) + count(*) filter (y), 0) as f1 from g group by all)
select span, width, avg(f1) as mean_f1, stddev_samp(f1) as sd_f1 from f group by all""")
def search(spark, d):
    return M.search(E.time_split(scored(spark, d)))


@Q.add("fs3_training_set", f"""with {X.bars_sql()}{RET}, p as (select *, row_number() over (order by ts, symbol) as position, count(*) over () as n from x where ret is not null),
s as (select *, case when position <= floor(n * 0.7) then 'train' when position <= floor(n * 0.85) then 'validation' else 'test' end as split from p),
f as (select avg(ret) filter (split = 'train') as m, stddev_pop(ret) filter (split = 'train') as sd, avg(volume) filter (split = 'train') as vm, stddev_pop(volume) filter (split = 'train') as vs from s)
select symbol, ts, split, (ret - m) / nullif(sd, 0) as ret_scaled, (volume - vm) / nullif(vs, 0) as volume_scaled, ln(1 + close) as target from s, f""")
def training_set(spark, d):
    """Splits by time, scaled by what the training part alone shows, with a logarithmic target."""
    r = E.time_split(_returns(spark, d).filter("ret is not null"), tie="symbol")
    train = lambda f, x: f(F.when(c("split") == "train", c(x)))
    fit = r.agg(train(F.avg, "ret").alias("m"), train(F.stddev_pop, "ret").alias("sd"), train(F.avg, "volume").alias("vm"), train(F.stddev_pop, "volume").alias("vs"))
    both = r.crossJoin(F.broadcast(fit))  # one row
    return both.select("symbol", "ts", "split", F.try_divide(c("ret") - c("m"), c("sd")).alias("ret_scaled"), F.try_divide(c("volume") - c("vm"), c("vs")).alias("volume_scaled"), F.log1p("close").alias("target"))


_FAULTY = f"""{X.bars_sql()}, fb as (select symbol, ts, high, low, case when hour(ts) = 5 then null when hour(ts) = 17 then -close when hour(ts) = 21 then close * 50 else close end as close from bars)"""


def faulty_bars(spark, d):
    """Hourly bars whose closes are lost at five, negative at seventeen, and far off at twenty-one."""
    h = F.hour("ts")
    close = F.when(h == 5, F.lit(None)).when(h == 17, -c("close")).when(h == 21, c("close") * 50).otherwise(c("close"))
    return X.bars(spark, d).select("symbol", "ts", "high", "low", close.alias("close"))


_W20 = "(partition by symbol order by ts rows between 19 preceding and current row)"


@Q.add("rs20_preparation", f"""with {_FAULTY}, v as (select symbol, ts, case when close > 0 and high >= low then close end as close from fb),
f as (select symbol, ts, coalesce(last_value(close ignore nulls) over (partition by symbol order by ts rows unbounded preceding),
  first_value(close ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following)) as close from v),
q as (select symbol, quantile_cont(close, 0.25) as q1, quantile_cont(close, 0.75) as q3 from f group by 1),
k as (select symbol, ts, least(greatest(close, q1 - (q3 - q1) * 1.5), q3 + (q3 - q1) * 1.5) as close from f join q using (symbol)),
r as (select *, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as ret, ln(close / nullif(lag(close) over (partition by symbol order by ts), 0)) as log_ret from k)
select symbol, ts, close, ret, log_ret, case when count(close) over {_W20} >= 20 then avg(close) over {_W20} end as mean_20, case when count(close) over {_W20} >= 20 then stddev_samp(close) over {_W20} end as std_20,
  case when count(ret) over {_W20} >= 20 then stddev_samp(ret) over {_W20} * sqrt(252) end as vol_20, (close - avg(close) over {_W20}) / nullif(stddev_samp(close) over {_W20}, 0) as z_20 from r""")
def preparation(spark, d):
    """The chain from faulty bars to features: validate, fill, clip, returns, rolling statistics."""
    return T.prepare(faulty_bars(spark, d))


_SPLIT = "case when ts < timestamp '2024-01-20' then 'train' when ts < timestamp '2024-01-25' then 'validation' else 'test' end"


@Q.add("fs3_training_table", f"""with {X.bars_sql()}, g as (select symbol, ts, close, case when hour(ts) = 3 then null else cast(volume as double) end as volume, high - low as spread from bars),
f as (select symbol, ts, close, spread, last_value(volume ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as volume, lead(close, 2) over (partition by symbol order by ts) as later from g),
t as (select *, {_SPLIT} as split, later / nullif(close, 0) - 1 as target from f where later / nullif(close, 0) - 1 is not null),
q as (select quantile_cont(volume, 0.25) as v1, quantile_cont(volume, 0.75) as v3, quantile_cont(spread, 0.25) as s1, quantile_cont(spread, 0.75) as s3 from t where split = 'train'),
k as (select t.* from t, q where split <> 'train' or (coalesce(volume between v1 - (v3 - v1) * 1.5 and v3 + (v3 - v1) * 1.5, true) and coalesce(spread between s1 - (s3 - s1) * 1.5 and s3 + (s3 - s1) * 1.5, true))),
p as (select avg(volume) as vm, stddev_pop(volume) as vs, avg(spread) as sm, stddev_pop(spread) as ss from k where split = 'train')
select symbol, ts, split, (volume - vm) / nullif(vs, 0) as volume_scaled, (spread - sm) / nullif(ss, 0) as spread_scaled, target from k, p""")
def training_table(spark, d):
    """Features filled forward, outliers of the training part left out, splits at given times, the return two bars on as target."""
    b = X.bars(spark, d).select("symbol", "ts", "close", F.when(F.hour("ts") != 3, c("volume").cast("double")).alias("volume"), (c("high") - c("low")).alias("spread"))
    return T.training_set(b, ["volume", "spread"], T.split_at(c("ts"), "2024-01-20", "2024-01-25"), "close", kind="return", ahead=2)


@Q.add("ad15_stacking")
def stacking(spark, d):
    """Detector scores of the trades, stacked; the label and the split come with the rows."""
    from ticklattice.operators import anomaly as A

    rows = A.detect(E.time_split(scored(spark, d).withColumn("size", c("trade_id") % 97)))
    names = [f"anomaly_score_{m}" for m in A.METHODS]
    return M.stack(rows, names).select("trade_id", "y", "split", "stacked_score")


_FLAGS = ("is_zscore", "is_iqr", "is_spike", "is_volume")
_F1 = ", ".join(f"coalesce(2 * count(*) filter (y and {f}) / nullif(count(*) filter ({f}) + count(*) filter (y), 0), 0) as {f}" for f in _FLAGS)
_BEST = "greatest(" + ", ".join(f"l_{f}" for f in _FLAGS) + ") - 0.1 - 1e-12"
_TAKEN = ", ".join(f"case when l_{f} >= {_BEST} then l_{f} * w_{f} else 0 end as t_{f}" for f in _FLAGS)


@Q.add("ad15_dynamic_selection", f"""with {DETECT}, po as (select trade_id, price, size, size % 5 = 0 as y, row_number() over (order by ts, trade_id) as position, count(*) over () as n from trades),
sp as (select po.*, {", ".join(_FLAGS)}, case when position <= floor(n * 0.7) then 'train' when position <= floor(n * 0.85) then 'validation' else 'test' end as split from po join g using (trade_id)),
va as (select *, least(floor((position - min(position) over ()) * 3 / count(*) over ()), 2) as fold from sp where split = 'validation'),
f1 as (select fold, {_F1} from va group by 1), ra as (select {", ".join(f"greatest(avg({f}), 0.1) as {f}" for f in _FLAGS)} from f1),
we as (select {", ".join(f"{f} / ({' + '.join(_FLAGS)}) as w_{f}" for f in _FLAGS)} from ra),
nn as (select te.trade_id, {", ".join(f"(va.{f} = va.y)::int::double as {f}" for f in _FLAGS)} from sp te, va where te.split = 'test'
  qualify row_number() over (partition by te.trade_id order by (te.price - va.price) * (te.price - va.price) + (te.size - va.size)::double * (te.size - va.size), va.trade_id) <= 25),
lo as (select trade_id, {", ".join(f"avg({f}) as l_{f}" for f in _FLAGS)} from nn group by 1),
ta as (select trade_id, {", ".join(_FLAGS)}, {_TAKEN} from sp join lo using (trade_id), we)
select trade_id, ({" + ".join(f"t_{f} * {f}::int" for f in _FLAGS)}) / nullif({" + ".join(f"t_{f}" for f in _FLAGS)}, 0) as dynamic_score, {" + ".join(f"(t_{f} > 0)::int" for f in _FLAGS)} as n_selected from ta""")
def dynamic_selection(spark, d):
    """Detectors weighed by the validation part as a whole and around each row of the test part."""
    from ticklattice.operators import anomaly as A

    rows = folders.written(A.detect(E.time_split(X.trades(spark, d))).withColumn("y", c("size") % 5 == 0), "detected")
    validation, test = (rows.filter(c("split") == x) for x in ("validation", "test"))
    weights = N.auto_weights(validation, list(_FLAGS))
    return N.select(test, validation, list(_FLAGS), ["price", "size"], weights).select("trade_id", "dynamic_score", "n_selected")
