"""Indicators of a stream of bars in Spark's keyed state: RSI, MACD, parabolic SAR and GARCH volatility of each symbol.

What a symbol's next bar needs is one typed value in the state store, whatever the series' length.  Event-time timers end the
state of symbols that fall silent, and the state can be read back as a table.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ticklattice.functions.indicators import SAR_STATE, sar_fold

c = F.col
#: The store that typed state and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "micros long, close double, ret double, moves array<double>, fast double, slow double, signal double, fast_weight double, slow_weight double,"
    f" signal_weight double, {SAR_STATE}, variance double, long_run double, late long"
)
OUT = "symbol string, ts timestamp, kind string, rsi double, macd double, macd_signal double, macd_hist double, psar double, garch_vol double, late long"
SAR_FIELDS = [f.split()[0] for f in SAR_STATE.split(", ")]
NAMES = [f.split()[0] for f in STATE.split(", ")]


class BarState(StatefulProcessor):
    """One row out for each bar in; ``kind`` is bar, or idle for the row that a timer gives when it ends a silent symbol's state.

    Bars of a batch are put in order per symbol; one that is not after the symbol's last bar is left out and counted in ``late``.
    GARCH needs a long-run variance, which the initial state gives; without one garch_vol is null.
    """

    def __init__(self, *, idle_s: float, rsi: int = 14, spans: tuple[int, int, int] = (12, 26, 9), alpha: float = 0.1, beta: float = 0.85, sar: str = "clamped"):
        self.idle_ms, self.rsi_n, self.alpha, self.beta = int(idle_s * 1000), rsi, alpha, beta
        self.decays = [1 - 2 / (n + 1) for n in spans]
        self.sar = sar

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("indicators", STATE)
        self.fold = sar_fold(0.02, 0.02, 0.2, self.sar)

    def _load(self) -> dict:
        if not self.held.exists():
            return dict.fromkeys(NAMES) | {"moves": [], "late": 0} | dict.fromkeys(("fast", "slow", "signal", "fast_weight", "slow_weight", "signal_weight"), 0.0)
        s = dict(zip(NAMES, tuple(self.held.get()), strict=True))
        return s | {"moves": list(s["moves"] or [])}

    def _store(self, s: dict) -> None:
        self.held.update(tuple(s[k] for k in NAMES))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802
        self._store(self._load() | {"long_run": initialState["long_run"]})

    def _rsi(self, moves: list[float]) -> float | None:
        if len(moves) < self.rsi_n:
            return None
        gain, loss = (sum(max(sign * m, 0.0) for m in moves) / self.rsi_n for sign in (1, -1))
        if loss == 0:
            return 100.0 if gain > 0 else None
        return 100 - 100 / (1 + gain / loss)

    def _step(self, s: dict, bar: Row) -> dict:
        close, first = bar["close"], s["micros"] is None
        if not first:
            s["moves"] = [*s["moves"], close - s["close"]][-self.rsi_n :]
        for name, decay in zip(("fast", "slow"), self.decays, strict=False):
            s[name], s[f"{name}_weight"] = decay * s[name] + close, decay * s[f"{name}_weight"] + 1
        macd = s["fast"] / s["fast_weight"] - s["slow"] / s["slow_weight"]
        s["signal"], s["signal_weight"] = self.decays[2] * s["signal"] + macd, self.decays[2] * s["signal_weight"] + 1
        signal = s["signal"] / s["signal_weight"]
        before = None if s["rising"] is None else tuple(s[k] for k in SAR_FIELDS)
        found, sar = self.fold(before, {"high": [bar["high"]], "low": [bar["low"]]})
        s |= dict(zip(SAR_FIELDS, sar or (), strict=sar is not None))
        if s["long_run"] is not None:
            shock = (s["ret"] or 0.0) ** 2
            s["variance"] = s["long_run"] if first else (1 - self.alpha - self.beta) * s["long_run"] + self.alpha * shock + self.beta * s["variance"]
        s["ret"] = None if first or not s["close"] else close / s["close"] - 1
        s["micros"], s["close"] = bar["micros"], close
        vol = None if s["variance"] is None else math.sqrt(s["variance"])
        return {"rsi": self._rsi(s["moves"]), "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "psar": found["psar"][0], "garch_vol": vol}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        s = self._load()
        for bar in sorted(rows, key=lambda r: r["micros"]):
            if bar["close"] is None or (s["micros"] is not None and bar["micros"] <= s["micros"]):
                s["late"] += 1
                continue
            yield Row(**({"symbol": key[0], "ts": bar["ts"], "kind": "bar"} | self._step(s, bar) | {"late": s["late"]}))
        self._store(s)
        if s["micros"] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(s["micros"] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        s = self._load()
        self.held.clear()
        last = dt.datetime.fromtimestamp(s["micros"] / 1e6, dt.timezone.utc)
        yield Row(symbol=key[0], ts=last, kind="idle", rsi=None, macd=None, macd_signal=None, macd_hist=None, psar=None, garch_vol=None, late=s["late"])


def with_state(bars: DataFrame, *, idle_s: float, variances: DataFrame | None = None, **parameters) -> DataFrame:
    """``OUT`` rows of a stream of bars (symbol, ts: event time with a watermark, close, high, low).

    ``variances`` (symbol, long_run) starts the GARCH recurrence of each symbol.  A micro-batch holds a symbol's bars of that
    batch in one task, so the source's files per trigger bound it; what is kept between batches has a fixed size.
    """
    first = None if variances is None else variances.select("symbol", "long_run").groupBy("symbol")
    given = bars.filter("ts is not null").select("symbol", "ts", F.unix_micros("ts").alias("micros"), *[c(x).cast("double").alias(x) for x in ("close", "high", "low")])
    return given.groupBy("symbol").transformWithState(BarState(idle_s=idle_s, **parameters), OUT, "append", "EventTime", first)


def read_state(spark, checkpoint: str) -> DataFrame:
    """(symbol, and the fields of the state) of every symbol, read back from a stream's checkpoint."""
    found = spark.read.format("statestore").option("stateVarName", "indicators").load(checkpoint)
    return found.select(c("key.symbol").alias("symbol"), "value.*")


def run(bars: DataFrame, path: str, checkpoint: str, **parameters) -> None:
    """Take all bars that are there, from where the checkpoint stands, and append the rows to the table at ``path``."""
    from ticklattice.streaming import jobs

    conf, name = bars.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)  # read when the query starts
    try:
        query = jobs.append(with_state(bars, **parameters), path, checkpoint)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    query.awaitTermination()
