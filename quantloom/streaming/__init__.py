"""Streaming forms of the daily aggregates and of the recursions, whose state is a few numbers a market."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType, TimestampType

from ..kernels.hmm import Hmm, log_density


def windowed_cross_section(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(market, start, n, mean, dispersion, frac_negative) of (market, ts, ret) by event-time window.

    Works on batch and streaming frames alike; on a stream rows later than ``late`` are dropped and a window is
    emitted once it is closed (append mode), so state holds open windows only.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("market", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("dispersion"),
        F.avg((F.col("ret") < 0).cast("double")).alias("frac_negative"),
    ).select("market", F.col("w.start").alias("start"), "n", "mean", "dispersion", "frac_negative")


def filtered_states(features: DataFrame, names: list[str], model: Hmm, late: str = "1 hour") -> DataFrame:
    """(market, ts, p): P(state | all rows so far) under a fixed model, for a stream of (market, ts, features).

    The state of a market is its last probability vector and time. Rows of a micro-batch are taken by time; one that is
    not after the market's last is dropped, since the recursion cannot go back.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).drop_duplicates("ts").sort_values("ts")
        rows = rows if last is None else rows[rows["ts"] > pd.Timestamp(last)]
        if not len(rows):
            return
        out = []
        for b in log_density(model, rows[names].to_numpy(float)):
            p = (model.start if alpha is None else np.array(alpha) @ model.trans) * np.exp(b - b.max())
            alpha = (p / max(p.sum(), 1e-300)).tolist()
            out.append(alpha)
        state.update((alpha, rows["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"market": key[0], "ts": rows["ts"].to_numpy(), "p": out})

    kind = features.schema["ts"].dataType.simpleString()
    marked = features.withWatermark("ts", late)
    return marked.groupBy("market").applyInPandasWithState(run, f"market string, ts {kind}, p array<double>", f"alpha array<double>, last {kind}", "append", GroupStateTimeout.NoTimeout)


class OrderedFilter(StatefulProcessor):
    """The filter of ``ordered_states``: rows wait until the watermark has passed them and are then taken by time."""

    def __init__(self, names: list[str], model: Hmm, idle: timedelta):
        self.names, self.model, self.idle = names, model, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", StructType([StructField("ts", TimestampType()), StructField("p", ArrayType(DoubleType()))]))
        self.waiting = handle.getListState("waiting", StructType([StructField("ts", TimestampType()), StructField("x", ArrayType(DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after = self.reached.get()[0] if self.reached.exists() else None
        for frame in rows:
            for ts, x in zip(frame["ts"], frame[self.names].to_numpy(float), strict=True):
                at = ts.to_pydatetime()
                if after is None or at > after:  # the recursion cannot go back
                    self.waiting.appendValue((at, x.tolist()))
        yield from self._taken(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, timerValues)

    def _taken(self, key, timers) -> Iterator[pd.DataFrame]:
        mark = datetime.fromtimestamp(timers.getCurrentWatermarkInMs() / 1000)
        held = dict(self.waiting.get()) if self.waiting.exists() else {}  # of rows of one time the last stays
        due = sorted(t for t in held if t <= mark)
        after, alpha = self.reached.get() if self.reached.exists() else (None, None)
        out = []
        if due:
            for t, b in zip(due, log_density(self.model, np.array([held.pop(t) for t in due])), strict=True):
                if after is not None and t - after > self.idle:
                    alpha = None
                after, p = t, (self.model.start if alpha is None else np.array(alpha) @ self.model.trans) * np.exp(b - b.max())
                alpha = (p / max(p.sum(), 1e-300)).tolist()
                out.append((key[0], t, alpha))
            self.reached.update((after, alpha))
            if held:
                self.waiting.put([(t, list(x)) for t, x in held.items()])
            else:
                self.waiting.clear()
        # One timer a market: at the next row that waits, or else when a silent market is forgotten.
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(int(min(held).timestamp() * 1000))
        elif after is not None and mark - after > self.idle:
            self.reached.clear()
        elif after is not None:
            self.handle.registerTimer(int((after + self.idle).timestamp() * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["market", "ts", "p"])


def ordered_states(features: DataFrame, names: list[str], model: Hmm, late: str = "1 hour", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """``filtered_states`` that puts rows inside the watermark in order instead of dropping them, and forgets markets.

    A row is given out once the watermark has passed it, so one that comes up to ``late`` after its turn still takes it.
    A market that is silent for longer than ``idle`` loses its state and starts anew. ``ts`` is a timestamp; the session
    needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) and the time zone of its machines.
    """
    schema = StructType([StructField("market", StringType()), StructField("ts", TimestampType()), StructField("p", ArrayType(DoubleType()))])
    rows = features.select("market", "ts", *names).withWatermark("ts", late)
    return rows.groupBy("market").transformWithStateInPandas(OrderedFilter(names, model, idle), schema, "append", "EventTime")


def conditional_correlation(residuals: DataFrame, bar: np.ndarray, a: float, b: float) -> DataFrame:
    """(study, ts, avg_corr): mean correlation of the DCC recursion over a stream of (study, ts, z array<double>).

    ``bar`` is the covariance it returns to. The state is the last N x N matrix and the last residuals.
    """
    n = len(bar)
    upper = np.triu_indices(n, 1)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, z, last = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).drop_duplicates("ts").sort_values("ts")
        rows = rows if last is None else rows[rows["ts"] > pd.Timestamp(last)]
        if not len(rows):
            return
        out = []
        for now in rows["z"]:
            q = bar if q is None else (1 - a - b) * bar + a * np.outer(z, z) + b * np.reshape(q, (n, n))
            z, s = np.array(now, float), 1 / np.sqrt(np.diag(q))
            out.append(float((q * np.outer(s, s))[upper].mean()))
        state.update((np.ravel(q).tolist(), z.tolist(), rows["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"study": key[0], "ts": rows["ts"].to_numpy(), "avg_corr": out})

    kind = residuals.schema["ts"].dataType.simpleString()
    return residuals.groupBy("study").applyInPandasWithState(run, f"study string, ts {kind}, avg_corr double", f"q array<double>, z array<double>, last {kind}", "append", GroupStateTimeout.NoTimeout)


def refit_marks(rebals: DataFrame) -> DataFrame:
    """(market, ts): the first rebalance of each calendar year of a stream (market, ts), where a model is fitted anew."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (year,) = state.get if state.exists else (0,)
        out = []
        for at in sorted(pd.concat(list(frames))["ts"]):
            if at.year > year:
                year = at.year
                out.append(at)
        state.update((year,))
        if out:
            yield pd.DataFrame({"market": key[0], "ts": out})

    kind = rebals.schema["ts"].dataType.simpleString()
    return rebals.groupBy("market").applyInPandasWithState(run, f"market string, ts {kind}", "year int", "append", GroupStateTimeout.NoTimeout)
