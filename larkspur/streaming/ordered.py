"""Keyed streams taken in the order of event time, with flat memory.

Rows of a key wait in state until the watermark has passed their bucket of event time: few rows as one value, more in map
state by bucket.  A timer then takes what is due, sorts it, and hands it to the step together with what the key carries on
(value state).  A task holds the few rows and one Arrow batch of new ones, or one bucket of one key, whatever share of the
stream the key has.  Rows behind the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Event time of one bucket
BUCKET_MS = 3_600_000

#: Most waiting rows of a key that are held as one value
HELD_ROWS = 8_192

#: The provider that transformWithState needs
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (carried state or None, values in time order) -> (new state as a tuple, one output per value)
Step = Callable[[tuple | None, np.ndarray], tuple[tuple, np.ndarray]]


class InOrder(StatefulProcessor):
    """Input rows (ts, event_id, value); output rows (event_id, out).

    A key with at most ``held_rows`` waiting rows keeps them in one value, so a sparse key costs a few state calls a
    batch; more rows move to buckets of event time.
    """

    def __init__(self, step: Step, carry: str, bucket_ms: int = BUCKET_MS, held_rows: int = HELD_ROWS):
        self.step, self.carry_schema, self.bucket_ms, self.held_rows = step, carry, bucket_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = "ts array<bigint>, event_id array<bigint>, value array<double>"
        self.held = handle.getValueState("held", rows)
        self.waiting = handle.getMapState("waiting", "bucket bigint, chunk int", rows)
        self.open = handle.getMapState("open", "bucket bigint", "chunks int")
        self.carry = handle.getValueState("carry", self.carry_schema)

    def _held(self) -> list[np.ndarray]:
        return _arrays([self.held.get() if self.held.exists() else ([], [], [])])

    def _keep(self, rows: list[np.ndarray]) -> None:
        """Hold ``rows``, with a timer at the end of their first bucket; it sets the next one."""
        if len(rows[0]):
            self.held.update(tuple(c.tolist() for c in rows))
            self.handle.registerTimer((int(rows[0].min()) // (self.bucket_ms * 1000) + 1) * self.bucket_ms)
        else:
            self.held.clear()

    def _spread(self, rows: list[np.ndarray]) -> None:
        """Rows of a crowded key, added to the buckets of their time."""
        bucket = rows[0] // (self.bucket_ms * 1000)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            b = int(bucket[part[0]])
            chunks = self.open.getValue((b,))[0] if self.open.containsKey((b,)) else 0
            if not chunks:
                self.handle.registerTimer((b + 1) * self.bucket_ms)
            self.waiting.updateValue((b, chunks), tuple(c[part].tolist() for c in rows))
            self.open.updateValue((b,), (chunks + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for batch in rows:
            micros = batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            new = [micros, batch["event_id"].to_numpy(), batch["value"].to_numpy(dtype=float)]
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) > self.held_rows:
                self._spread(held)
                held = _arrays([([], [], [])])
        self._keep(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # every bucket that the watermark has passed is taken, the earliest first: a later timer of the batch finds none
        last = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.bucket_ms - 1
        held = self._held()
        bucket = held[0] // (self.bucket_ms * 1000)
        due = bucket <= last
        small = [c[due] for c in held]
        if due.any():
            self._keep([c[~due] for c in held])
        crowded = sorted(k[0] for k in self.open.keys() if k[0] <= last)
        if not crowded:
            if due.any():
                yield self._step(small)
            return
        at = bucket[due]
        for b in crowded:
            # held rows of the buckets up to this one, then this one with its own
            before = at < b
            if before.any():
                yield self._step([c[before] for c in small])
            chunks = [self.waiting.getValue((b, c)) for c in range(self.open.getValue((b,))[0])]
            yield self._step([np.concatenate(pair) for pair in zip([c[at == b] for c in small], _arrays(chunks))])
            for c in range(len(chunks)):
                self.waiting.removeKey((b, c))
            self.open.removeKey((b,))
            small, at = [c[at > b] for c in small], at[at > b]
        if len(at):
            yield self._step(small)

    def _step(self, rows: list[np.ndarray]) -> pd.DataFrame:
        ts, ids, values = rows
        order = np.lexsort((ids, ts))
        state, out = self.step(self.carry.get() if self.carry.exists() else None, values[order])
        self.carry.update(state)
        return pd.DataFrame({"event_id": ids[order], "out": out})


def _arrays(chunks) -> list[np.ndarray]:
    """Stored (ts, event_id, value) lists as one array each."""
    return [np.concatenate([np.asarray(c[i], float if i == 2 else np.int64) for c in chunks]) for i in range(3)]


def in_time_order(stream: DataFrame, key: str, step: Step, carry: str, delay: str, bucket_ms: int = BUCKET_MS, held_rows: int = HELD_ROWS) -> DataFrame:
    """(event_id, out) of every row of ``stream`` (ts, event_id, value and the key) that is not late."""
    rows = stream.select(key, "ts", "event_id", F.col("value").cast("double").alias("value")).withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(InOrder(step, carry, bucket_ms, held_rows), "event_id bigint, out double", "Append", "EventTime")


def last_mean(n: int) -> tuple[Step, str]:
    """Mean of the previous ``n`` values; null for the first."""
    def step(state, values):
        kept = np.asarray(state[0], float) if state is not None else np.zeros(0)
        line = np.concatenate([kept, values])
        # the n values before each, summed one by one: nothing is subtracted
        ahead = np.concatenate([np.zeros(n), line])
        at = np.arange(len(kept), len(line))
        total = sum(ahead[at + j] for j in range(n))
        count = np.minimum(at, n)
        out = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        return (line[-n:].tolist(),), out

    return step, "kept array<double>"


def running_alarm(k: float, need: int) -> tuple[Step, str]:
    """1 where a value leaves mean +- ``k`` deviations of all before it, once ``need`` were seen."""
    def step(state, values):
        n, mean, m2 = state if state is not None else (0, 0.0, 0.0)
        out = np.zeros(len(values))
        for i, v in enumerate(values.tolist()):
            out[i] = n >= need and abs(v - mean) > k * (m2 / (n - 1)) ** 0.5
            n += 1
            delta = v - mean
            mean += delta / n
            m2 += delta * (v - mean)
        return (n, mean, m2), out

    return step, "n bigint, mean double, m2 double"
