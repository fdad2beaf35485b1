"""Streams with state of their own: order, hot keys, repeated batches, restarts and late rows."""

import datetime as dt
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.plans.flows import online_fit
from larkspur.streaming.durable import BatchState, Progress, late_split
from larkspur.streaming.ordered import InOrder, in_time_order, last_mean, running_alarm
from larkspur.streaming.runner import Replay

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


def events(n, seed):
    """A third of the rows belong to user 0; rows arrive out of order inside a part."""
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(minutes=20 * (i // 3), seconds=rng.randrange(600)), 0 if i % 3 == 0 else rng.randrange(1, 9), float(rng.randrange(100) if i % 50 else 5000)) for i in range(n)]


def in_order(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        users.setdefault(r[2], []).append(r)
    return users


def replayed(spark, rows, step, parts=3):
    r = Replay(spark, "ordered")
    ends = [len(rows) * i // parts for i in range(parts + 1)]
    flush = [(10**6, rows[-1][1] + dt.timedelta(days=400), 0, 0.0)]
    for part in [rows[a:b] for a, b in zip(ends, ends[1:])] + [flush]:
        part = list(part)
        random.Random(1).shuffle(part)
        r.land(spark.createDataFrame(part, SCHEMA).repartition(3))
        r.run(lambda s: in_time_order(s, "user_id", step[0], step[1], "2 hours"))
    return {q.event_id: q.out for q in r.result().collect()}


def test_values_before_come_in_time_order(spark):
    rows = events(600, 2)
    got = replayed(spark, rows, last_mean(5))
    want = {}
    for own in in_order(rows).values():
        for i, r in enumerate(own):
            before = [q[3] for q in own[max(0, i - 5):i]]
            want[r[0]] = sum(before) / len(before) if before else None
    assert got.keys() == want.keys()
    assert all((got[i] is None if want[i] is None else abs(got[i] - want[i]) < 1e-9) for i in want)


class Store:
    """State of one key in memory; every call that would cross to the engine is counted."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls = {}, {}, set(), 0

    def getValueState(self, name, schema):
        return Cell(self, self.values, name)

    def getMapState(self, name, key, value):
        return Cell(self, self.maps.setdefault(name, {}), None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Cell:
    def __init__(self, store, data, name):
        self.store, self.data, self.name = store, data, name

    def _at(self, key):
        self.store.calls += 1
        return self.name if key is None else key

    def exists(self):
        return self._at(None) in self.data

    def get(self):
        return self.data[self._at(None)]

    def update(self, value):
        self.data[self._at(None)] = value

    def clear(self):
        self.data.pop(self._at(None), None)

    def containsKey(self, key):
        return self._at(key) in self.data

    def getValue(self, key):
        return self.data[self._at(key)]

    def updateValue(self, key, value):
        self.data[self._at(key)] = value

    def removeKey(self, key):
        del self.data[self._at(key)]

    def keys(self):
        self.store.calls += 1
        return list(self.data)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def played(held_rows, batches):
    """(outputs by event id, state calls): batches of (event_id, hour, value) of one key, with the watermark after each."""
    store, order = Store(), InOrder(*last_mean(5), held_rows=held_rows)
    order.init(store)
    got, seen = {}, []
    for rows, watermark in batches:
        frame = pd.DataFrame(rows, columns=["event_id", "hour", "value"])
        frame["ts"] = pd.to_datetime(frame["hour"], unit="h")
        list(order.handleInputRows((1,), iter([frame]), Clock(watermark)))
        while due := sorted(x for x in store.timers if x <= watermark):
            store.timers.discard(due[-1])  # the engine promises no order
            for out in order.handleExpiredTimer((1,), Clock(watermark), Clock(due[-1])):
                seen += out["event_id"].tolist()
                got |= dict(zip(out["event_id"], out["out"]))
    assert not store.maps["open"] and not store.maps["waiting"]
    return got, seen, store.calls


def test_sparse_keys_cost_few_state_calls_and_crowded_ones_agree():
    rng = random.Random(4)
    hours = sorted(rng.uniform(0, 400) for _ in range(90))
    rows = [(i, h, float(rng.randrange(50))) for i, h in enumerate(hours)]
    batches = []
    for part, watermark in ((rows[:30], hours[25]), (rows[30:50], hours[28]), (rows[50:], 900.0), ([(90, 850.5, 1.0)], 10_000.0)):
        part = list(part)
        rng.shuffle(part)
        batches.append((part, int(watermark * 3_600_000)))
    whole, seen, calls = played(8_192, batches)
    assert seen == list(range(91))
    assert calls < 91
    for few in (0, 3, 25):
        got, seen, _ = played(few, batches)
        assert seen == list(range(91))
        assert all(np.isnan(got[i]) if np.isnan(whole[i]) else got[i] == whole[i] for i in whole)


def test_alarms_go_on_over_batches(spark):
    rows = events(450, 3)
    got = replayed(spark, rows, running_alarm(3.0, 10))
    for own in in_order(rows).values():
        for i, r in enumerate(own):
            before = [q[3] for q in own[:i]]
            alarm = len(before) >= 10 and abs(r[3] - np.mean(before)) > 3 * np.std(before, ddof=1)
            assert got[r[0]] == float(alarm)


def fit_rows(spark, i):
    return spark.range(200).selectExpr("id", f"double((id * 37 + {i}) % 101) / 101 AS a", f"double((id * 53 + {i}) % 97) / 97 AS b", "double((id * 37) % 101 > 50) AS y")


def test_online_fit_survives_a_repeated_batch_and_a_new_session(spark, tmp_path):
    whole = BatchState(spark, str(tmp_path / "whole"))
    for i in range(4):
        online_fit(whole, ["a", "b"], "y")(fit_rows(spark, i), i)
    path = str(tmp_path / "cut")
    state = BatchState(spark, path)
    for i in (0, 1):
        online_fit(state, ["a", "b"], "y")(fit_rows(spark, i), i)
    # killed while batch 2 was being written: a folder without its marker
    state.write(2, spark.createDataFrame([([9.0, 9.0, 9.0],)], "weights array<double>"))
    os.remove(f"{path}/batch=2/_SUCCESS")
    assert state.batches() == [0, 1]
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from larkspur.session import build_session
from larkspur.streaming.durable import BatchState
from larkspur.plans.flows import online_fit
from tests.test_streams import fit_rows
spark = build_session("2", "second")
state = BatchState(spark, {path!r})
for i in (1, 2, 3):
    online_fit(state, ["a", "b"], "y")(fit_rows(spark, i), i)
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    want, got = ({r.batch: r.weights for r in s.all().collect()} for s in (whole, BatchState(spark, path)))
    assert sorted(got) == [0, 1, 2, 3] and all(got[b] == pytest.approx(want[b]) for b in got)
    state.forget(1)
    assert state.batches() == [3]


def test_late_rows_over_many_batches(spark):
    """Each batch of one file; the counts and the late rows equal a batch job over all rows."""
    rng = random.Random(7)
    batches = [[(b * 10 + j, START + dt.timedelta(minutes=10 * b - (rng.choice([0, 0, 30, 300])), seconds=rng.randrange(500)), 1, 1.0) for j in range(5)] for b in range(40)]
    r = Replay(spark, "late")
    for b in batches:
        r.land(spark.createDataFrame(b, SCHEMA).coalesce(1))
    heard = Progress()
    spark.streams.addListener(heard)
    each = late_split(spark, f"{r.root}/state", "ts", "1 hour", "1 hour", lambda d: d.groupBy("start").agg(F.count(F.lit(1)).alias("n")))
    order = []

    def noted(batch, batch_id):
        order.append(sorted(q.event_id for q in batch.collect()))
        each(batch, batch_id)

    r.run_batches(lambda s: s, noted, files=1)
    by_id = {q[0]: q for b in batches for q in b}
    latest, late, counts = None, set(), {}
    for ids in order:
        for i in ids:
            hour = by_id[i][1].replace(minute=0, second=0, microsecond=0)
            if latest is not None and hour + dt.timedelta(hours=1) <= latest - dt.timedelta(hours=1):
                late.add(i)
            else:
                counts[hour] = counts.get(hour, 0) + 1
        latest = max([by_id[i][1] for i in ids] + ([latest] if latest else []))
    assert len(order) == 40 and late
    assert {q.event_id for q in BatchState(spark, f"{r.root}/state/late").all().collect()} == late
    kept = BatchState(spark, f"{r.root}/state/kept").all().groupBy("start").agg(F.sum("n").alias("n")).collect()
    assert {q.start.replace(tzinfo=None): q.n for q in kept} == counts
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(heard)
    assert heard.batches >= 40 and heard.rows >= 200
