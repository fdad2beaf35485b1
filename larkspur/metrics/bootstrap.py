"""Bootstrap in one pass over the rows: sums of every resample, and its weighted ranks over one sorted order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larkspur.functions.scalar import MIX_PRIME, POISSON1
from larkspur.session import n_buckets

#: Rows whose weights for all resamples are held at a time
CHUNK = 1024
#: Rows whose weights are made together, one resample after the other: the arrays stay in a core's cache
STRIP = 16_384


def mix_numbers(key: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """:func:`larkspur.functions.scalar.mix_hash` of every key (rows) and seed (columns)."""
    m = np.int64(MIX_PRIME)
    low, high = (key & m)[:, None], ((key >> 31) & m)[:, None]
    s = seeds.astype(np.int64)[None, :]
    a = (low * 48271 + high * 69621 + s * 16807 + 1) % m
    b = (a * a + 31 * a + high * 127773) % m
    c = (b * 69621 + a * (s + 7)) % m
    return ((c * c + 8191 * c + a) % m) / float(MIX_PRIME)


def poisson_weights(key: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(POISSON1), mix_numbers(key, seeds), side="right").astype(np.float64)


def _least_numbers() -> list[int]:
    """The least hash that counts for each cumulative probability: comparing whole numbers is comparing the quotients."""
    out = []
    for p in POISSON1:
        lo, hi = 0, MIX_PRIME
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if mid / float(MIX_PRIME) >= p else (mid + 1, hi)
        out.append(lo)
    return out


def weighted_sums(key: np.ndarray, value: np.ndarray, reps: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights of :func:`poisson_weights`, and of weight times value, for the seeds 0..reps-1 (below 2**20).

    Remainders by the Mersenne prime are taken by shifts, in place; a number is reduced wholly only where its value counts.
    """
    m, shift = np.uint64(MIX_PRIME), np.uint64(31)
    steps = [np.uint32(t) for t in _least_numbers()]
    total, won = np.zeros(reps), np.zeros(reps)
    for lo in range(0, len(key), STRIP):
        k, v = key[lo:lo + STRIP], value[lo:lo + STRIP]
        low, high = k & MIX_PRIME, (k >> 31) & MIX_PRIME
        start = ((low * 48271 + high * 69621 + 1) % MIX_PRIME).astype(np.uint64)
        far = (high * 127773).astype(np.uint64)
        a, b, c = (np.empty(len(k), np.uint64) for _ in range(3))
        u, over, w = np.empty(len(k), np.uint32), np.empty(len(k), bool), np.empty(len(k), np.uint8)

        def fold() -> None:
            np.right_shift(b, shift, out=c)
            np.bitwise_and(b, m, out=b)
            np.add(b, c, out=b)

        def less(x: np.ndarray, room: np.ndarray) -> None:
            """``x`` minus the prime where it reaches it: the difference wraps to a huge number elsewhere."""
            np.subtract(x, m, out=room)
            np.minimum(x, room, out=x)

        for s in range(reps):
            np.add(start, np.uint64(s * 16807 % MIX_PRIME), out=a)
            less(a, b)
            np.add(a, np.uint64(31), out=b)
            np.multiply(a, b, out=b)
            np.add(b, far, out=b)
            fold()
            np.multiply(b, np.uint64(69621), out=b)
            np.multiply(a, np.uint64(s + 7), out=c)
            np.add(b, c, out=b)
            fold()
            np.add(b, np.uint64(8191), out=c)
            np.multiply(b, c, out=b)
            np.add(b, a, out=b)
            fold()
            fold()
            less(b, c)
            u[:] = b
            np.greater_equal(u, steps[0], out=w.view(bool))
            for t in steps[1:]:
                np.greater_equal(u, t, out=over)
                np.add(w, over.view(np.uint8), out=w)
            f = w.astype(np.float64)
            total[s] += f.sum()
            won[s] += f @ v
    return total, won


def _part_sums(reps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, won, keyed, known = np.zeros(reps), np.zeros(reps), 0, 0
        for b in batches:
            if b.num_rows:
                value, there = b.column("value").to_numpy(zero_copy_only=False), b.column("there").to_numpy(zero_copy_only=False)
                t, w = weighted_sums(b.column("key").to_numpy(), value, reps)
                total, won, keyed, known = total + t, won + w, keyed + b.num_rows, known + int(there.sum())
        if keyed:
            yield pa.RecordBatch.from_arrays([*(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (total, won)), pa.array([known], pa.int64())], names=["total", "won", "known"])

    return run


def bootstrap_mean(df: DataFrame, key: str, metric: Column, reps: int) -> DataFrame:
    """(rep, value): the weighted mean of ``metric`` in each Poisson resample.

    A row never becomes ``reps`` rows: a task streams its rows past ``reps`` running sums.  Rows without a key have no weight;
    a null metric adds nothing to the sum, as in SQL.  A resample that drew no row has no value.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), metric.cast("double").alias("value")).filter("key IS NOT NULL")
    rows = rows.select("key", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("there"))
    # every row costs as much as ``reps`` rows elsewhere: they are dealt evenly
    parts = rows.repartition(n_buckets(df.sparkSession)).mapInArrow(_part_sums(reps), "total array<double>, won array<double>, known bigint")
    flat = parts.select("known", F.posexplode(F.arrays_zip("total", "won")).alias("rep", "c")).select("rep", "known", "c.*")
    mean = F.when(F.sum("known") > 0, F.try_divide(F.sum("won"), F.sum("total")))
    return flat.groupBy("rep").agg(mean.alias("value"))


def _slice_ranks(reps: int):
    seeds = np.arange(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, won = np.zeros(reps), np.zeros(reps), np.zeros(reps)
        tie: tuple[float, np.ndarray, np.ndarray] | None = None
        any_rows = False

        def close(p: np.ndarray, n: np.ndarray) -> None:
            """Groups of equal scores, in order: hits win against all misses below and half of those beside."""
            nonlocal pos, neg, won
            below = neg + np.cumsum(n, 0) - n
            won = won + (p * (below + n / 2)).sum(0)
            pos, neg = pos + p.sum(0), neg + n.sum(0)

        for b in batches:
            score, y, key = (b.column(c).to_numpy() for c in ("score", "y", "key"))
            for lo in range(0, len(score), CHUNK):
                any_rows = True
                x, hit = score[lo:lo + CHUNK], y[lo:lo + CHUNK][:, None]
                w = poisson_weights(key[lo:lo + CHUNK], seeds)
                new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                p, n = np.add.reduceat(w * hit, new, axis=0), np.add.reduceat(w * (1 - hit), new, axis=0)
                if tie is not None:
                    if tie[0] == x[0]:
                        p[0] += tie[1]
                        n[0] += tie[2]
                    else:
                        close(tie[1][None], tie[2][None])
                tie = (float(x[-1]), p[-1], n[-1])
                close(p[:-1], n[:-1])
        if tie is not None:
            close(tie[1][None], tie[2][None])
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in (pos, neg, won)], names=["pos", "neg", "won"])

    return run


def bootstrap_auc(df: DataFrame, key: str, score: str, y: str, reps: int) -> DataFrame:
    """(rep, auc): the tie-aware area under the ROC curve of each Poisson resample.

    Rows are range-sorted by score once.  A slice streams past ``reps`` running sums and returns three arrays; the
    misses of the slices below are added at the end.  Weights come from the whole-number ``key`` and the resample
    alone, so they are the same after any retry.  Rows with a null score, target or key take no part.
    """
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("double").alias("y"), F.col(key).cast("bigint").alias("key")).dropna()
    ranged = rows.repartitionByRange(n_buckets(df.sparkSession), "score").sortWithinPartitions("score")
    parts = ranged.mapInArrow(_slice_ranks(reps), "pos array<double>, neg array<double>, won array<double>").withColumn("slice", F.spark_partition_id())
    flat = parts.select("slice", F.posexplode(F.arrays_zip("pos", "neg", "won")).alias("rep", "c")).select("slice", "rep", "c.*")
    below = W.partitionBy("rep").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    flat = flat.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return flat.groupBy("rep").agg(F.try_divide(F.sum(F.col("won") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")).alias("auc"))
