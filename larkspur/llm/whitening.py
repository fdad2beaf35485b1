"""Embedding whitening: identical vectors are grouped, the fit is a weighted centred product, each distinct vector is whitened once.

1. Entries become whole numbers and every vector's numbers one binary key, so rows with the same vector are one group.
2. Tasks sum the distinct vectors exactly, then multiply them centred; only a d x d matrix per vector length is collected.
3. Distinct vectors are projected once and joined back to the rows that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import prepare, table

COMPONENTS = 4
#: One entry of a vector is counted in steps of 1 / SCALE
SCALE = 256
#: An eigenvalue below this share of the trace is rounding, not variance
LEAST_SHARE = 1e-12


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x): the entries as 64-bit little-endian whole numbers; rows without a usable vector are left out."""
    for b in batches:
        vec = b.column("vec")
        vec = vec.filter(vec.is_valid())
        ids = b.column("id").filter(b.column("vec").is_valid())
        size = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
        ends = np.concatenate([[0], np.cumsum(size)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0)
        flat = flat[np.repeat(good, size)]
        size = size[good]
        scaled = np.floor(SCALE * flat)
        whole = np.clip(scaled, -2.0**62, 2.0**62).astype("<i8")
        ends = np.concatenate([[0], np.cumsum(size)]) * 8
        keys = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())])
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), keys.cast(pa.binary())], names=["id", "x"])


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) for each vector length in a batch."""
    keys = b.column("x")
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2], np.uint8) if len(keys) else np.zeros(0, np.uint8)
    size = np.diff(ends) // 8
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, data[ends[at][:, None] + np.arange(8 * d)].copy().view("<i8")


def _exact(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` in a type that holds sums of ``times`` such numbers exactly."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if top * times < 2**62 else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and dimension: weight and exact sum of the task's vectors."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        weight = b.column("weight").to_numpy()
        for at, x in _by_length(b):
            w = weight[at]
            n, s = total.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            total[x.shape[1]] = n + int(w.sum()), s + (_exact(x, int(w.sum()) + 1) * w[:, None]).sum(0).astype(object)
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(int(v)) for v in s])],
                                         names=["d", "i", "n", "s"])


def _moments(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            weight = b.column("weight").to_numpy()
            for at, x in _by_length(b):
                d = x.shape[1]
                c = x.astype(np.float64) - means[d]
                total[d] = total.get(d, 0.0) + (c * weight[at][:, None]).T @ c
        for d, m in total.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())],
                                             names=["d", "i", "j", "v"])
    return run


def fit_whitening(distinct: DataFrame, components: int) -> dict[int, dict]:
    """Per vector length: n, exact sums, mean, unit eigenvectors (by falling eigenvalue), eigenvalues, trace.

    ``distinct`` is a stored table (x, weight).  The driver holds d x d numbers for each length that occurs.
    """
    sums = distinct.mapInArrow(_sums, "d int, i int, n bigint, s string").groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    fits: dict[int, dict] = {}
    for r in sums:
        f = fits.setdefault(r.d, {"n": r.n, "sums": [0] * r.d})
        f["sums"][r.i] = int(r.s)
    for f in fits.values():
        f["mean"] = np.array([s / f["n"] for s in f["sums"]])
    products = {d: np.zeros((d, d)) for d in fits}
    for r in distinct.mapInArrow(_moments({d: f["mean"] for d, f in fits.items()}), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        products[r.d][r.i, r.j] = r.v
    for d, f in fits.items():
        v = (products[d] + products[d].T) / 2 / f["n"]
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        f["trace"] = float(np.trace(v))
        f["values"] = np.where(values > LEAST_SHARE * max(f["trace"], 0.0), values, 0.0)
        f["vectors"] = vectors
    return fits


def _project(fits: dict[int, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            deviation, white = [None] * m, [None] * m
            for at, x in _by_length(b):
                f = fits[x.shape[1]]
                e = f["values"]
                y = (x.astype(np.float64) - f["mean"]) @ f["vectors"]
                y = np.where(e > 0, y / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
                gap = f["n"] * (x if f["n"] * (max(abs(int(x.min())), abs(int(x.max()))) + 1) < 2**62 else x.astype(object))
                low = max(map(abs, f["sums"]), default=0)
                gap = gap - (np.array(f["sums"], np.int64) if low < 2**62 and gap.dtype != object else np.array(f["sums"], object))
                widest = max(abs(int(gap.min())), abs(int(gap.max())))
                far = ((gap if widest * widest * x.shape[1] < 2**63 else gap.astype(object)) ** 2).sum(1)
                for k, i in enumerate(at.tolist()):
                    deviation[i], white[i] = int(far[k]) if int(far[k]) < 2**63 else None, y[k].tolist()
            size = [len(k) // 8 for k in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("weight"), pa.array(size, pa.int32()), pa.array(deviation, pa.int64()),
                                              pa.array(white, pa.list_(pa.float64()))], names=["x", "weight", "d", "deviation", "white"])
    return run


def _identity_error(white: DataFrame, fits: dict[int, dict], components: int) -> dict[int, float]:
    """Per length: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    at = [F.get("white", F.lit(i)) for i in range(components)]
    w = F.col("weight")
    mean = {r.d: r for r in white.groupBy("d").agg(*[(F.sum(a * w) / F.sum(w)).alias(f"m{i}") for i, a in enumerate(at)]).collect()}
    errors = {}
    for d, f in fits.items():
        live = [i for i in range(min(components, d)) if f["values"][i] > 0]
        if not live:
            errors[d] = 0.0
            continue
        pairs = [(i, j) for i in live for j in live if i <= j]
        made = white.filter(F.col("d") == d).agg(*[(F.sum(w * (at[i] - mean[d][f"m{i}"]) * (at[j] - mean[d][f"m{j}"])) / F.sum(w)).alias(f"c{i}_{j}") for i, j in pairs]).first()
        errors[d] = max(abs(made[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return errors


def whiten(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) per row: the first ``components`` whitened values as an array.

    ``weights``: ``one`` fits on each distinct vector once, ``count`` on every row.  A row whose vector is null, empty or
    holds null or non-finite entries is dropped; a null or repeated key stays as it is.  Vectors of each length are a
    space of their own, with its own fit.  Entries beyond 2**62 / 256 count as that bound.  A component without variance
    has whitened and explained 0 and no part in ``identity_error``.  ``deviation`` is null where it exceeds a long.
    An empty table gives no row; other columns are not read.
    """
    prepare(rows.sparkSession)
    key_type = rows.schema[key].dataType.simpleString()
    keyed = table(rows.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).mapInArrow(_keys, f"id {key_type}, x binary"), "keys")
    count = F.count(F.lit(1))
    distinct = table(keyed.groupBy("x").agg(count.alias("weight")), "distinct")
    if weights == "one":
        distinct = distinct.withColumn("weight", F.lit(1).cast("bigint"))
    fits = fit_whitening(distinct, components)
    white = table(distinct.mapInArrow(_project(fits), "x binary, weight bigint, d int, deviation bigint, white array<double>"), "white")
    errors = _identity_error(white, fits, components)
    spark = rows.sparkSession
    shares = {d: [float(e / f["trace"]) if f["trace"] > 0 else 0.0 for e in f["values"]] for d, f in fits.items()}
    facts = spark.createDataFrame([(d, f["n"], shares[d], errors[d]) for d, f in fits.items()], "d int, n bigint, explained array<double>, identity_error double")
    # one row for each vector length: bounded by the lengths that occur
    white = white.drop("weight").join(F.broadcast(facts), "d")
    # the rows of a vector held by very many are split by the skew join; the distinct side holds it once
    return keyed.join(white.hint("merge"), "x").select(F.col("id").alias(key), "n", "deviation", F.col("white").alias("whitened"), "explained", "identity_error")


def whitening_report(rows: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    out = whiten(rows)
    flat = out.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"), "identity_error")
    return flat.select("vec_id", (F.col("component") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")
