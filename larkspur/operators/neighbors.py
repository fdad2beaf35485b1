"""Exact k nearest neighbours as a Spark job over bounded blocks.

Base points are assigned to the nearest of a few pivots; a pivot's cell is split into sub-blocks of at
most ``block_rows`` points, so a cell holding a third of the table is many blocks.  A query first
searches one block of its own cell, which bounds its k-th distance, and is then sent only to the
cells that the triangle inequality cannot exclude.  Queries meeting a block are split too, so a task
holds at most ``block_rows`` x ``query_rows`` points and returns k rows per query: pairs are never
emitted.  The final merge sees k rows per visited block.

In more than ``_LOW_DIMS`` dimensions the second search streams instead: a task holds a part of the queries with their k best so
far and reads the cells they may need once, batch after batch, so neither queries nor hits are written per block.  A cheap bound
(single precision products, or small whole numbers for L1) names the few pairs that are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larkspur import session

_OUT = "qid bigint, bid bigint, dist double"


#: Sides of a tile of L1 distances: two such tiles fit a core's cache
_TILE_Q, _TILE_B = 16, 2048


def _l1(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, dimension by dimension inside tiles that stay in cache."""
    out = np.empty((len(q), len(b)))
    qt, bt = np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)
    for lo in range(0, len(q), _TILE_Q):
        for at in range(0, len(b), _TILE_B):
            x, y = qt[:, lo : lo + _TILE_Q, None], bt[:, None, at : at + _TILE_B]
            total = np.zeros((x.shape[1], y.shape[2]))
            part = np.empty_like(total)
            for j in range(len(x)):
                np.subtract(x[j], y[j], out=part)
                np.abs(part, out=part)
                total += part
            out[lo : lo + _TILE_Q, at : at + _TILE_B] = total
    return out


def _distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return _l1(q, b)
    return (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * q @ b.T


#: In so few dimensions a block is searched by boxes of so many points
_LOW_DIMS, _BOX = 8, 256


def _boxes(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of ``x`` in boxes of at most ``_BOX`` points: halves along the widest side."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= _BOX:
            done.append(at)
            continue
        side = x[at]
        order = np.argpartition(side[:, np.ptp(side, axis=0).argmax()], len(at) // 2)
        todo += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return done


def _top(qs: pd.DataFrame, bs: pd.DataFrame, k: int, metric: str, rule: str, radius: float) -> pd.DataFrame:
    """k nearest base rows of each query inside one block.

    In few dimensions queries and base points are cut into boxes; a box of queries meets boxes of base points from the nearest
    on, until the next is farther than the k-th neighbour of each of its queries.
    """
    qs, bs = _numbers(qs), _numbers(bs)
    if rule == "min_tag" or len(bs) <= 2 * _BOX or not len(qs) or len(qs["vec"].iloc[0]) > _LOW_DIMS:
        return _top_of_all(qs, bs, k, metric, rule, radius)
    base, query = np.stack(bs["vec"].to_numpy()).astype(float), np.stack(qs["vec"].to_numpy()).astype(float)
    boxes = _boxes(base)
    low, high = np.array([base[b].min(0) for b in boxes]), np.array([base[b].max(0) for b in boxes])
    found = []
    for mine in _boxes(query):
        q = query[mine]
        gaps = np.maximum(0.0, np.maximum(low - q.max(0), q.min(0) - high))
        far = gaps.sum(1) if metric == "l1" else np.sqrt((gaps * gaps).sum(1))
        order, asked = np.argsort(far, kind="stable"), qs.iloc[mine]
        # distances of the boxes are rounded as well: a margin far above that, far below any distance that matters
        far = far[order] * (1 - 1e-9) - 1e-12
        best, at, reach = None, 0, radius
        while at < len(order) and far[at] <= reach:
            step = np.searchsorted(far, 0.0, side="right") if at == 0 else at * 2
            step = min(max(step, at + 1), int(np.searchsorted(far, reach, side="right")))
            part = _top_of_all(asked, bs.iloc[np.concatenate([boxes[b] for b in order[at:step]])], k, metric, rule, radius)
            best = part if best is None else pd.concat([best, part], ignore_index=True).sort_values(["qid", "dist", "bid"]).groupby("qid").head(k)
            kth = best.groupby("qid")["dist"].agg(["size", "max"])
            if len(kth) == asked["id"].nunique() and kth["size"].min() >= k:
                reach = min(radius, kth["max"].max())
            at = step
        if best is not None:
            found.append(best)
    return pd.concat(found, ignore_index=True) if found else _top_of_all(qs, bs.iloc[:0], k, metric, rule, radius)


def _top_of_all(qs: pd.DataFrame, bs: pd.DataFrame, k: int, metric: str, rule: str, radius: float) -> pd.DataFrame:
    """k nearest of all base rows, for each query."""
    if not len(qs) or not len(bs):
        return pd.DataFrame({"qid": [], "bid": [], "dist": []}).astype({"qid": "int64", "bid": "int64", "dist": "float64"})
    base, bid, btag = np.stack(bs["vec"].to_numpy()).astype(float), bs["id"].to_numpy(), bs["tag"].to_numpy()
    query, qid, qtag = np.stack(qs["vec"].to_numpy()).astype(float), qs["id"].to_numpy(), qs["tag"].to_numpy()
    size = float((base * base).sum(1).max())
    step = max(1, 1_000_000 // len(base))
    found = []
    for lo in range(0, len(query), step):
        q, ids, tags = query[lo : lo + step], qid[lo : lo + step], qtag[lo : lo + step]
        d = _distances(q, base, metric)
        if rule == "min_tag":
            found.append(_least_tag(q, ids, base, btag, d, size, radius))
            continue
        if rule == "not_self":
            d[ids[:, None] == bid[None, :]] = np.inf
        elif rule == "earlier":
            d[~(btag[None, :] < tags[:, None])] = np.inf
        elif rule == "other_tag":
            d[btag[None, :] == tags[:, None]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 0.0 if metric == "l1" else 1e-9 * (size + (q * q).sum(1))
        rows, cols = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
        if metric == "l1":
            exact = d[rows, cols]
        else:
            exact = np.sqrt(((q[rows] - base[cols]) ** 2).sum(1))
        near = exact <= radius
        rows, cols, exact = rows[near], cols[near], exact[near]
        order = np.lexsort((bid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        found.append(pd.DataFrame({"qid": ids[rows[keep]], "bid": bid[cols[keep]], "dist": exact[keep]}))
    return pd.concat(found, ignore_index=True)


#: Base rows of a query's own cell that give its first bound where the search streams
_FIRST_ROWS = 2048
#: Pairs looked at together, pairs measured exactly together, and pairs that wait to be merged
_PAIRS, _EXACT, _WAITING = 1 << 21, 1 << 16, 1 << 20


class _Part:
    """Queries of one part with their k best rows so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, tags: np.ndarray, tau: np.ndarray, cells: list, k: int, metric: str, rule: str, radius: float):
        self.ids, self.tags, self.k, self.metric, self.rule, self.radius = ids, tags, k, metric, rule, radius
        self.vecs, self.tau = vecs, np.minimum(tau, radius)
        self.best = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.asked: dict[int, list[int]] = {}
        for i, mine in enumerate(cells):
            for c in mine:
                self.asked.setdefault(c, []).append(i)
        self.waiting: list[tuple] = []
        good = vecs[np.isfinite(vecs).all(1)]
        self.centre = good.mean(0) if len(good) else np.zeros(vecs.shape[1])
        if metric == "l1" and len(good):
            # any whole-number scale gives a lower bound: values beyond it are moved to its ends, which shortens distances
            low, middle, high = np.quantile(good, [.001, .5, .999], axis=0)
            bound = self.tau[np.isfinite(self.tau)]
            wide, enough = float((high - low).max()), 2 * float(np.median(bound)) if len(bound) else math.inf
            self.low, self.levels = low if wide <= enough else middle - enough / 2, min(4095, 65_535 // vecs.shape[1] - 1)
            self.unit = min(wide, enough) / max(self.levels, 1)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.nan_to_num(np.clip(np.rint((x - self.low) / self.unit), 0, self.levels)).astype(np.int16).T)

    def _reach(self, at: np.ndarray) -> np.ndarray:
        return self.tau[at] * (1 + 1e-9) + 1e-12

    def _near_l1(self, at: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose sum of rounded differences is within reach: rounding takes at most a unit per dimension."""
        if not hasattr(self, "unit") or self.levels < 64 or self.unit <= 0:
            yield from self._near_exact(at, base)
            return
        bound = self._reach(at) / self.unit + base.shape[1] * (1 + 1e-9)
        bound = np.where(bound < 65_535, np.floor(np.minimum(bound, 65_534)), 65_535).astype(np.uint16)
        q, b = self._codes(self.vecs[at]), self._codes(base)
        for lo in range(0, len(at), 2 * _TILE_Q):
            for bo in range(0, len(base), 2 * _TILE_B):
                x, y = q[:, lo:lo + 2 * _TILE_Q, None], b[:, None, bo:bo + 2 * _TILE_B]
                total = np.zeros((x.shape[1], y.shape[2]), np.uint16)
                part = np.empty(total.shape, np.int16)
                for j in range(len(x)):
                    np.subtract(x[j], y[j], out=part)
                    np.abs(part, out=part)
                    np.add(total, part.view(np.uint16), out=total)
                rows, cols = np.nonzero(total <= bound[lo:lo + 2 * _TILE_Q, None])
                yield rows + lo, cols + bo

    def _near_l2(self, at: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose squared distance by products is within reach and the products' rounding."""
        q, b = self.vecs[at] - self.centre, base - self.centre
        qq, bb, reach = (q * q).sum(1), (b * b).sum(1), self._reach(at) ** 2
        size = float(np.nanmax(qq, initial=0.0) + np.nanmax(bb, initial=0.0))
        slack, kind = (q.shape[1] + 8) * 2.0 ** -22 * size, np.float32
        if not size < 1e30 or slack > .02 * np.nanmedian(reach):
            slack, kind = 1e-9 * size, np.float64
        # one product holds the whole comparison: q.b - bb/2 + (reach - qq)/2 >= 0
        q = np.column_stack([q, np.ones(len(q)), (reach - qq + slack) / 2]).astype(kind)
        b = np.column_stack([b, -bb / 2, np.ones(len(b))]).astype(kind).T
        step = max(1, _PAIRS // len(base))
        for lo in range(0, len(at), step):
            rows, cols = np.nonzero(q[lo:lo + step] @ b >= 0)
            yield rows + lo, cols

    def _near_exact(self, at: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within reach by the distances themselves."""
        step = max(1, 1_000_000 // len(base))
        for lo in range(0, len(at), step):
            d = _distances(self.vecs[at[lo:lo + step]], base, self.metric)
            slack = 0.0 if self.metric == "l1" else 1e-9 * ((base * base).sum(1).max() + (self.vecs[at[lo:lo + step]] ** 2).sum(1))
            reach = self._reach(at[lo:lo + step])
            rows, cols = np.nonzero(d <= ((reach if self.metric == "l1" else reach * reach) + slack)[:, None])
            yield rows + lo, cols

    def _fits(self, mine: np.ndarray, cols: np.ndarray, bid: np.ndarray, tag: np.ndarray) -> np.ndarray:
        if self.rule == "not_self":
            return self.ids[mine] != bid[cols]
        if self.rule == "earlier":
            return tag[cols] < self.tags[mine]
        if self.rule == "other_tag":
            return tag[cols] != self.tags[mine]
        return np.ones(np.broadcast(mine, cols).shape, bool)

    def _first(self, at: np.ndarray, bid: np.ndarray, base: np.ndarray, tag: np.ndarray) -> None:
        """Measure the k nearest of these rows for queries that have no bound."""
        step, every, size = max(1, 1_000_000 // len(base)), np.arange(len(base)), (base * base).sum(1).max()
        for lo in range(0, len(at), step):
            mine = at[lo:lo + step]
            d = _distances(self.vecs[mine], base, self.metric)
            d[~self._fits(mine[:, None], every[None], bid, tag)] = np.inf
            last = min(self.k, len(base)) - 1
            kth = np.partition(d, last, axis=1)[:, last]
            slack = 0.0 if self.metric == "l1" else 1e-9 * (size + (self.vecs[mine] ** 2).sum(1))
            rows, cols = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
            for i in range(0, len(rows), _EXACT):
                self._measure(mine[rows[i:i + _EXACT]], cols[i:i + _EXACT], bid, base, tag)

    def see(self, cell: int, bid: np.ndarray, base: np.ndarray, tag: np.ndarray) -> None:
        at = np.array(self.asked.get(cell, ()), np.int64)
        if not len(at) or not len(bid):
            return
        free = ~np.isfinite(self.tau[at])
        if free.any():
            # no bound yet: the k best of these rows give one
            self._first(at[free], bid, base, tag)
            at = at[~free]
        if len(at):
            near = self._near_l1 if self.metric == "l1" else self._near_l2
            for rows, cols in near(at, base):
                for lo in range(0, len(rows), _EXACT):
                    self._measure(at[rows[lo:lo + _EXACT]], cols[lo:lo + _EXACT], bid, base, tag)
        if free.any() or sum(len(w[0]) for w in self.waiting) > max(_WAITING, len(self.ids) * self.k // 2):
            self.merge()

    def _measure(self, mine: np.ndarray, cols: np.ndarray, bid: np.ndarray, base: np.ndarray, tag: np.ndarray) -> None:
        ok = self._fits(mine, cols, bid, tag)
        mine, cols = mine[ok], cols[ok]
        if self.metric == "l1":
            # dimension after dimension, the order a plain sum takes
            exact = np.zeros(len(mine))
            for part in np.abs(self.vecs[mine] - base[cols]).T:
                exact += part
        else:
            exact = np.sqrt(((self.vecs[mine] - base[cols]) ** 2).sum(1))
        ok = exact <= self._reach(mine)
        ok &= exact <= self.radius
        self.waiting.append((mine[ok], bid[cols[ok]], exact[ok]))

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, ids, dist = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        hit = np.unique(rows)
        if not len(hit):
            return
        old = np.repeat(hit, self.k)
        rows, ids, dist = np.concatenate([old, rows]), np.concatenate([self.best[1][hit].ravel(), ids]), np.concatenate([self.best[0][hit].ravel(), dist])
        order = np.lexsort((ids, dist, rows))
        rows, ids, dist = rows[order], ids[order], dist[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self.best[0][rows[keep], place[keep]], self.best[1][rows[keep], place[keep]] = dist[keep], ids[keep]
        self.tau[hit] = np.minimum(self.tau[hit], self.best[0][hit, -1])

    def result(self) -> pa.RecordBatch:
        self.merge()
        there = np.isfinite(self.best[0])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(1))), pa.array(self.best[1][there]), pa.array(self.best[0][there])], names=["qid", "bid", "dist"])


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def _streamed(k: int, metric: str, rule: str, radius: float):
    """The k best base rows of the queries of each part; rows come by part, queries first, then base rows by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asking, part = None, [], None

        def settled() -> _Part:
            nonlocal asking
            cols = [[b.column(c).to_numpy(zero_copy_only=False) for b in asking] for c in ("id", "tag", "tau")]
            cells = [c for b in asking for c in b.column("cells").to_pylist()]
            made = _Part(np.concatenate(cols[0]), np.concatenate([_vectors(b) for b in asking]), np.concatenate(cols[1]), np.concatenate(cols[2]), cells, k, metric, rule, radius)
            asking = []
            return made

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("part", "kind", "cell")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                p, kind, cell = keys[:, lo].tolist()
                piece = b.slice(lo, hi - lo)
                if p != number:
                    if asking or part is not None:
                        yield (part or settled()).result()
                    number, part, asking = p, None, []
                if kind == 0:
                    asking.append(piece)
                    continue
                if part is None:
                    if not asking:
                        continue
                    part = settled()
                part.see(cell, piece.column("id").to_numpy(), _vectors(piece), piece.column("tag").to_numpy())
        if asking or part is not None:
            yield (part or settled()).result()

    return run


def _least_tag(q, ids, base, btag, d, size, radius) -> pd.DataFrame:
    """Smallest base tag within the radius of each query, returned as ``dist`` (nothing where none is near)."""
    rows, cols = np.nonzero(d <= radius * radius + 1e-9 * (size + (q * q).sum(1))[:, None])
    near = np.sqrt(((q[rows] - base[cols]) ** 2).sum(1)) <= radius
    best = np.full(len(q), np.inf)
    np.minimum.at(best, rows[near], btag[cols[near]])
    hit = np.isfinite(best)
    return pd.DataFrame({"qid": ids[hit], "bid": best[hit].astype("int64"), "dist": best[hit]})


def _points(df: DataFrame, key: str, vec: str, tag: Column | None) -> DataFrame:
    return df.select(
        F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"),
        (tag.cast("double") if tag is not None else F.lit(0.0)).alias("tag"))


def _numbers(df: pd.DataFrame) -> pd.DataFrame:
    """Rows whose distances are numbers: one that holds a null, NaN or infinity is near nothing, and would void its block's bounds."""
    return df[np.isfinite(np.stack(df["vec"].to_numpy()).astype(float)).all(1)] if len(df) else df


def _chain(points: np.ndarray) -> list[int]:
    """Points in an order that goes on to the nearest one left, so that neighbours stand side by side."""
    left, order = list(range(1, len(points))), [0]
    while left:
        d = ((points[left] - points[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return order


def _search_parts(asked: DataFrame, base: DataFrame, counts: dict[int, int], pivots: np.ndarray, part_rows: int, run) -> DataFrame:
    """Hits of the queries ``asked`` (with ``cell``, ``tau`` and the ``cells`` they may need) among ``base``, part by part.

    Cells in a chain of neighbours are cut into parts of about equal queries; a part gets every cell that one of its queries needs, once.
    """
    spark, n = asked.sparkSession, sum(counts.values())
    slots = spark.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / part_rows), min(slots, math.ceil(n / 500)))
    order = _chain(pivots)
    before = dict(zip(order, np.cumsum([0, *[counts.get(c, 0) for c in order[:-1]]]).tolist()))
    cells = range(len(pivots))
    spot = _pick([before[c] for c in cells], F.col("cell")) + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), _pick([counts.get(c, 0) for c in cells], F.col("cell"))))
    asked = session.cut(asked.withColumn("part", F.least(F.lit(parts - 1), F.floor(spot * parts / max(1, n))).cast("int")))
    need: dict[int, list[int]] = {}
    for r in asked.select("part", F.explode("cells").alias("cell")).distinct().collect():
        need.setdefault(r.cell, []).append(r.part)
    if not need:
        return spark.createDataFrame([], _OUT)
    where = spark.createDataFrame([(c, sorted(p)) for c, p in need.items()], "cell int, parts array<int>")
    names = ["part", "kind", "cell", "id", "vec", "tag", "tau", "cells"]
    left = asked.withColumns({"kind": F.lit(0), "cell": F.lit(-1)}).select(names)
    right = base.join(where, "cell").withColumn("part", F.explode("parts")).withColumns({"kind": F.lit(1), "tau": F.lit(None).cast("double"), "cells": F.lit(None).cast("array<int>")}).select(names)
    rows = left.unionByName(right).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "cell", "id")
    return rows.mapInArrow(run(), _OUT)


def _pick(values: list[int], cell: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), cell + 1)


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    qid: str,
    bid: str,
    qvec: str = "vec",
    bvec: str = "vec",
    metric: str = "l2",
    rule: str = "any",
    qtag: Column | None = None,
    btag: Column | None = None,
    radius: float = math.inf,
    block_rows: int | None = None,
    query_rows: int | None = None,
) -> DataFrame:
    """(qid, bid, dist, rn): the k nearest base rows per query, ties to the lower ``bid``.

    ``rule``: ``any``, ``not_self`` (ids differ), ``earlier`` (base tag < query tag), ``other_tag``,
    or ``min_tag`` (with k=1 and a radius: the smallest base tag within reach, as ``dist``).
    """
    block_rows = block_rows or session.block_rows(queries.sparkSession)
    query_rows = query_rows or block_rows
    part_rows = 4 * query_rows
    q, b = _points(queries, qid, qvec, qtag), _points(base, bid, bvec, btag)
    n_base = b.count()
    n_pivots = math.ceil(2 * n_base / block_rows) if n_base > block_rows else 1
    if not n_base:
        return queries.sparkSession.createDataFrame([], _OUT + ", rn int")
    pivots = np.zeros((1, 1))
    if n_pivots > 1:
        # ids first: vectors may cost much to make
        ids = [r.id for r in b.select("id").orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()]
        picked = np.array([r.vec for r in b.filter(F.col("id").isin(ids)).orderBy("id").limit(n_pivots).collect()], dtype=float)
        picked = picked[np.isfinite(picked).all(1)] if len(picked) else picked
        pivots = picked if len(picked) else np.zeros((1, len(b.select("vec").first().vec)))

    def to_pivots(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(float)
        if metric == "l1":
            return _distances(x, pivots, "l1")
        out = np.empty((len(x), len(pivots)))
        for j, p in enumerate(pivots):
            out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
        return out

    @F.pandas_udf("struct<cell:int,d:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        d = to_pivots(v)
        cell = d.argmin(1)
        d = d[np.arange(len(d)), cell]
        # not a number: near nothing, in no cell
        return pd.DataFrame({"cell": np.where(np.isfinite(d), cell, -1).astype("int32"), "d": d})

    if n_pivots == 1:
        # one cell: nothing to prune, only the block and query bounds remain
        n_query = q.count()
        slots = queries.sparkSession.sparkContext.defaultParallelism
        parts = max(1, math.ceil(n_query / query_rows), min(slots, math.ceil(n_query / 500)))
        one = [F.lit(0).alias("cell"), F.lit(0).alias("sub")]
        left = q.select("*", *one, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
        right = b.select("*", *one, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        group = ["cell", "sub", "part"]
        hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(lambda x, y: _top(x, y, k, metric, rule, radius), _OUT)
        return hits.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy("dist", "bid")))

    def celled(points: DataFrame) -> DataFrame:
        """Points with their cell, stored: they are read by every step below and may cost much to make."""
        made = points.withColumn("_a", assign("vec")).select("id", "vec", "tag", F.col("_a.cell").alias("cell"), F.col("_a.d").alias("d"))
        return session.cut(made)

    stored = celled(b)
    b = stored.filter("cell >= 0")
    same = queries is base and (qid, qvec) == (bid, bvec) and qtag is None and btag is None
    if same:
        # read anew: a search of a frame against itself needs two
        q = b.sparkSession.read.schema(b.schema).parquet(stored._scratch).filter("cell >= 0").drop("d")
    elif rule != "min_tag":
        q = celled(q).filter("cell >= 0").drop("d")
    stats = {r.cell: r for r in b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    cells = len(pivots)
    subs = [max(1, math.ceil(stats[c].n / block_rows)) if c in stats else 0 for c in range(cells)]
    reach = np.array([stats[c].far if c in stats else -1.0 for c in range(cells)])
    b = b.withColumn("sub", F.pmod(F.xxhash64("id"), _pick(subs, F.col("cell"))).cast("int")).drop("d")

    def search(asked: DataFrame, blocks: DataFrame, counts: dict[int, int], limit: int) -> DataFrame:
        parts = [max(1, math.ceil(counts.get(c, 0) / query_rows)) for c in range(cells)]
        left = asked.withColumn("part", F.pmod(F.xxhash64("id"), _pick(parts, F.col("cell"))).cast("int"))
        right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), _pick(parts, F.col("cell")) - 1)))
        group = ["cell", "sub", "part"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
            lambda x, y: _top(x, y, limit, metric, rule, radius), _OUT)

    streams = False
    if rule == "min_tag":
        asked = q.withColumn("tau", F.lit(radius))
    else:
        own = q.withColumn("sub", F.lit(0))
        counts = {r.cell: r["count"] for r in own.groupBy("cell").count().collect()}
        streams = pivots.shape[1] > _LOW_DIMS
        if streams:
            # a few rows of the own cell give a bound, which the stream tightens; queries are few enough for every core to have some
            slots = queries.sparkSession.sparkContext.defaultParallelism
            query_rows = max(1, min(query_rows, math.ceil(sum(counts.values()) / (2 * slots))))
            thin = [max(1, stats[c].n // max(_FIRST_ROWS, 2 * k)) if c in stats else 1 for c in range(cells)]
            first = search(own, b.filter(F.pmod(F.xxhash64("id", F.lit(7)), _pick(thin, F.col("cell"))) == 0).withColumn("sub", F.lit(0)), counts, k)
        else:
            first = search(own, b.filter("sub = 0"), counts, k)
        bound = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("tau"))
        asked = (q if streams else q.drop("cell")).join(bound, F.col("id") == bound["qid"], "left").drop("qid")
    cap = F.lit(radius)

    @F.pandas_udf("array<int>")
    def route(v: pd.Series, tau: pd.Series) -> pd.Series:
        low = to_pivots(v) - reach
        allowed = (low <= (tau.to_numpy() * (1 + 1e-9) + 1e-9)[:, None]) & (reach >= 0)
        return pd.Series([np.flatnonzero(r).astype("int32") for r in allowed])

    tau = F.least(F.coalesce("tau", F.lit(math.inf)), cap)
    best = W.partitionBy("qid").orderBy("dist", "bid")
    if streams:
        hits = _search_parts(asked.withColumn("tau", tau).withColumn("cells", route("vec", "tau")), b, counts, pivots, part_rows, lambda: _streamed(k, metric, rule, radius))
        # a query id that stands in several rows still gets k rows
        return hits.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    # stored: the first search is behind it, and the counts and the search below both read it
    asked = session.cut(asked.withColumn("cells", route("vec", tau)).drop("tau"))
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells")
    counts = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), _pick(subs, F.col("cell")) - 1)))
    hits = search(asked, b, counts, k)
    return hits.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)


def vote(hits: DataFrame, label: str, weight: Column | None = None) -> DataFrame:
    """Class with the most (weighted) votes per query; ties go to the class met first by rank."""
    w = weight if weight is not None else F.lit(1.0)
    per = hits.groupBy("qid", label).agg(F.sum(w).alias("votes"), F.min("rn").alias("first"))
    return per.groupBy("qid").agg(F.max_by(label, F.struct("votes", -F.col("first"))).alias("pred"))
