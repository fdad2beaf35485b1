"""Gradient boosting on cells: rows of equal bins and label are one row with their count.

Trees see bins alone, so a cell is its rows.  Every setting of a sweep is boosted in the same passes: a pass adds up gradients
per node and bin, the driver picks the splits.  A subsample is drawn row by row: a round keeps each of the ``n`` rows of a cell
or leaves it, by a hash of the cell, the row's number in it and the round, so a retry draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: So many tasks send their sums of a pass to the driver as they are
FEW_TASKS = 16
#: Rows whose draws are held at a time
DRAWN = 1 << 20
_STATE = "bins binary, y binary, n binary, score binary"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Setting:
    """One run: ``l2`` and ``l1`` shrink the leaves and count in the gain of a split (the reference's lambda and alpha)."""
    step: float
    subsample: float = 1.0
    depth: int = 3
    l2: float = 1.0
    l1: float = 0.0
    rounds: int = 10
    seed: int = 1
    least: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order: the feature asked (-1 in a leaf), which of its bins go right, the leaf's value."""
    feature: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, width: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return Tree(np.full(nodes, -1, np.int16), np.zeros((nodes, width), bool), np.zeros(nodes))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every cell (``bins``: features x cells) after so many questions."""
        at, here = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + self.right[at, bins[f, here]], at)
        return at


@dataclass
class Boosted:
    """A fitted run; ``transform`` adds the log-odds as ``rawPrediction``."""
    columns: Sequence[str]
    start: float
    step: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            out += self.step * tree.value[tree.places(bins, self.depth)]
        return out

    def transform(self, cells: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def scored(c: pd.DataFrame) -> pd.Series:
            return pd.Series(self.scores(c.to_numpy().T))

        return cells.withColumn("rawPrediction", scored(F.struct(*self.columns)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(bins: np.ndarray, y: np.ndarray, n: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """How many of each cell's ``n`` rows a round keeps: every row by itself, with probability ``share``.  Cells differ in bins or label."""
    if share >= 1:
        return n
    code = _mixed(y.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn) * int(_GOLDEN) % 2**64))
    for b in bins:
        code = _mixed(code + _GOLDEN + b.astype(np.uint64))
    ends = np.cumsum(n.astype(np.int64))
    begins, kept, bound = ends - n.astype(np.int64), np.zeros(len(n)), np.uint64(int(share * 2**64))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, DRAWN):
        row = np.arange(lo, min(lo + DRAWN, int(ends[-1])))
        cell = np.searchsorted(ends, row, side="right")
        take = _mixed(code[cell] + (row - begins[cell]).astype(np.uint64) * _GOLDEN) < bound
        kept += np.bincount(cell[take], minlength=len(n))
    return kept


def _unpack(b: pa.RecordBatch, runs: int) -> Iterator[tuple[np.ndarray, ...]]:
    for bins, y, n, score in zip(*(b.column(c) for c in ("bins", "y", "n", "score"))):
        y, n = np.frombuffer(y.as_buffer()), np.frombuffer(n.as_buffer())
        yield np.frombuffer(bins.as_buffer(), np.uint16).reshape(-1, len(y)), y, n, np.frombuffer(score.as_buffer()).reshape(runs, len(y))


def _pack(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p[i]).tobytes() for p in parts], pa.binary()) for i in range(4)], names=["bins", "y", "n", "score"])


def _begin(columns: Sequence[str], y: str, n: str, runs: int, start: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = np.stack([b.column(c).to_numpy() for c in columns]).astype(np.uint16)
                yield _pack([(bins, b.column(y).to_numpy().astype(float), b.column(n).to_numpy().astype(float), np.full((runs, b.num_rows), start))])

    return run


def _grown(settings: Sequence[Setting], trees: Sequence[Tree | None]):
    """The scores after a round's trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bins, y, n, score in _unpack(b, len(settings)):
                new = score.copy()
                for i, (s, t) in enumerate(zip(settings, trees)):
                    if t is not None:
                        new[i] += s.step * t.value[t.places(bins, s.depth)]
                yield _pack([(bins, y, n, new)])

    return run


def _sums(settings: Sequence[Setting], trees: Sequence[Tree], open_nodes: dict[int, list[int]], level: int, turn: int, width: int):
    """Sums of gradients and curvatures per run, open node, feature and bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for bins, y, n, score in _unpack(b, len(settings)):
                draws: dict[tuple, np.ndarray] = {}
                for i, nodes in open_nodes.items():
                    s = settings[i]
                    if (s.subsample, s.seed) not in draws:
                        draws[s.subsample, s.seed] = drawn(bins, y, n, s.subsample, s.seed, turn)
                    w = draws[s.subsample, s.seed]
                    p = 1 / (1 + np.exp(-score[i]))
                    slot = np.full(len(trees[i].feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[trees[i].places(bins, level)]
                    inside = (at >= 0) & (w > 0)
                    inside = slice(None) if inside.all() else np.flatnonzero(inside)
                    at, g, h = at[inside] * width, (w * (p - y))[inside], (w * p * (1 - p))[inside]
                    if i not in total:
                        total[i] = np.zeros((2, len(bins), len(nodes) * width))
                    for j, bin_ in enumerate(bins):
                        place = at + bin_[inside]
                        total[i][0, j] += np.bincount(place, g, len(nodes) * width)
                        total[i][1, j] += np.bincount(place, h, len(nodes) * width)
        for i, t in total.items():
            g, h = t.reshape(2, -1)
            there = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), i)), pa.array(there), pa.array(g[there]), pa.array(h[there])], names=["run", "at", "g", "h"])

    return run


def _worth(g, h, s: Setting):
    return np.where(h + s.l2 > 0, np.maximum(np.abs(g) - s.l1, 0) ** 2 / np.maximum(h + s.l2, 1e-300), 0.0)


def _leaf(g: float, h: float, s: Setting) -> float:
    return float(-np.sign(g) * max(abs(g) - s.l1, 0.0) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def _split(g: np.ndarray, h: np.ndarray, nominal: Sequence[bool], s: Setting):
    """The best question on a node's sums (features x bins): (gain, feature, bins that go right), or None."""
    all_g, all_h = g[0].sum(), h[0].sum()
    best = None
    for j, by_value in enumerate(nominal):
        rg, rh = (g[j], h[j]) if by_value else (all_g - np.cumsum(g[j]), all_h - np.cumsum(h[j]))
        lg, lh = all_g - rg, all_h - rh
        gain = np.where((lh >= s.least) & (rh >= s.least), _worth(lg, lh, s) + _worth(rg, rh, s) - _worth(all_g, all_h, s), -1.0)
        # equal gains go to the earlier feature and bin, whatever the order the sums were added in
        gain = np.round(gain, 7)
        k = int(gain.argmax())
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            side = np.arange(len(gain))
            best = (gain[k], j, side == k if by_value else side > k)
    return best


def boost(cells: DataFrame, columns: Sequence[str], nominal: Sequence[str], settings: Sequence[Setting], y: str = "y", n: str = "n") -> list[Boosted]:
    """A model per setting: log-odds of the mean first, then Newton trees on the gradients of the log loss.

    ``cells`` holds whole-number bins from 0 in ``columns`` (those of ``nominal`` are asked value by value), the label 0/1 and
    the count of rows.  The scores of all runs are kept with the cells, packed by batch; a pass per level reads them.
    """
    first = cells.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(y)).alias("pos"), *[F.max(c).alias(c) for c in columns]).first()
    if not first.n:
        raise ValueError("no rows to learn from")
    width = 1 + max(int(first[c]) for c in columns)
    share = min(max(first.pos / first.n, 1e-12), 1 - 1e-12)
    models = [Boosted(columns, float(np.log(share / (1 - share))), s.step, s.depth) for s in settings]
    by_value = [c in nominal for c in columns]
    # a shuffle per pass pays where many tasks would each send their sums to the driver
    crowded = cells.rdd.getNumPartitions() > FEW_TASKS
    state = cells.select(*columns, y, n).mapInArrow(_begin(columns, y, n, len(settings), models[0].start), _STATE).persist()
    rounds, before = max(s.rounds for s in settings), None
    for turn in range(rounds):
        live = [i for i, s in enumerate(settings) if turn < s.rounds]
        trees = [Tree.empty(s.depth, width) for s in settings]
        open_nodes = {i: [0] for i in live}
        for level in range(max(settings[i].depth for i in live)):
            found = state.mapInArrow(_sums(settings, trees, open_nodes, level, turn, width), "run long, at long, g double, h double")
            sums = {i: np.zeros((2, len(columns) * len(nodes) * width)) for i, nodes in open_nodes.items()}
            if crowded:
                found = found.groupBy("run", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            table = found.toArrow()
            if before is not None:
                # this pass has read all scores it was made from
                before.unpersist()
                before = None
            run, at, g, h = (table.column(c).to_numpy() for c in ("run", "at", "g", "h"))
            ahead: dict[int, list[int]] = {}
            for i, nodes in open_nodes.items():
                s, t = settings[i], trees[i]
                for side, part in zip(sums[i], (g, h)):
                    side += np.bincount(at[run == i], part[run == i], len(side))
                shaped = sums[i].reshape(2, len(columns), len(nodes), width)
                for k, node in enumerate(nodes):
                    ng, nh = shaped[0, :, k], shaped[1, :, k]
                    t.value[node] = _leaf(ng[0].sum(), nh[0].sum(), s)
                    split = _split(ng, nh, by_value, s)
                    if split is None:
                        continue
                    _, j, right = split
                    t.feature[node], t.right[node] = j, right
                    for child, side in ((2 * node + 1, ~right), (2 * node + 2, right)):
                        t.value[child] = _leaf(ng[j][side].sum(), nh[j][side].sum(), s)
                        if level + 1 < s.depth:
                            ahead.setdefault(i, []).append(child)
            open_nodes = ahead
            if not open_nodes:
                break
        for i in live:
            models[i].trees.append(trees[i])
        if turn + 1 < rounds:
            before, state = state, state.mapInArrow(_grown(settings, [trees[i] if i in live else None for i in range(len(settings))]), _STATE).persist()
    if before is not None:
        before.unpersist()
    state.unpersist()
    return models


def judged(cells: DataFrame, models: Sequence[Boosted], by: str, y: str = "y", n: str = "n") -> dict[tuple, tuple[float, float]]:
    """(accuracy, log loss) per (model number, value of ``by``), all models in one pass."""
    columns = models[0].columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.stack([b.column(c).to_numpy() for c in columns])
            label, count, part = (b.column(c).to_numpy(zero_copy_only=False) for c in (y, n, by))
            for i, m in enumerate(models):
                score = m.scores(bins)
                right, lost = count * ((score >= 0) == (label == 1)), count * np.logaddexp(0, np.where(label == 1, -score, score))
                for v in (False, True):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (i, v, *(float(z[part == v].sum()) for z in (right, lost, count)))], names=["run", "part", "right", "lost", "n"])

    found = cells.select(*columns, y, n, by).mapInArrow(run, "run long, part boolean, right double, lost double, n double")
    found = found.groupBy("run", "part").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("lost").alias("lost")).filter("n > 0")
    return {(r.run, r.part): (r.right / r.n, r.lost / r.n) for r in found.collect()}


def on_cells(base: type, columns: Sequence[str], nominal: Sequence[str]) -> type:
    """``base``, a boosted classifier of ``pyspark.ml``, fitted by :func:`boost` on cells: its rounds, depth, step, subsample and seed."""
    class OnCells(base):
        def _fit(self, dataset: DataFrame) -> Boosted:
            s = Setting(self.getStepSize(), self.getSubsamplingRate(), self.getMaxDepth(), rounds=self.getMaxIter(), seed=self.getSeed())
            return boost(dataset, columns, nominal, [s], self.getLabelCol(), self.getWeightCol())[0]

    return OnCells
