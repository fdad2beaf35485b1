"""Score-ordered metrics.  Every order over the whole table is a two-pass prefix sum (operators.prefix)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from larkspur.operators.prefix import global_cumsum, pick_ranks

def one() -> Column:
    return F.lit(1).cast("bigint")


def score_table(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct score, highest first: n, pos and their cumulative and total counts.

    ``cum_n``/``cum_pos`` are the rows and hits at threshold = score (rule: score >= threshold).
    """
    return global_cumsum(df, score, {"n": one(), "pos": F.col(y).cast("bigint"), **(extra or {})}, keys, descending=True)


def with_rates(table: DataFrame) -> DataFrame:
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    p, neg = F.col("tot_pos"), F.col("tot_n") - F.col("tot_pos")
    return table.withColumns({
        "tpr": F.try_divide(tp, p), "fpr": F.try_divide(fp, neg), "precision": F.try_divide(tp, F.col("cum_n")),
        "recall": F.try_divide(tp, p)})


def roc_auc(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the tie-aware rank sum, per key."""
    s = score_table(df, score, y, keys)
    # pairs (positive above negative) counted per score: negatives strictly below, plus half the ties
    neg, below = F.col("n") - F.col("pos"), F.col("tot_n") - F.col("tot_pos") - (F.col("cum_n") - F.col("cum_pos"))
    won = F.sum(F.col("pos") * (below + neg / F.lit(2.0)))
    return s.groupBy(*keys).agg((won / F.nullif(F.max(F.col("tot_pos") * (F.col("tot_n") - F.col("tot_pos"))), F.lit(0))).alias("auc"))


def _won_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, neg, pos, won) of one range of rising scores; won: its pairs of a positive above a negative, ties half.  Only one batch is held."""
    low, below, hits, won = None, 0.0, 0.0, 0.0
    for b in batches:
        if b.num_rows:
            s, n, pos = (b.column(c).to_numpy() for c in range(3))
            neg = n - pos
            low = s[0] if low is None else low
            won += float((pos * (below + np.cumsum(neg) - neg / 2)).sum())
            below, hits = below + float(neg.sum()), hits + float(pos.sum())
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (low, below, hits, won)], names=["low", "neg", "pos", "won"])


class AreaUnderRoc(Evaluator):
    """The exact area under the ROC curve of a model's raw predictions (ties half) as an evaluator for tuners.

    Scores are computed once, equal ones are added up, and ranges of them are sorted and streamed; the driver holds one
    row per range.  ``BinaryClassificationEvaluator`` sorts boxed pairs, reads them four times and thins the curve.
    """

    def __init__(self, label: str = "y", raw: str = "rawPrediction", weight: str | None = None):
        super().__init__()
        self.label, self.raw, self.weight = label, raw, weight

    def _evaluate(self, dataset: DataFrame) -> float:
        score = F.col(self.raw) if isinstance(dataset.schema[self.raw].dataType, T.NumericType) else vector_to_array(self.raw)[1]
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        flat = dataset.select(score.cast("double").alias("s"), F.col(self.label).cast("double").alias("y"), weight.cast("double").alias("w"))
        counts = flat.groupBy("s").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")).cache()
        try:
            ranges = counts.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_won_pairs, "low double, neg double, pos double, won double").collect()
        finally:
            counts.unpersist()
        low, neg, pos, won = np.array(ranges, float).reshape(-1, 4)[np.argsort([r.low for r in ranges])].T
        pairs = pos.sum() * neg.sum()
        if not pairs:
            # as Spark's own evaluator has it: the curve goes straight to (1, 1)
            return 0.0 if neg.sum() else 1.0 if pos.sum() else 0.5
        return float((won + pos * (np.cumsum(neg) - neg)).sum() / pairs)


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    s = score_table(df, score, y)
    return s.agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.max("tot_pos")).alias("ap"))


def ks_statistic(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return with_rates(score_table(df, score, y)).agg(F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks"))


def threshold_grid(df: DataFrame, grid: Sequence[float], score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at every grid threshold.

    A row is counted once, in the highest threshold it reaches; the grid (not the data) is then summed
    from the top, so nothing is multiplied by the number of thresholds.
    """
    keys, steps = list(keys), sorted(grid)
    step = F.size(F.filter(F.array(*[F.lit(float(g)) for g in steps]), lambda g: g <= F.col(score)))
    cells = df.groupBy(*keys, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    # one struct per threshold: a row group in cell c passes thresholds 1..c
    table = cells.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("step") >= i + 1, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(steps))],
        *[F.sum(F.when(F.col("step") >= i + 1, F.col("pos")).otherwise(0)).alias(f"p{i}") for i in range(len(steps))],
        F.sum("n").alias("tot_n"), F.sum("pos").alias("tot_pos"))
    cellss = F.array(*[F.struct(F.lit(g).cast("double").alias("threshold"), F.col(f"n{i}").alias("cum_n"), F.col(f"p{i}").alias("cum_pos")) for i, g in enumerate(steps)])
    return table.select(*keys, "tot_n", "tot_pos", F.inline(cellss))


def confusion_rates(table: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR and accuracy from cumulative counts (0 where undefined)."""
    tp, fp = F.col("cum_pos").cast("double"), (F.col("cum_n") - F.col("cum_pos")).cast("double")
    p, n = F.col("tot_pos"), F.col("tot_n")
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return table.withColumns({
        "precision": safe(tp, tp + fp), "recall": safe(tp, p.cast("double")), "f1": safe(2 * tp, tp + fp + p),
        "fpr": safe(fp, (n - p).cast("double")), "accuracy": (tp + (n - p - fp)) / n})


def gini_lorenz(df: DataFrame, pred: str, loss: Column) -> DataFrame:
    """Gini of the loss when rows are ordered by prediction: 1 - 2 * area under the Lorenz curve."""
    s = global_cumsum(df, pred, {"n": one(), "loss": loss})
    width = F.col("n") / F.col("tot_n")
    height = (2 * F.col("cum_loss") - F.col("loss")) / (2 * F.col("tot_loss"))
    return s.agg((1 - 2 * F.sum(width * height)).alias("gini"))


def qini_points(df: DataFrame, score: str, treatment: str, y: str) -> DataFrame:
    """Cumulative treated hits minus control hits rescaled to the treated count, highest score first."""
    t = F.col(treatment)
    s = global_cumsum(df, score, {
        "n": one(), "nt": t.cast("bigint"), "yt": (t * F.col(y)).cast("bigint"), "yc": ((1 - t) * F.col(y)).cast("bigint")}, descending=True)

    def q(n, nt, yt, yc):
        return yt - F.coalesce(F.try_divide(yc * nt, n - nt), F.lit(0.0))

    cur = [F.col(f"cum_{c}").cast("double") for c in ("n", "nt", "yt", "yc")]
    prev = [F.col(f"cum_{c}").cast("double") - F.col(c) for c in ("n", "nt", "yt", "yc")]
    return s.withColumns({"qini": q(*cur), "_prev": q(*prev), "share": F.col("cum_n") / F.col("tot_n"), "_w": F.col("n") / F.col("tot_n")})


def auuc(df: DataFrame, score: str, treatment: str, y: str) -> DataFrame:
    s = qini_points(df, score, treatment, y)
    return s.agg(F.sum(F.col("_w") * (F.col("qini") + F.col("_prev")) / 2).alias("auuc"))


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap between two empirical distribution functions and its asymptotic p-value."""
    both = a.select(value, F.lit(1).alias("_a")).unionByName(b.select(value, F.lit(0).alias("_a")))
    s = global_cumsum(both, value, {"na": F.col("_a").cast("bigint"), "nb": (1 - F.col("_a")).cast("bigint")})
    d = F.max(F.abs(F.col("cum_na") / F.col("tot_na") - F.col("cum_nb") / F.col("tot_nb")))
    out = s.agg(d.alias("d"), F.max("tot_na").cast("double").alias("na"), F.max("tot_nb").cast("double").alias("nb"))
    lam = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("d")
    terms = [2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return out.select("d", F.when(lam < 1e-3, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).alias("p_value"))


def split_conformal(df: DataFrame, score: str, segment: str, alpha: float, min_rows: int = 100) -> DataFrame:
    """Conformal offset per segment; segments below ``min_rows`` use the overall offset."""
    rank = {"picked": lambda total: F.least(F.ceil((total + 1) * (1 - alpha)), total)}
    overall = pick_ranks(df, score, rank).select("picked").scalar()
    own = pick_ranks(df, score, rank, [segment])
    return own.select(segment, F.col("tot_n").alias("n"), F.when(F.col("tot_n") >= min_rows, F.col("picked")).otherwise(overall).alias("offset"))
