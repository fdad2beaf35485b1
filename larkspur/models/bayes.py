"""Naive Bayes as counts and joins: fitting is one aggregate, scoring is one join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.clean import attach_one
from larkspur.session import cut

VAR_FLOOR = 1e-9  # fixed value: absolute variance smoothing


def gaussian_fit(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """One row per class: n, mean and population variance per feature."""
    return df.groupBy(F.col(y).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[(F.var_pop(c) + VAR_FLOOR).alias(f"v_{c}") for c in cols])


def gaussian_score(df: DataFrame, model: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``pred`` and ``prob`` per row; the model (classes x features) rides along as one scalar array."""
    packed = model.agg(F.array_sort(F.collect_list(F.struct("cls", "n", *[c for c in model.columns if c not in ("cls", "n")]))).alias("m"), F.sum("n").alias("total"))
    rows = attach_one(df, packed)

    def log_post(m: Column) -> Column:
        out = F.ln(m["n"] / F.col("total"))
        for c in cols:
            v = m[f"v_{c}"]
            out = out - 0.5 * F.ln(2 * F.pi() * v) - F.pow(F.col(c) - m[f"m_{c}"], 2) / (2 * v)
        return out

    rows = rows.withColumn("_lp", F.transform("m", log_post))
    top = F.array_max("_lp")
    total = F.aggregate("_lp", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return rows.withColumns({"pred": F.col("m")[F.array_position("_lp", top) - 1]["cls"], "prob": 1 / total}).drop("m", "total", "_lp")


def class_term_table(docs: DataFrame, y: str, min_docs: int) -> DataFrame:
    """(cls, term, n, docs) of the terms that ``min_docs`` documents hold, from each document's ``runs`` of (term, tf).

    A document adds a term once; occurrences and documents are summed per (class, term) map-side, then brought together per term:
    texts are read once, and no (document, term) pair is shuffled.
    """
    cells = docs.select(F.col(y).alias("cls"), F.inline("runs")).groupBy("cls", "term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    terms = cells.groupBy("term").agg(F.collect_list(F.struct("cls", "n", "docs")).alias("cells"), F.sum("docs").alias("docs"))
    return terms.filter(F.col("docs") >= min_docs).select("term", F.inline("cells")).select("cls", "term", "n", "docs")


def _full(table: DataFrame, labels: DataFrame, y: str) -> tuple[DataFrame, DataFrame]:
    """Every (class, term) cell of the vocabulary, zero where unseen, plus class priors."""
    classes = labels.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("n_docs"))
    names = classes.agg(F.collect_list("cls")).scalar()
    cells = table.select("term").distinct().withColumn("cls", F.explode(names))
    return cells.join(table, ["cls", "term"], "left").fillna(0, ["n", "docs"]), classes


def multinomial_fit(table: DataFrame, labels: DataFrame, y: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((cls, term, w), (cls, bias)): w = ln((N_ct + a) / (N_c + a d)), bias = ln prior."""
    full, classes = _full(table, labels, y)
    totals = full.groupBy("cls").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("d"))
    w = full.join(totals, "cls").select("cls", "term", F.ln((F.col("n") + alpha) / (F.col("n_all") + alpha * F.col("d"))).alias("w"))
    total = classes.agg(F.sum("n_docs")).scalar()
    return w, classes.select("cls", F.ln(F.col("n_docs") / total).alias("bias"))


def complement_fit(table: DataFrame, labels: DataFrame, y: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Weights from the counts of all other classes, negated."""
    full, classes = _full(table, labels, y)
    term = full.groupBy("term").agg(F.sum("n").alias("n_term"))
    comp = full.join(term, "term").select("cls", "term", (F.col("n_term") - F.col("n") + alpha).alias("c"))
    totals = comp.groupBy("cls").agg(F.sum("c").alias("c_all"))
    return comp.join(totals, "cls").select("cls", "term", (-F.ln(F.col("c") / F.col("c_all"))).alias("w")), classes.select("cls", F.lit(0.0).alias("bias"))


def bernoulli_fit(table: DataFrame, labels: DataFrame, y: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Presence model: the sum over absent terms goes into the bias, so only present terms are joined."""
    full, classes = _full(table, labels, y)
    p = full.join(classes, "cls").withColumn("p", (F.col("docs") + alpha) / (F.col("n_docs") + 2 * alpha))
    total = classes.agg(F.sum("n_docs")).scalar()
    absent = p.groupBy("cls").agg(F.sum(F.ln(1 - F.col("p"))).alias("a"), F.max("n_docs").alias("n_docs"))
    return p.select("cls", "term", (F.ln("p") - F.ln(1 - F.col("p"))).alias("w")), absent.select("cls", (F.ln(F.col("n_docs") / total) + F.col("a")).alias("bias"))


def wide_weights(w: DataFrame, classes: Sequence) -> DataFrame:
    """(term, w0, w1, ..): one column per class, so a join with terms does not multiply rows by classes."""
    return w.groupBy("term").agg(*[F.max(F.when(F.col("cls") == c, F.col("w"))).alias(f"w{i}") for i, c in enumerate(classes)])


#: Most frequent terms whose weights travel to the tasks; occurrences of the others are shuffled to them
HELD_TERMS = 100_000


def summed(pairs: DataFrame, key: str, term: str, weights: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(key, sums) of ``pairs`` joined to ``weights`` by ``term``, over all pairs with a weight.

    ``weights`` also holds ``n``, how often a term occurs.  The most frequent terms make up most pairs: these are joined where they
    lie and leave a task as one row per key; only pairs with rarer terms are shuffled.
    """
    stored = cut(weights)
    held = stored.orderBy(F.desc("n"), term).limit(HELD_TERMS)
    if stored.count() <= HELD_TERMS:
        found = pairs.join(F.broadcast(stored), term)
        return found.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    held = cut(held)
    near = pairs.join(F.broadcast(held), term).groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    far = pairs.join(F.broadcast(held.select(term)), term, "left_anti").join(stored.hint("merge"), term).groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return near.unionByName(far).groupBy(key).agg(*[F.sum(n).alias(n) for n in sums])


def term_scores(docs: DataFrame, key: str, table: DataFrame, models: Sequence[tuple[DataFrame, DataFrame]], binary: bool = False) -> list[DataFrame]:
    """(key, cls, score) of each model for every document and class, also for documents without a known term.

    The weights of all models lie side by side, so that documents' ``runs`` meet them once.
    """
    parts, known = [], []
    for m, (w, bias) in enumerate(models):
        known.append([(r.cls, r.bias) for r in bias.collect()])  # one row per class
        parts.append(w.select("term", F.lit(m).alias("m"), "cls", "w"))
    slots = {f"{m}_{i}": (F.col("m") == m) & (F.col("cls") == c) for m, k in enumerate(known) for i, (c, _) in enumerate(k)}
    wide = reduce(DataFrame.unionByName, parts).groupBy("term").agg(*[F.max(F.when(mine, F.col("w"))).alias(f"w{s}") for s, mine in slots.items()])
    weights = wide.join(table.groupBy("term").agg(F.sum("n").alias("n")), "term")
    times = F.lit(1) if binary else F.col("tf")
    sums = summed(docs.select(key, F.inline("runs")), key, "term", weights, {f"s{s}": times * F.col(f"w{s}") for s in slots})
    scored = docs.select(key).join(sums, key, "left")
    scored = cut(scored) if len(models) > 1 else scored
    return [scored.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("cls"), (F.lit(b) + F.coalesce(f"s{m}_{i}", F.lit(0.0))).alias("score")) for i, (c, b) in enumerate(k)])))
            for m, k in enumerate(known)]


def best_class(scores: DataFrame, key: str) -> DataFrame:
    """Highest score per document (ties to the larger class)."""
    return scores.groupBy(key).agg(F.max_by("cls", F.struct(F.round("score", 6), "cls")).alias("pred"), F.max("score").alias("score"))
