"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Three disjoint parts of the labelled rows are used: one teaches the lexicons, one grows the trees, one calibrates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import prepare, table
from larkspur.llm.words import sequences, word_numbers

#: Most labelled rows for the lexicons, the trees and the calibration; least toxic texts for a lexicon entry; entries per lexicon
LEXICON_ROWS, TREE_ROWS, CALIBRATION_ROWS, LEAST = 30_000, 16_000, 12_000, 4
TREES, DEPTH = 40, 4
LIMIT = 0.3
#: Bytes of the stems that words are also known by
STEMS = (4, 5)

# Words that insult in some languages, whatever the labels say
SEED_WORDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly", "hate", "kill",
              "dumm", "trottel", "abschaum", "imbécile", "connard", "stupide", "estúpido", "idiota", "basura", "asqueroso"]
# Words that address the reader
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre",
                 "vos", "tú", "ti", "usted", "ustedes", "vosotros", "tus"]

_SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 or b in b"@$!*#+" else 32 for b in range(256))
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ODD = re.compile(rb"[a-z\x80-\xff](?:[@$!*#+0-9]+[a-z\x80-\xff])+")
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
_STRETCHED = re.compile(rb"([a-z])\1\1")
NEAR = 5

FEATURES = ["log_words", "hits", "density", "stem_hits", "stem_density", "seed_hits", "seed_density", "addressed", "second_person", "capitals", "shouted", "exclamations",
            "marks", "digits", "odd_words", "odd_hits", "stretched"]


@dataclass
class Lexicon:
    words: frozenset[bytes]
    stems: frozenset[bytes]

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        low = (text or "").lower().encode()
        words = low.translate(_SPACED).split()
        n, size = max(len(words), 1), max(len(raw), 1)
        kinds = set(words)
        bad = kinds & self.words
        stems = {w for w in kinds if len(w) >= 4 and (w[:4] in self.stems or w[:5] in self.stems)}
        seed = kinds & _SEEDS
        hits = addressed = stem_hits = seed_hits = 0
        second = 0
        if bad or stems or seed:
            spots = [i for i, w in enumerate(words) if w in bad or w in stems or w in seed]
            hits, stem_hits, seed_hits = (sum(words[i] in s for i in spots) for s in (bad, stems, seed))
            addressed = sum(any(w in _SECOND for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in spots)
        if kinds & _SECOND:
            second = sum(w in _SECOND for w in words)
        odd = _ODD.findall(low.translate(_PLAIN)) if b"@" in low or b"$" in low or b"*" in low or b"!" in low or len(low.translate(None, _DIGIT)) < len(low) else []
        odd_hits = 0
        if odd:
            for w in low.translate(_PLAIN).split():
                plain = w.translate(_LEET).translate(None, b"*#+")
                odd_hits += plain != w and (plain in self.words or plain in _SEEDS)
        return [
            float(np.log1p(len(words))), float(np.log1p(hits)), hits / n, float(np.log1p(stem_hits)), stem_hits / n, float(np.log1p(seed_hits)), seed_hits / n,
            float(addressed), second / n, (size - len(raw.translate(None, _UPPER))) / size, float(len(_SHOUTED.findall(raw))) / n,
            (raw.count(b"!") + raw.count(b"?")) / size, (size - len(raw.translate(None, _MARKS))) / size, (size - len(raw.translate(None, _DIGIT))) / size,
            len(odd) / n, float(odd_hits), float(len(_STRETCHED.findall(low))) / n]


_SEEDS = frozenset(w.encode() for w in SEED_WORDS)
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)


def _terms(text: str | None) -> set[tuple[int, bytes]]:
    words = set((text or "").lower().encode().translate(_SPACED).split())
    return {(0, w) for w in words if len(w) > 2} | {(1, w[:n]) for w in words for n in STEMS if len(w) >= n}


def without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` less most near copies: of texts that share the smallest or the largest number of a three-word run, one stays.

    Copies of one toxic text would otherwise make all its rare words look toxic.
    """

    @F.pandas_udf("low long, high long")
    def ends(texts: pd.Series) -> pd.DataFrame:
        words, offsets = word_numbers(pa.array(texts, pa.string()), lower=True)
        numbers, text, _ = sequences(words, offsets, 3, short=True)
        low, high = np.full(len(texts), -1), np.full(len(texts), -1)
        order = np.lexsort((numbers, text))
        numbers, text = numbers[order].view(np.int64), text[order]
        at = np.flatnonzero(np.diff(text, prepend=-1))
        low[text[at]], high[text[at]] = numbers[at], numbers[np.append(at[1:], len(text)) - 1]
        return pd.DataFrame({"low": low, "high": high})

    rows = table(rows.withColumn("_ends", ends("text")), "sketched")
    kept = rows.select("toxic", F.col("_ends.low").alias("low"), F.col("_ends.high").alias("high"), "text", F.xxhash64("text").alias("h"))
    for end in ("low", "high"):  # of rows alike the one with the smallest hash stays, in every run
        kept = kept.groupBy("toxic", end).agg(F.min(F.struct("h", *[c for c in ("low", "high", "text") if c != end])).alias("r"))
        kept = kept.select("toxic", *[F.col(c) if c == end else F.col(f"r.{c}") for c in ("low", "high", "text", "h") if c != "h"], "r.h")
    return kept.select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """All words and stems whose texts are toxic nine times in ten, from rows (text, toxic).

    ``LEAST`` texts must hold an entry and the rows are bounded, so what reaches the driver is too.
    """

    def count(frames):
        for frame in frames:
            found: dict[tuple[int, bytes], list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"]):
                for t in _terms(text):
                    found.setdefault(t, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(k, w, a, b) for (k, w), (a, b) in found.items()], columns=["kind", "term", "clean", "toxic"])

    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(count, "kind int, term binary, clean bigint, toxic bigint")
    counts = counts.groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = counts.filter((F.col("toxic") >= LEAST) & (F.col("toxic") >= 9 * F.col("clean")))
    best = sure.select("kind", "term").collect()
    return Lexicon(frozenset(bytes(r.term) for r in best if r.kind == 0), frozenset(bytes(r.term) for r in best if r.kind == 1))


@dataclass
class ToxicityModel:
    """``level`` is the score of every text where the labels hold a single class or none."""

    lexicon: Lexicon | None
    trees: GBTClassificationModel | None
    scale: IsotonicRegressionModel | None
    level: float = 0.0

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with a column ``_score`` in [0, 1]; a null text counts as empty."""
        prepare(docs.sparkSession)
        if self.trees is None:
            return docs.withColumn("_score", F.lit(self.level))
        return self._scaled(self._margins(docs, text)).drop("_features", "_raw", "_chance", "_class", "_margin")

    def _margins(self, docs: DataFrame, text: str) -> DataFrame:
        rows = docs.withColumn("_features", array_to_vector(dense(self.lexicon, F.col(text))))
        return self.trees.transform(rows).withColumn("_margin", vector_to_array("_chance")[1])

    def _scaled(self, rows: DataFrame) -> DataFrame:
        if self.scale is None:
            return rows.withColumn("_score", F.col("_margin"))
        return self.scale.transform(rows).withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))))


def dense(lexicon: Lexicon, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.features)

    return features(F.coalesce(text, F.lit("")))


def learn_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> ToxicityModel:
    """Fit on the labelled rows of ``docs``; ``labels`` (doc_id, toxic) must already be without the rows to hold out.

    Of several labels of a document the largest counts; null ids and labels are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    n = known.count()
    shares = [(a, a + int(w * min(1.0, most / max(1.0, w / (1 << 20) * n)))) for a, w, most in ((0, 1 << 19, LEXICON_ROWS), (1 << 19, 314_572, TREE_ROWS), (838_860, 209_716, CALIBRATION_ROWS))]
    part = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(shares))):
        part = F.when((place >= a) & (place < b), i).otherwise(part)
    # at most LEXICON_ROWS + TREE_ROWS + CALIBRATION_ROWS narrow rows, up to the hash's spread: a bounded broadcast
    drawn = known.withColumn("_part", part).filter("_part is not null").select(F.col("doc_id").alias("_id"), "_part", F.col("toxic").alias("_toxic"))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "_id").select("text", F.col("_toxic").alias("toxic"), "_part")
    rows = table(rows, "labelled")
    seen = {(r._part, r.toxic): r["count"] for r in rows.groupBy("_part", "toxic").count().collect()}
    positive, total = sum(v for (_, t), v in seen.items() if t == 1), sum(seen.values())
    if not seen.get((1, 0)) or not seen.get((1, 1)):
        return ToxicityModel(None, None, None, positive / total if total else 0.0)
    lexicon = learn_lexicon(without_copies(rows.filter("_part = 0")))
    fit = table(rows.filter("_part > 0").select("_part", F.col("toxic").cast("double").alias("label"), dense(lexicon, F.col("text")).alias("_dense")).coalesce(4), "features")
    fit = fit.withColumn("_features", array_to_vector("_dense"))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=3, maxMemoryInMB=64)
    grown = trees.setRawPredictionCol("_raw").setProbabilityCol("_chance").fit(fit.filter("_part = 1"))
    model = ToxicityModel(lexicon, grown, None)
    if seen.get((2, 0)) and seen.get((2, 1)):
        held = grown.transform(fit.filter("_part = 2")).select("label", vector_to_array("_chance")[1].alias("_margin"))
        model.scale = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(held)
    return model


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == fold, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, whole texts; held-out rows teach nothing.

    Null and empty texts get the score of a text without words; repeated rows get equal scores; a null doc_id is
    not held out and has no label.  Without labels, or with one class only, every score is that class's share.
    """
    model = learn_toxicity(docs, labels.filter(~held_out()))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= LIMIT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the limit, all columns kept, whatever their names.

    Null and empty texts have the score of a text without words; rows with a null or repeated doc_id are judged by
    their own texts; an empty table gives no row.
    """
    model = learn_toxicity(docs, labels.filter(~held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return model.score(rows).filter(F.col("_score") < LIMIT).select("doc.*")
