"""Language identification by families first, then by one-versus-one linear support vector machines inside a family."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import prepare, table
from larkspur.llm.toxicity import held_out

#: Buckets of hashed letter sequences, longest sequence, most training texts per language
BUCKETS, LONGEST, ROWS = 2048, 3, 1_500

# Language families by ISO 639-1 code; a language outside the list is a family of its own
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "celtic": ["ga", "gd", "cy", "br"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indic": ["hi", "ur", "bn", "pa", "mr", "gu", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh"],
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
#: Letters hashed at a time: bounds the memory of a very long text
CHUNK = 1 << 18


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def letters(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(a < 128, _FOLD[np.minimum(a, 127)], a)


def spectrum(text: str | None) -> np.ndarray:
    """Damped counts of hashed sequences of one to ``LONGEST`` letters, of length one."""
    a = letters(text or "")
    counts = np.zeros(BUCKETS)
    for lo in range(0, len(a), CHUNK):
        part = a[max(0, lo - LONGEST + 1):lo + CHUNK].astype(np.uint64)
        skip = lo - max(0, lo - LONGEST + 1)
        h = np.zeros(len(part), np.uint64)
        for n in range(LONGEST):
            h = h[:-1] if n else h
            h = h * np.uint64(0x9E3779B97F4A7C15) + part[n:] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n + 1)
            counts += np.bincount((h[max(0, skip - n):] >> np.uint64(53)).astype(np.int64), minlength=BUCKETS)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


@dataclass
class Duels:
    """One-versus-one machines: class ``b`` wins where the margin is positive."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its certainty) per row: most duels won, then the larger sum of margins."""
        wins, sure = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for (a, b), w, c in zip(self.pairs, self.weights, self.offsets):
            chance = 1 / (1 + np.exp(-np.clip(2 * (x @ w + c), -30, 30)))
            wins[:, b] += chance >= 0.5
            wins[:, a] += chance < 0.5
            sure[:, b] += chance
            sure[:, a] += 1 - chance
        best = np.argmax(wins + sure / (len(self.pairs) + 1), 1)
        return best, sure[np.arange(len(x)), best] / max(1, len(self.classes) - 1) if self.pairs else np.ones(len(x))


def _fit(rows: DataFrame, label: str, classes: list[str]) -> Duels:
    out = Duels(classes)
    for a, b in combinations(range(len(classes)), 2):
        two = rows.filter(F.col(label).isin(classes[a], classes[b])).select("features", (F.col(label) == classes[b]).cast("double").alias("label"))
        m = LinearSVC(maxIter=30, regParam=0.001, standardization=False).fit(two)
        out.pairs.append((a, b))
        out.weights.append(m.coefficients.toArray())
        out.offsets.append(float(m.intercept))
    return out


@dataclass
class LanguageModel:
    families: Duels
    inside: list[Duels]

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        spoken = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if spoken and self.families.classes:
            x = np.stack([spectrum(texts.iloc[i]) for i in spoken])
            chosen, sure = self.families.decide(x)
            for f, duels in enumerate(self.inside):
                at = np.flatnonzero(chosen == f)
                if len(at):
                    best, own = duels.decide(x[at])
                    for j, k, s in zip(at.tolist(), best.tolist(), own):
                        lang[spoken[j]], score[spoken[j]] = duels.classes[k], min(1.0, s * sure[j])
        return pd.DataFrame({"lang": lang, "score": score})


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on at most about ``ROWS`` texts per language, drawn by a hash of the key; null languages and texts teach nothing."""
    prepare(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("_id", F.lit("language")), F.lit(1 << 20))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, int(min(1.0, ROWS / n) * (1 << 20))).otherwise(share)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spectrum(t).tolist())

    rows = table(known.filter(draw < share).select("lang", features("text").alias("dense")).coalesce(6), "spectra")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family(name), []).append(name)
    order = sorted(groups)
    of = F.lit("")
    for name in names:
        of = F.when(F.col("lang") == name, family(name)).otherwise(of)
    rows = rows.select("lang", of.alias("family"), array_to_vector("dense").alias("features")).persist()
    model = LanguageModel(_fit(rows, "family", order), [_fit(rows, "lang", groups[f]) for f in order])
    rows.unpersist()
    return model


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, whole texts; held-out rows teach nothing.

    ``und`` with score 0 where the text is null or has no letter, or where no language could be learned.  Repeated rows
    get equal answers; a null doc_id is not held out.  The score is the winner's certainty over both steps.
    """
    out = held_out(folds=5, fold=0)
    model = learn_languages(docs.filter(~out))

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts)

    rows = docs.select("doc_id", out.alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
