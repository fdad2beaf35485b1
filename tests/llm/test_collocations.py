"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from larkspur.llm import collocations as module
from larkspur.llm.collocations import collocations
from larkspur.llm.common import tables_into


def brute(rows, least, top, share=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, w), c in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], c)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = ["The", "cat", "sat", "on", "é", "日本", "x-y", "B\xa0c", "rare", "it's", "end"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choices([["the", "cat"], ["sat", "on", "the", "mat"], ["a", "b", "c", "d", "e", "f", "g"], [rng.choice(vocabulary)], [f"w{rng.randrange(400)}"]], [3, 2, 2, 6, 1])[0])
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ! "][:rng.choice([2, 8])]) for ws in words for w in ws)
        rows.append((text, rng.choice(["en", "fr", None])))
    return rows + [(None, "en"), ("", "en"), (" .,", None), (rows[0][0], rows[0][1]), ("same " * 3000, "es"), (rows[1][0] * 200, "en")]


SCHEMA = "text string, lang string, n string, k double, word int"


@pytest.mark.parametrize("dictionary,share", [(module.DICTIONARY, 100), (module.DICTIONARY, 60), (5, 100), (45, 100)])
def test_against_brute_force(spark, dictionary, share):
    """With the dictionaries in the tasks, beyond the bound of words, and beyond that of pairs alone."""
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, "theirs", 0.5, 1) for r in rows], SCHEMA).repartition(7)
    got = sorted(tuple(r) for r in collocations(docs, 5, 40, share, dictionary).collect())
    want = brute(rows, 5, 40, share)
    assert len(want) > 60 and got == want


def test_chunks_and_long_texts(spark, monkeypatch):
    rows = corpus(9, 30)
    monkeypatch.setattr(module, "CHUNK", 64)
    from itertools import chain
    import pyarrow as pa
    import numpy as np
    for text, _ in rows:
        raw, offsets = module.text_bytes(pa.array([text, text], pa.string()))
        small = [np.concatenate(x) for x in zip(*module._words(raw, offsets[np.append(np.diff(offsets) > 0, True)]))]
        monkeypatch.setattr(module, "CHUNK", 1 << 20)
        large = list(chain.from_iterable([list(p) for p in module._words(raw, offsets[np.append(np.diff(offsets) > 0, True)])]))
        monkeypatch.setattr(module, "CHUNK", 64)
        assert len(small) == len(large) and all((a == b).all() for a, b in zip(small, large))


def test_huge_counts_stay_exact(spark):
    from larkspur.llm.collocations import _wide
    from pyspark.sql import functions as F
    a, n, left, right = 9_000_000_000_000, 17_000_000_000_001, 9_000_000_000_007, 9_100_000_000_003
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    out = row.select((_wide(F.lit(1000)) * _wide(F.col("a")) * _wide(F.col("n"))).alias("over"), (_wide(F.col("l")) * _wide(F.col("r"))).alias("under")).select(F.expr("over div under").alias("s"))
    assert out.first().s == 1000 * a * n // (left * right)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(None, None, "", 0.0, 0), ("one two", "en", "", 0.0, 0)], SCHEMA)).count() == 0


def letters(seed, n):
    """Texts of random letters: each pair of letters is frequent, few longer phrases are."""
    rng = random.Random(seed)
    return [(" ".join(rng.choice("abcdefgh") for _ in range(40)) + rng.choice([".", " q", ""]), "en") for _ in range(n)]


def edges_written(spark, rows, least, dictionary=module.DICTIONARY):
    docs, paths = spark.createDataFrame([(*r, "", 0.5, 1) for r in rows], SCHEMA).repartition(3), []
    with tables_into(paths):
        got = sorted(tuple(r) for r in collocations(docs, least, 200, 100, dictionary).collect())
    assert got == brute(rows, least, 200)
    return sum(spark.read.parquet(p).count() for p in paths if "/edges-" in p)


def test_counted_pairs_and_triples_make_no_edges(spark):
    """Pairs and triples are counted before edges are made, so edges stand only where a longer phrase may be frequent."""
    assert edges_written(spark, letters(3, 30), 8) < 60
    rows = letters(3, 30) + [("a b c d e f", "en")] * 9
    assert edges_written(spark, rows, 9) < 60


def test_more_triples_than_travel(spark):
    rows = letters(5, 60)
    seen = Counter(w[i:i + 3] for text, _ in rows for w in [tuple(text.split(".")[0].split())] for i in range(len(w) - 2))
    assert sum(c >= 5 for c in seen.values()) > 90
    assert edges_written(spark, rows, 5, 90) > 1000
