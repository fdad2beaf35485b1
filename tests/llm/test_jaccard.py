"""The Jaccard join and the components below it, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import jaccard
from larkspur.llm.components import components
from larkspur.llm.jaccard import jaccard_components, keep_one
from larkspur.llm.words import word_numbers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def union(nodes, pairs):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in nodes}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    pairs = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    roots = union({d for d, _ in rows if d is not None}, pairs)
    return sorted(((d, len(s), roots.get(d)) for d, s in sets), key=repr)


def corpus(seed, copies=60, size=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randint(3, size))]
        if base % 3 == 0:
            text = passage + text[:8]
        for _ in range(rng.choice([1, 2, 5, copies if base == 0 else 3])):
            t = list(text)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(t).upper() if rng.random() < .2 else " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "one two three"), (None, "one two"), (5006, "x " * 40), (5007, "x " * 90),
             (5008, "nb sp one two three four"), (5003, rows[0][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, make_docs, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    rows = corpus(seed)
    docs = make_docs([(d, t, "s") for d, t in rows]).withColumnRenamed("n_chars", "root").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=repr)
    assert got == brute(rows)


def test_common_shingles_are_dealt_to_tiles(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    rows = corpus(3, copies=90)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(make_docs([(d, t, "s") for d, t in rows])).collect()), key=repr)
    assert got == brute(rows)


def test_keep_one(spark, make_docs):
    docs = make_docs(["a b c d e f g", "a b c d e f g", "h i j k l m n", None, "", "A B c d e f g"]).withColumnRenamed("n_chars", "component_id")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [0, 2, 3, 4]
    assert keep_one(docs).columns == docs.columns
    assert jaccard_components(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None), (7, 7)], "a bigint, b bigint")
    want = union({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert {r.node: r.root for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_word_numbers(monkeypatch):
    import larkspur.llm.words as words

    texts = ["a bb  a", None, "", "ccc\x00d\tbb", "x" * 300 + " " + "y" * 500, "é é bb", "  "] * 3
    whole, offsets = word_numbers(pa.array(texts))
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(offsets).tolist() == [len(WORD.findall(t or "")) for t in texts]
    number = {}
    assert all(number.setdefault(w, x) == x for w, x in zip(flat, whole.tolist())) and len(set(number.values())) == len(set(flat))
    monkeypatch.setattr(words, "CHUNK", 7)
    again, ends = word_numbers(pa.array(texts).slice(2))
    assert again.tolist() == whole[offsets[2]:].tolist() and ends.tolist() == (offsets[2:] - offsets[2]).tolist()


def test_keep_one_of_repeated_rows_and_null_ids(spark, make_docs):
    a, b, c = ("one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey", "alpha beta gamma delta epsilon zeta eta theta iota kappa")
    docs = make_docs([(1, a, "a"), (1, a, "a"), (2, a, "a"), (None, a, "a"), (None, b, "a"), (None, b, "a"), (1, c, "a"), (5, None, "a"), (5, None, "a")])
    assert sorted((str(r.doc_id), str(r.text)) for r in keep_one(docs).collect()) == sorted([("1", a), ("None", b), ("1", c), ("5", "None"), ("5", "None")])
