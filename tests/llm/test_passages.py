"""Passage removal against brute force."""

import hashlib
import random
import re

import pytest

from larkspur.llm import passages
from larkspur.llm.passages import removal_report, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i:i + 50])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i:i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEFé") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passages_ = [text(n) for n in (49, 50, 51, 64, 130)]
    rows = []
    for i in range(70):
        parts = [text(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages_), text(rng.randint(0, 30))]
        rows.append((rng.randrange(100_000), [" ", "\n", " \t"][i % 3].join(w for p in parts for w in p)))
    rows += [(1_000_000 + i, rows[i][1]) for i in range(0, 30, 3)]
    rows += [(1, "same " * 120), (2, "same " * 60 + "other " * 60), (3, None), (4, ""), (5, "same " * 50), (None, rows[1][1]), (rows[2][0], rows[4][1]), (rows[2][0], rows[4][1]),
             (6, " ".join(passages_[4][10:70])), (7, "nb sp " * 40)]
    return rows


@pytest.mark.parametrize("seed, shard, part", [(1, 20_000, 100_000), (2, 10, 100_000), (3, 40, 25)])
def test_removal_against_brute_force(spark, make_docs, monkeypatch, seed, shard, part):
    monkeypatch.setattr(passages, "SHARD_PHRASES", shard)
    monkeypatch.setattr(passages, "PART_OCCURRENCES", part)
    rows = corpus(seed)
    docs = make_docs([(d, t, "s") for d, t in rows]).withColumnRenamed("n_chars", "start").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in removal_report(docs).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark, make_docs):
    assert remove_repeats(make_docs([None]).limit(0)).count() == 0
