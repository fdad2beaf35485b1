"""Benchmark windows in texts against brute force."""

import hashlib
import random
import re

import pytest

from larkspur.llm.decontamination import decontamination_report, drop_documents, mark, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, number int"


def norm(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = norm(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w = norm(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        named = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cé", "D4", "日本", "it's", "x-y"])
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([0, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(3, items[9][1]), (None, "only here once"), (40, None), (41, "!!"), (42, " ".join(text(2000)))]
    docs = []
    for i in range(120):
        w = text(rng.randrange(60))
        if i % 3 == 0:
            w[rng.randrange(len(w) + 1):0] = [rng.choice([", ", " "]).join(norm(rng.choice(items)[1]))]
        docs.append((i, " ".join(w).upper() if i % 2 else " . ".join(w)))
    docs += [(7, docs[3][1]), (None, docs[6][1]), (None, None), (200, ""), (201, "Only, HERE: once?"), (202, " ".join(text(30_000)))]
    return docs, items


@pytest.mark.parametrize("most", [100_000, 300])
def test_report_against_brute_force(spark, make_docs, monkeypatch, most):
    """At once, and in slices of the set."""
    docs, items = corpus(5)
    import larkspur.llm.decontamination as module
    monkeypatch.setattr(module.mark, "__defaults__", (10, "text", most))
    out = decontamination_report(make_docs([(d, t, "a") for d, t in docs]).repartition(4), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in out), key=repr)
    assert got == brute(docs, items)
    assert 5 < sum(r.contaminated for r in out) < len(docs)


def test_rows_and_spans_removed(spark, make_docs):
    item = "one two three four five six seven eight nine ten eleven"
    docs = make_docs([f"Before. {item.upper()}, after it's done", "clean, AS it is!", None, item])
    items = spark.createDataFrame([(1, item, 0)], ITEMS)
    assert sorted(r.doc_id for r in drop_documents(docs, items).collect()) == [1, 2]
    assert {r.doc_id: r.text for r in remove_spans(docs, items).collect()} == {0: "Before after it s done", 1: "clean, AS it is!", 2: None, 3: ""}


def test_clashing_columns_and_empty_tables(spark, make_docs):
    docs = spark.createDataFrame([(1, "a b", "mine", 2.0)], "doc_id int, text string, marks string, length double")
    items = spark.createDataFrame([(1, "B", 0)], ITEMS)
    marked, name = mark(docs, items)
    assert name not in docs.columns and marked.first().marks == "mine"
    none = spark.createDataFrame([], ITEMS)
    assert decontamination_report(make_docs(["a b c"]), none).first().contaminated is False
    assert remove_spans(docs, none).first().text == "a b" and decontamination_report(make_docs([]), items).count() == 0


def test_main_path_is_native(spark, make_docs):
    out = decontamination_report(make_docs(["a b c"]), spark.createDataFrame([(1, "b", 0)], ITEMS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Subquery")[0]
