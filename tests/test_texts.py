"""Terms of documents counted inside the row, against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.functions import text as tx
from larkspur.models import bayes as nb
from tests.conftest import SF

TEXTS = [(1, "the cat saw the cat and a dog"), (1, "cat saw"), (2, ""), (3, None), (4, "aa bb aa bb aa"), (5, "x ."), (6, "Größe größe 42 42 42"), (None, "no key no key")]


def python_terms(text):
    tok = [w for w in re.findall(r"[^\W]{2,}", (text or "").lower()) if w not in tx.STOP_WORDS]
    return tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]


def test_term_measures_merge_texts_of_a_key_and_shuffle_no_terms(spark):
    got = tx.term_measures(spark.createDataFrame(TEXTS, "k int, text string").repartition(3), "k", "text")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for k, text in TEXTS:
        want.setdefault(k, Counter()).update(python_terms(text))
    assert {r.k: (r.n_terms, r.n_distinct, r.max_tf) for r in got.collect()} == {k: (c.total(), len(c), max(c.values())) for k, c in want.items() if c}


def test_run_counts(spark):
    lists = [([],), (["b"],), (["b", "a", "b", "c", "b"],), (["a", "a"],)]
    got = spark.createDataFrame(lists, "v array<string>").select(tx.run_counts(F.col("v")).alias("n"), "v").collect()
    assert all([tuple(x) for x in r.n] == sorted(Counter(r.v).items()) for r in got)


def test_character_ngrams_count_words_before_they_cut_them(spark, tmp_path):
    texts = [(i, "Tee tee Kaffee" if i % 2 else "tee", "de" if i < 50 else None) for i in range(75)]
    spark.createDataFrame(texts, "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["char_ngrams"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[lang#\d+, w#\d+\]", plan)
    n, df = Counter(), Counter()
    for _, text, lang in texts:
        grams = [f" {w} "[i:i + k] for w in text.lower().split() for k in (3, 4, 5) for i in range(len(w) + 3 - k)]
        n.update((lang, g) for g in grams)
        df.update((lang, g) for g in set(grams))
    assert {(r.lang, r.gram): (r.n, r.df) for r in got.collect()} == {k: (n[k], d) for k, d in df.items() if d >= 20}


def test_frequent_terms_count_only_pairs_of_words_that_reach_the_bound(spark, monkeypatch):
    """The same terms as counting everything, with far fewer pairs in the count; ties beyond the bound count all pairs."""
    texts = [(i, " ".join(["alpha beta"] * (i % 4) + [f"w{i}a{j} w{i}b{j}" for j in range(30)] + ["gamma delta eps"] * 2)) for i in range(40)]
    texts += [(40, None), (41, ""), (42, "alpha the beta"), (43, "solo")]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    n, df = Counter(), Counter()
    for _, text in texts:
        terms = Counter(python_terms(text))
        n.update(terms)
        df.update(terms.keys())
    made, counted = [], tx.counted
    monkeypatch.setattr(tx, "counted", lambda d: made.append(counted(d)) or made[-1])
    for size, lowest, pruned in ((4, 1, True), (5, 2, True), (6, 2, False), (50, 1, False)):
        made.clear()
        got = tx.frequent_terms(docs, "text", F.lit(len(texts)), lowest, 0.95, size)
        want = sorted((t for t in n if lowest <= df[t] <= 0.95 * len(texts)), key=lambda t: (-n[t], t))[:size]
        assert [(r.term, r.n, r.df) for r in got.collect()] == [(t, n[t], df[t]) for t in want]
        assert (made[-1].count() < 30) == pruned


def test_tfidf_counts_terms_inside_the_row(spark):
    docs = spark.createDataFrame(TEXTS[:-1], "k int, text string").repartition(3)
    vocab = tx.vocabulary(tx.with_terms(docs, "text"), F.lit(7), 1, 1.0)
    got = tx.tfidf(docs, "k", "text", vocab, F.lit(7))
    assert not re.search(r"Aggregate \[k#\d+, term#\d+", got._jdf.queryExecution().optimizedPlan().toString())
    per = {}
    for r in got.collect():
        per.setdefault(r.k, {})[r.term] = r.weight
    assert set(per[1]) == set(python_terms(TEXTS[0][1])) and all(abs(sum(w * w for w in d.values()) - 1) < 1e-12 for d in per.values())


def test_sums_of_frequent_and_rare_terms(spark, monkeypatch):
    """Frequent terms are summed where they lie, rare ones are shuffled: the same sums, terms without a weight left out."""
    pairs = [(i % 7, f"t{i * i % 13}", i) for i in range(200)]
    weights = [(f"t{j}", j % 3, float(j + 1)) for j in range(10)]
    made = spark.createDataFrame(pairs, "k int, term string, tf int").repartition(3), spark.createDataFrame(weights, "term string, n int, w double")
    want, w = Counter(), {t: x for t, _, x in weights}
    for k, term, tf in pairs:
        want[k] += tf * w.get(term, 0)
    for held in (100, 3):
        monkeypatch.setattr(nb, "HELD_TERMS", held)
        got = nb.summed(made[0], "k", "term", made[1], {"s": F.col("tf") * F.col("w")})
        assert {r.k: r.s for r in got.collect()} == {k: x for k, x in want.items() if x}
        assert ("LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()) == (held == 3)


def test_bayes_settings_share_one_pass_over_the_documents(spark, monkeypatch):
    calls, summed = [], nb.summed
    monkeypatch.setattr(nb, "summed", lambda *a: calls.append(1) or summed(*a))
    assert entry.queries()["nb_alpha_sweep"](spark, SF).count() == 8 and len(calls) == 1
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (0, ["a", "c"]), (1, ["b"]), (None, ["c"]), (0, None)], "y int, terms array<string>")
    table = nb.class_term_table(docs.select("y", tx.run_counts(F.col("terms")).alias("runs")), "y", 2)
    assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.cls, r.term, r.n, r.docs) for r in table.collect()} == {(1, "a", 2, 1), (0, "a", 1, 1), (1, "b", 2, 2), (0, "c", 1, 1), (None, "c", 1, 1)}
