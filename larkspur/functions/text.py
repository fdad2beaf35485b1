"""Text expressions: cleaning, measures, tokens, n-grams.  All JVM-side, over the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.scalar import let
from larkspur.session import cut

# Patterns of the text cleaners
DIGITS = r"\p{Nd}+"
URL = r"http[s]?://\S+"
EQUATION = r"\$[^$]+\$"
MENTION = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
EMAIL_DOMAIN = r"@([\p{L}\p{N}_.-]+)"
# Medical abbreviations, replaced in this order
ABBREVIATIONS = [
    ("r/o", "rule out"), ("hx", "history"), ("s/p", "status post"), ("c/o", "complaining of"), ("w/", "with"), ("w/o", "without"),
    ("dx", "diagnosis"), ("tx", "treatment"), ("sx", "symptoms"), ("sob", "shortness of breath"), ("cp", "chest pain"),
    ("abd", "abdominal"), ("htn", "hypertension"), ("dm", "diabetes"), ("cad", "coronary artery disease"), ("chf", "congestive heart failure"),
]
# Keyword groups
KEYWORDS = {
    "leaving": "leaving|quit|resign|opportunity|elsewhere|better offer",
    "manager": "manager|boss|leadership|micromanag|toxic",
    "code": "github|code",
    "dataset": "dataset|corpus|benchmark",
    "theorem": "theorem|proof|lemma",
}
# Stop words of the n-gram features (a parameter; a short English list by default)
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words, none for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_of(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def clean_message(c: Column) -> Column:
    """Lower case, squeezed blanks, numbers to NUM, then links to URL (numbers first, as pinned)."""
    c = F.regexp_replace(F.lower(c), r"\s+", " ")
    c = F.regexp_replace(c, DIGITS, " NUM ")
    return strip(F.regexp_replace(c, URL, " URL "))


def clean_paper(c: Column) -> Column:
    """Lower case, numbers, formulas and links to tokens, squeezed blanks."""
    c = F.regexp_replace(F.lower(c), DIGITS, "NUM")
    c = F.regexp_replace(c, EQUATION, "EQUATION")
    c = F.regexp_replace(c, URL, "URL")
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_comment(c: Column) -> Column:
    """Links, mentions and hashtags to tokens; runs of three or more equal characters cut to two."""
    c = F.regexp_replace(c, URL, "URL")
    c = F.regexp_replace(c, MENTION, "MENTION")
    c = F.regexp_replace(c, HASHTAG, "HASHTAG")
    return strip(F.regexp_replace(c, r"([^\n])\1{2,}", "$1$1"))


def text_stats(c: Column) -> dict[str, Column]:
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    w = words(c)
    lines = F.split(c, "\n")
    return {
        "word_count": F.size(w), "char_count": F.length(c),
        "avg_word_len": F.coalesce(F.try_divide(F.length(F.array_join(w, "")).cast("double"), F.size(w).cast("double")), F.lit(0.0)),
        "sentence_count": count_of(c, r"[.!?]"),
        "uppercase_ratio": count_of(c, r"\p{Lu}") / n, "digit_ratio": count_of(c, r"\p{Nd}") / n,
        "special_ratio": count_of(c, r"[^\p{L}\p{N}\s]") / n, "line_count": F.size(lines),
        "has_url": F.when(c.rlike("http[s]?://"), 1).otherwise(0),
        "quote_ratio": F.size(F.filter(lines, lambda x: F.ltrim(x).startswith(">"))) / F.size(lines).cast("double"),
    }


def expand_abbreviations(c: Column) -> Column:
    c = F.lower(c)
    for short, full in ABBREVIATIONS:
        c = F.replace(c, F.lit(short), F.lit(full))
    return c


def keyword_flag(c: Column, alternatives: str) -> Column:
    return F.when(F.lower(c).rlike(alternatives), 1).otherwise(0)


def header_body(c: Column) -> tuple[Column, Column]:
    """(header lines, body): the header ends at the first blank line; a text without one is all body."""
    lines = F.split(c, "\n")
    blank = F.array_position(F.transform(lines, lambda x: strip(x) == ""), True)
    head = F.when(blank > 0, F.slice(lines, F.lit(1), F.greatest(blank - 1, F.lit(0)).cast("int"))).otherwise(lines)
    body = F.when(blank > 0, F.array_join(F.slice(lines, (blank + 1).cast("int"), F.size(lines)), "\n")).otherwise(c)
    return head, body


def header(head: Column, name: str) -> Column:
    """Value of the last header line called ``name``."""
    mine = F.filter(head, lambda x: x.startswith(f"{name}:"))
    return strip(F.substring(F.try_element_at(mine, F.lit(-1)), len(name) + 2, 1 << 30))


def email_domain(c: Column) -> Column:
    found = F.lower(F.regexp_extract(c, EMAIL_DOMAIN, 1))
    return F.when(found != "", found).otherwise("unknown")


def tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop))) if stop else found


def bigrams(tok: Column) -> Column:
    """Pairs of neighbours, none over a null."""
    rest = F.slice(tok, F.lit(2), F.greatest(F.size(tok) - 1, F.lit(0)))
    both = F.zip_with(tok, rest, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_compact(both)


def char_ngrams(word: Column, low: int, high: int) -> Column:
    """Character n-grams of ``' word '`` (word borders included), a padded word shorter than n counted once whole."""
    def of_padded(padded: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
            width = F.lit(n)
            grams = F.transform(starts, lambda i: F.substring(padded, i, width))  # noqa: B023 (built at once)
            parts.append(F.when((F.length(padded) >= n) | F.lit(n == low), grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return let(F.concat(F.lit(" "), word, F.lit(" ")), of_padded)


def with_terms(df: DataFrame, text: str, stop: Sequence[str] = STOP_WORDS, grams: int = 2) -> DataFrame:
    """Add ``terms``: the document's word 1..grams in order, after stop words."""
    tok = df.withColumn("_t", tokens(F.col(text), stop))
    return tok.withColumn("terms", F.concat("_t", bigrams(F.col("_t"))) if grams > 1 else F.col("_t")).drop("_t")


def each(array: str | Column) -> Column:
    """One row per element.

    Exploding a computed column lets the optimiser push ``size(..) > 0`` below the computation, which
    then tokenises every text again at the scan; an identity transform keeps it computed once.
    """
    return F.explode(F.transform(array, lambda x: x))


def run_counts(array: Column) -> Column:
    """(term, tf) of each distinct element of ``array``, in order: one sort, no pair of elements compared twice."""
    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(first, lambda at: F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, j + 1), n) - a).alias("tf"))))

    return let(F.sort_array(array), of_sorted)


def key_runs(df: DataFrame, key: str, text: str, stop: Sequence[str] = STOP_WORDS, grams: int = 2) -> tuple[DataFrame, Column]:
    """(the texts of each key as one row, its distinct terms with their occurrences): texts are shuffled once, their terms never leave the row."""
    def one(t: Column) -> Column:
        return let(tokens(t, stop), lambda tok: F.concat(tok, bigrams(tok)) if grams > 1 else tok)

    return df.groupBy(key).agg(F.collect_list(text).alias("_texts")), run_counts(F.flatten(F.transform("_texts", one)))


def key_counts(df: DataFrame, key: str, text: str, stop: Sequence[str] = STOP_WORDS, grams: int = 2) -> DataFrame:
    """(key, term, tf); texts of one key count as one document."""
    whole, runs = key_runs(df, key, text, stop, grams)
    return whole.select(key, F.inline(runs))


def term_measures(df: DataFrame, key: str, text: str, stop: Sequence[str] = STOP_WORDS, grams: int = 2) -> DataFrame:
    """(key, n_terms, n_distinct, max_tf) of every document with a term; texts of one key count as one document."""
    def measures(runs: Column) -> Column:
        return F.struct(F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_terms"),
                        F.size(runs).cast("bigint").alias("n_distinct"), F.array_max(runs).cast("bigint").alias("max_tf"))

    whole, runs = key_runs(df, key, text, stop, grams)
    # a filter on the measures would compute them twice, an empty array yields no row
    return whole.select(key, F.inline(F.filter(F.array(let(F.transform(runs, lambda r: r["tf"]), measures)), lambda m: m["n_terms"] > 0)))


def vocabulary(df: DataFrame, n_docs: Column, min_df: int = 1, max_df: float = 1.0, size: int | None = None) -> DataFrame:
    """(term, n, df) within the document-frequency limits, the ``size`` most frequent (ties by term).

    A document adds a term once, with its occurrences; both counts are summed per term map-side, so nothing per document
    is shuffled.
    """
    return within(counted(df), n_docs, min_df, max_df, size)


def counted(df: DataFrame) -> DataFrame:
    """(term, n, df) of ``terms``: occurrences and documents."""
    return df.select(F.inline(run_counts(F.col("terms")))).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def within(counts: DataFrame, n_docs: Column, min_df: int, max_df: float, size: int | None = None) -> DataFrame:
    v = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return v.orderBy(F.desc("n"), "term").limit(size) if size else v


def frequent_terms(df: DataFrame, text: str, n_docs: Column, min_df: int, max_df: float, size: int, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """:func:`vocabulary` of words and pairs of neighbours, its ``size`` most frequent terms, without a count of every pair.

    Words are counted first.  Where ``size`` words lie within the limits, the last of them bounds the counts of the result from
    below, and no pair is more frequent than either of its words: only pairs of words that reach the bound are counted.
    Their number does not grow with the table.  Where more than twice ``size`` words reach it, all pairs are counted.
    """
    words = cut(counted(with_terms(df, text, stop, 1)))
    bound = within(words, n_docs, min_df, max_df, size).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    reach = [r.term for r in words.filter(F.col("n") >= bound.least).select("term").limit(2 * size + 1).collect()] if bound.k == size else []
    if not 0 < len(reach) <= 2 * size:
        return vocabulary(with_terms(df, text, stop), n_docs, min_df, max_df, size)
    known = F.transform(tokens(F.col(text), stop), lambda w: F.when(w.isin(reach), w))
    pairs = counted(df.select(let(known, bigrams).alias("terms")))
    return within(words.unionByName(pairs), n_docs, min_df, max_df, size)


def tfidf(df: DataFrame, key: str, text: str, vocab: DataFrame, n_docs: Column, sublinear: bool = False, stop: Sequence[str] = STOP_WORDS, grams: int = 2) -> DataFrame:
    """Smoothed idf = ln((1+N)/(1+df)) + 1, rows scaled to unit length.

    Texts are shuffled once, by ``key``; a document's terms are counted inside its row.  The norm is a window over one
    document's vocabulary terms, a group bounded by the vocabulary.
    """
    counts = key_counts(df, key, text, stop, grams).join(vocab.select("term", "df"), "term")
    tf = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    idf = F.ln((1 + n_docs) / (1 + F.col("df"))) + 1
    w = counts.select(key, "term", (tf * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("_w") / norm).alias("weight"))
