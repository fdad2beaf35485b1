"""Text features over whole documents."""

from pyspark.sql import Window as W, functions as F

from larkspur.functions import text as tx
from larkspur.functions.scalar import flag, rnd
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view

_POST = """p AS (SELECT doc_id, 'From: user' || doc_id || ' <u@' || source || '.' || lang || '.example.org>' || chr(10) || 'Subject:  about ' || source || chr(10) || 'Organization: Org ' || (doc_id % 7) || chr(10) || chr(10) || text AS raw, text FROM documents)"""


def posts(t):
    nl = F.lit("\n")
    raw = F.concat(F.lit("From: user"), "doc_id", F.lit(" <u@"), "source", F.lit("."), "lang", F.lit(".example.org>"), nl, F.lit("Subject:  about "), "source", nl,
                   F.lit("Organization: Org "), (F.col("doc_id") % 7).cast("string"), nl, nl, "text")
    return t.documents.select("doc_id", raw.alias("raw"))


@query("split_headers", f"WITH {_POST} SELECT doc_id, 'about ' || split_part(split_part(raw, 'Subject:  about ', 2), chr(10), 1) AS subject, 'Org ' || (doc_id % 7) AS organization, md5(text) AS body_md5, length(text) AS body_chars FROM p")
def split_headers(t):
    head, body = tx.header_body(F.col("raw"))
    p = posts(t).select("doc_id", head.alias("head"), body.alias("body"))
    return p.select("doc_id", tx.header(F.col("head"), "Subject").alias("subject"), tx.header(F.col("head"), "Organization").alias("organization"),
                    F.md5("body").alias("body_md5"), F.length("body").cast("bigint").alias("body_chars"))


@query("email_domain", f"WITH {_POST}, d AS (SELECT doc_id, lower(regexp_extract(split_part(raw, chr(10), 1), '@([\\w.-]+)', 1)) AS d FROM p) SELECT doc_id, CASE WHEN d = '' THEN 'unknown' ELSE d END AS domain FROM d")
def email_domain(t):
    head, _ = tx.header_body(F.col("raw"))
    return posts(t).select("doc_id", tx.email_domain(tx.header(head, "From")).alias("domain"))


@query("title_extract", """WITH n AS (SELECT c_custkey, c_name || ', ' || CASE c_custkey % 4 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mlle' WHEN 2 THEN 'Mrs' ELSE 'Dr' END || '. X.' AS name FROM customer), e AS (SELECT c_custkey, trim(split_part(split_part(name, ',', 2), '.', 1)) AS title FROM n)
    SELECT c_custkey, CASE title WHEN 'Mlle' THEN 'Miss' WHEN 'Dr' THEN 'Officer' ELSE title END AS title FROM e""")
def title_extract(t):
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.lit(", "), F.when(k == 0, "Mr").when(k == 1, "Mlle").when(k == 2, "Mrs").otherwise("Dr"), F.lit(". X."))
    title = F.trim(F.split_part(F.split_part(name, F.lit(","), F.lit(2)), F.lit("."), F.lit(1)))
    return t.customer.select("c_custkey", title.alias("title")).replace({"Mlle": "Miss", "Dr": "Officer"}, subset=["title"])


def _cnt(p):
    return f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"


@query("text_stats", f"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w, string_split(text, chr(10)) AS l, CAST(greatest(length(text), 1) AS DOUBLE) AS n FROM documents)
    SELECT doc_id, CAST(len(w) AS INT) AS word_count, CAST(length(text) AS INT) AS char_count, {r6("coalesce(length(array_to_string(w, '')) / nullif(len(w), 0), 0)")} AS avg_word_len, CAST({_cnt('[.!?]')} AS INT) AS sentence_count,
    {r6(_cnt(chr(92) + 'p{Lu}') + ' / n')} AS uppercase_ratio, {r6(_cnt(chr(92) + 'p{Nd}') + ' / n')} AS digit_ratio, {r6(_cnt('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]') + ' / n')} AS special_ratio,
    CAST(len(l) AS INT) AS line_count, CAST(regexp_matches(text, 'http[s]?://') AS INT) AS has_url, {r6("len(list_filter(l, lambda x: starts_with(ltrim(x), '>'))) / len(l)")} AS quote_ratio FROM d""")
def text_stats(t):
    s = tx.text_stats(F.col("text"))
    whole = {"word_count", "char_count", "sentence_count", "line_count", "has_url"}
    return t.documents.select("doc_id", *[(c.cast("int") if n in whole else rnd(c)).alias(n) for n, c in s.items()])


_BS = chr(92)
_STRIP = f"'^{_BS}s+|{_BS}s+$', '', 'g'"


@query("text_clean", f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '\\p{{Nd}}+', ' NUM ', 'g'), 'http[s]?://\\S+', ' URL ', 'g'), {_STRIP}) AS m,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\p{{Nd}}+', 'NUM', 'g'), '\\$[^$]+\\$', 'EQUATION', 'g'), 'http[s]?://\\S+', 'URL', 'g'), '\\s+', ' ', 'g'), {_STRIP}) AS p,
      string_split(regexp_replace(regexp_replace(regexp_replace(text, 'http[s]?://\\S+', 'URL', 'g'), '@[\\p{{L}}\\p{{N}}_]+', 'MENTION', 'g'), '#[\\p{{L}}\\p{{N}}_]+', 'HASHTAG', 'g'), '') AS c FROM documents)
    SELECT doc_id, md5(m) AS message_md5, md5(p) AS paper_md5, md5(regexp_replace(array_to_string(list_filter(c, lambda x, i: x = chr(10) OR i < 3 OR NOT (x = c[i - 1] AND x = c[i - 2])), ''), {_STRIP})) AS comment_md5 FROM a""")
def text_clean(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(tx.clean_message(c)).alias("message_md5"), F.md5(tx.clean_paper(c)).alias("paper_md5"), F.md5(tx.clean_comment(c)).alias("comment_md5"))


def _expanded(expr):
    for a, b in tx.ABBREVIATIONS:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


@query("abbrev_expand", f"SELECT doc_id, length({_expanded('lower(text)')}) AS chars, md5({_expanded('lower(text)')}) AS md5 FROM documents")
def abbrev_expand(t):
    c = tx.expand_abbreviations(F.col("text"))
    return t.documents.select("doc_id", F.length(c).cast("bigint").alias("chars"), F.md5(c).alias("md5"))


@query("keyword_flags", "SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT) AS has_{n}" for n, p in tx.KEYWORDS.items()) + " FROM documents")
def keyword_flags(t):
    return t.documents.select("doc_id", *[tx.keyword_flag(F.col("text"), p).alias(f"has_{n}") for n, p in tx.KEYWORDS.items()])


@query("weighted_concat", "SELECT doc_id, md5(repeat(source || ' ', 3) || text) AS weighted, md5('SUBJ ' || source || ' BODY ' || text) AS marked FROM documents")
def weighted_concat(t):
    return t.documents.select("doc_id", F.md5(F.concat(F.repeat(F.concat("source", F.lit(" ")), 3), "text")).alias("weighted"),
                              F.md5(F.concat(F.lit("SUBJ "), "source", F.lit(" BODY "), "text")).alias("marked"))


@query("char_ratios", f"""SELECT doc_id, {r6(_cnt(_BS + 'p{Lu}') + ' / CAST(greatest(length(text), 1) AS DOUBLE)')} AS caps_ratio,
    {r6(_cnt('[!?]') + f" / CAST(greatest(len(list_filter(regexp_split_to_array(text, '{_BS}s+'), lambda w: w <> '')), 1) AS DOUBLE)")} AS punct_density FROM documents""")
def char_ratios(t):
    c = F.col("text")
    return t.documents.select("doc_id", rnd(tx.count_of(c, r"\p{Lu}") / F.greatest(F.length(c), F.lit(1)).cast("double")).alias("caps_ratio"),
                              rnd(tx.count_of(c, "[!?]") / F.greatest(F.size(tx.words(c)), F.lit(1)).cast("double")).alias("punct_density"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOK = f"""k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP})) AS tok FROM documents)"""
_TERMS = f"""{_TOK}, g AS (SELECT doc_id, unnest(list_concat(tok, list_transform(range(1, greatest(len(tok), 1)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM k),
    c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM c GROUP BY 1), nd AS (SELECT count(*) AS nd FROM documents)"""


def n_docs(t):
    return t.documents.agg(F.count(F.lit(1))).scalar()


@query("tokenize_ngrams", f"WITH {_TERMS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_distinct, max(tf) AS max_tf FROM c GROUP BY 1")
def tokenize_ngrams(t):
    return tx.term_measures(t.documents, "doc_id", "text")


@query("char_ngrams", """WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS w FROM documents), p AS (SELECT doc_id, lang, ' ' || w || ' ' AS p, count(*) AS n FROM w GROUP BY 1, 2, 3),
    g AS (SELECT doc_id, lang, n, unnest(list_transform(range(1, length(p) - k + 2), lambda i: substr(p, i, k))) AS gram FROM p, (VALUES (3), (4), (5)) AS s(k))
    SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT doc_id) AS df FROM g GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 20""")
def char_ngrams(t):
    """Character 3- to 5-grams that at least 20 documents of a language hold, with occurrences and documents."""
    # occurrences: a word is cut once per language and task, not where it stands
    words = t.documents.select("lang", tx.each(tx.tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    n = words.select("lang", "n", tx.each(tx.char_ngrams(F.col("w"), 3, 5)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # documents: the n-grams of a document's distinct words, each once
    grams = F.array_distinct(F.flatten(F.transform(F.array_distinct(tx.tokens(F.col("text"))), lambda w: tx.char_ngrams(w, 3, 5))))
    df = t.documents.select("lang", tx.each(grams).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("df")).filter("df >= 20")
    return df.join(n, df["lang"].eqNullSafe(n["lang"]) & (df["gram"] == n["gram"])).select(df["lang"], df["gram"], "n", "df")


#: Fewest documents of a term, and most terms, of a vocabulary
MIN_DF, MAX_TERMS = 2, 5000


@query("count_vectorize", f"WITH {_TERMS} SELECT term, n, df FROM v, nd WHERE df >= {MIN_DF} AND df <= 0.95::DOUBLE * nd ORDER BY n DESC, term LIMIT {MAX_TERMS}")
def count_vectorize(t):
    return tx.frequent_terms(t.documents, "text", n_docs(t), MIN_DF, 0.95, MAX_TERMS)


def _tfidf_sql(weight):
    return f"""{_TERMS}, voc AS (SELECT term, df FROM v, nd WHERE df >= {MIN_DF} AND df <= 0.95::DOUBLE * nd ORDER BY n DESC, term LIMIT {MAX_TERMS}),
    w AS (SELECT doc_id, term, {weight} * (ln((1 + nd)::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN voc USING (term), nd), z AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def doc_tfidf(t, sublinear=False):
    vocab = tx.frequent_terms(t.documents, "text", n_docs(t), MIN_DF, 0.95, MAX_TERMS)
    return tx.tfidf(t.documents, "doc_id", "text", vocab, n_docs(t), sublinear)


@query("tfidf", f"WITH {_tfidf_sql('tf')} SELECT doc_id, term, {r6('weight')} AS weight FROM z")
def tfidf(t):
    return doc_tfidf(t).select("doc_id", "term", rnd("weight").alias("weight"))


@query("tfidf_sublinear", f"WITH {_tfidf_sql('(1 + ln(tf))')} SELECT doc_id, term, {r6('weight')} AS weight FROM z")
def tfidf_sublinear(t):
    return doc_tfidf(t, True).select("doc_id", "term", rnd("weight").alias("weight"))


@query("top_terms", f"WITH {_tfidf_sql('tf')}, m AS (SELECT term, sum(weight) / max(nd) AS m FROM z, nd GROUP BY 1) SELECT term, {r6('m')} AS mean_weight FROM m ORDER BY round(m, 9) DESC, term LIMIT 20")
def top_terms(t):
    m = doc_tfidf(t).groupBy("term").agg((F.sum("weight") / n_docs(t)).alias("m"))
    return m.orderBy(F.round("m", 9).desc(), "term").limit(20).select("term", rnd("m").alias("mean_weight"))


@query("explode_tags", f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, unnest(list_filter([CASE WHEN y = 1 THEN ' Good' END, CASE WHEN toxic = 1 THEN 'TOXIC ' END, lang], lambda x: x IS NOT NULL)) AS tag FROM v_text)
    SELECT split, lower(trim(tag)) AS tag, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS share FROM g GROUP BY 1, 2""")
def explode_tags(t):
    d = view(t, "v_text").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
                                 F.array_compact(F.array(F.when(F.col("y") == 1, " Good"), F.when(F.col("toxic") == 1, "TOXIC "), F.col("lang"))).alias("tags"))
    tags = d.filter(F.size("tags") > 0).select("split", F.explode(F.transform("tags", lambda x: F.lower(F.trim(x)))).alias("tag"))
    counts = tags.groupBy("split", "tag").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("total"))
    return counts.join(totals, "split").select("split", "tag", "n", rnd(F.col("n") / F.col("total")).alias("share"))


@query("code_prefix", "SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n FROM part GROUP BY 1")
def code_prefix(t):
    return t.part.groupBy(F.substring("p_name", 1, 3).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("props_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def props_field(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
