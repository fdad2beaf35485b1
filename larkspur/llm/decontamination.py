"""Benchmark decontamination: windows of the test items as a hash set inside every task, training texts scanned in place.

Normalised words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased.  Items are cut into windows; the set of
windows travels to the tasks as one value (a scalar subquery), cut into buckets by hash.  Each text is read once, in its
own row: the number of a window names a bucket, a window there with the same number is compared word by word, and what
remains are true occurrences.  Texts are never exploded, shuffled or joined, so no passage, however common, gathers rows.
A set above ``SET_WINDOWS`` is read in slices, one narrow pass over the texts for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import prepare, table

WINDOW = 10
#: Windows that travel to the tasks at once: about 200 bytes each
SET_WINDOWS = 100_000
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw_words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT), "")


def words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _SPLIT), "")


def _spell(w: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(w, start + 1, F.lit(length)), " ")


def _number(numbers: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(numbers, start + j) for j in range(length)])


def _starts(w: Column, length: int) -> Column:
    return F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored (length, number, phrase, items): each distinct window once, with the ids (as strings, sorted) of its items."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w")).filter(F.size("w") > 0)

    def cut(at: Column, length: int) -> Column:
        return let(F.transform(at, lambda x: F.xxhash64(x)), lambda n: F.transform(_starts(at, length), lambda i: F.struct(
            F.lit(length).alias("length"), _number(n, i, length).alias("number"), _spell(at, i, length).alias("phrase"))))

    def all_of(at: Column) -> Column:
        sized = F.when(F.size(at) >= window, cut(at, window))
        for n in range(1, window):
            sized = sized.when(F.size(at) == n, cut(at, n))
        return sized

    each = w.select("item", F.explode(let(F.col("w"), all_of)).alias("e")).select("item", "e.*").distinct()
    return table(each.groupBy("length", "number", "phrase").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")


def _as_set(windows: DataFrame, count: int) -> tuple[Column, int]:
    """(one array of buckets of windows, number of buckets); four buckets a window, so most are empty."""
    spark = windows.sparkSession
    buckets = 1 << max(2, (4 * count).bit_length())
    entry = F.struct("length", "number", "phrase", "items")
    filled = windows.groupBy(F.pmod("number", F.lit(buckets)).alias("id")).agg(F.collect_list(entry).alias("entries"))
    every = spark.range(buckets).join(filled, "id", "left").select("id", F.coalesce("entries", F.array().cast(filled.schema["entries"].dataType)).alias("entries"))
    whole = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "entries"))), lambda b: b.entries).alias("buckets"))
    return table(whole, "set").scalar(), buckets


def _occurrences(text: str, held: Column, buckets: int, lengths: list[int]) -> Column:
    """struct<n_words, hits>: a text's words, and array<struct<start, length, items>> of the windows that occur in it."""
    def at(w: Column, numbers: Column, inside: Column, length: int) -> Column:
        def same(i: Column) -> Callable[[Column], Column]:
            return lambda e: (e.number == _number(numbers, i, length)) & (e.length == length) & (e.phrase == _spell(w, i, length))

        def bucket(i: Column) -> Column:
            return F.get(inside, F.pmod(_number(numbers, i, length), F.lit(buckets)).cast("int"))

        hit = F.filter(_starts(w, length), lambda i: F.exists(bucket(i), same(i)))
        return F.transform(hit, lambda i: F.struct(
            i.cast("int").alias("start"), F.lit(length).alias("length"), F.flatten(F.transform(F.filter(bucket(i), same(i)), lambda e: e["items"])).alias("items")))

    def both(w: Column, inside: Column) -> Column:
        found = let(F.transform(w, lambda x: F.xxhash64(x)), lambda n: F.concat(*[at(w, n, inside, k) for k in lengths]))
        return F.struct(F.size(w).alias("n_words"), found.alias("hits"))

    return let(held, lambda inside: let(words(text), lambda w: both(w, inside)))


HITS = "array<struct<start:int,length:int,items:array<string>>>"


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", most: int = SET_WINDOWS) -> tuple[DataFrame, str]:
    """(``docs`` with one more column, its name): struct<n_words, hits>, the occurrences of the items' windows in each text by start.

    Null texts have no words.  Rows are judged one by one: repeated rows alike, null ids as any other.  Items without
    words have no window; an item with a null id counts for words but is not listed.  The new column takes a name that
    ``docs`` does not have.
    """
    prepare(docs.sparkSession)
    name, held = free_name(docs, "marks"), free_name(docs, "set")
    windows = benchmark_windows(items, window)
    sizes = {r.length: r["count"] for r in windows.groupBy("length").count().collect()}
    count = sum(sizes.values())
    if not count:
        return docs.withColumn(name, F.struct(F.size(words(text)).alias("n_words"), F.array().cast(HITS).alias("hits"))), name
    slices = -(-count // most)
    out = docs
    for s in range(slices):
        part = windows if slices == 1 else windows.filter(F.pmod(F.xxhash64("phrase"), F.lit(slices)) == s)
        value, buckets = _as_set(part, count // slices + 1)
        found = _occurrences(text, F.col(held), buckets, sorted(sizes))
        if s:
            found = F.struct(F.col(f"{name}.n_words").alias("n_words"), F.concat(f"{name}.hits", found.hits).alias("hits"))
        out = out.withColumn(held, value).withColumn(name, found).drop(held)
        # a slice's set leaves the tasks before the next one comes: what was found is stored
        out = out if s == slices - 1 else table(out, "marked")
    return out.withColumn(name, F.struct(F.col(f"{name}.n_words").alias("n_words"), F.array_sort(f"{name}.hits").alias("hits"))), name


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def spans(hits: str) -> Column:
    """array<struct<start, stop>>: the words inside any occurrence, as runs that neither touch nor overlap."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(runs: Column, h: Column) -> Column:
        last, stop = F.element_at(runs, -1), h.start + h.length
        joins = F.when(F.size(runs) > 0, h.start <= last.stop).otherwise(F.lit(False))
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.stop, stop).alias("stop"))))
        return F.when(joins, longer).otherwise(F.concat(runs, F.array(F.struct(h.start.alias("start"), stop.alias("stop")))))

    return F.aggregate(hits, none, add)


def covered(hits: str) -> Column:
    """Words inside any occurrence, counted; occurrences come by start."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))

    def add(a: Column, h: Column) -> Column:
        stop = h.start + h.length
        return F.struct((a.n + F.greatest(F.lit(0), stop - F.greatest(a.upto, h.start))).cast("bigint").alias("n"), F.greatest(a.upto, stop).alias("upto"))

    return F.aggregate(hits, start, add, lambda a: a.n)


def found_items(hits: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def drop_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, all columns kept."""
    marked, hits = mark(docs, items, window)
    return marked.filter(F.size(f"{hits}.hits") == 0).drop(hits)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``; where windows occur, ``text`` is what is left of its words, joined by one space.  Other texts stay as they are."""
    marked, hits = mark(docs, items, window)
    rest = let(spans(f"{hits}.hits"), lambda s: F.array_join(F.filter(raw_words("text"), lambda w, i: ~F.exists(s, lambda r: (i >= r.start) & (i < r.stop))), " "))
    return marked.withColumn("text", F.when(F.size(f"{hits}.hits") > 0, rest).otherwise(F.col("text"))).drop(hits)


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row: words, words hit, items whose windows occur, and whether any does."""
    marked, hits = mark(docs.select("doc_id", "text"), items)
    hit = f"{hits}.hits"
    marked = marked.select("doc_id", F.col(f"{hits}.n_words").cast("bigint").alias("n_words"), covered(hit).alias("n_hit"), found_items(hit).alias("items"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


DECONTAMINATION_SQL = r"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
seen AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, s.k, i, item FROM seen s JOIN win USING (k, phrase)),
word AS (SELECT r, count(DISTINCT place)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hit) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.list, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
