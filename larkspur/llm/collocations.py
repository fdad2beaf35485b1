"""Phrase collocations per language from a weighted de Bruijn graph.

1. Words and pairs of neighbours are counted per language.  What is rarer than the least count can stand in no candidate,
   so a piece ends at such a word, and between the words of such a pair.
2. What is left of a text, its runs of three words and more, is stored, and its triples are counted; runs then also end
   inside rare triples.  From every word of a run of four or more goes one edge of five words; where the run ends sooner,
   a shorter one, the piece-end correction.  Equal edges are added up inside a task before they leave it.
3. Edges are cut into ranges and sorted.  Phrases with the same beginning then lie side by side, so one pass derives the
   flow through every node: the count of a phrase is the weight of all edges that begin with it.
   Runs that touch the border of a range are added up over the ranges, so no phrase is too frequent for a task.
4. Where the whole flow of a phrase goes on through one longer phrase, the path between them is unary: it is compacted,
   and only the longer phrase stays.  Cuts of a candidate read their counts from the same nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.common import prepare, table
from larkspur.llm.jaccard import blocks
from larkspur.llm.words import CHUNK, powers, scramble, text_bytes

LONGEST, LEAST, TOP = 5, 100, 2000
#: Frequent words, pairs and triples that may travel to the tasks (eight bytes each).  An edge then takes two numbers; with more
#: words it takes six and nothing is cut, with more pairs only words are, with more triples runs stay whole: the counts are the same
DICTIONARY = (1 << 21) - 1
_BITS = np.uint64(21)
#: Text bytes of a block, words of one slice of edges, edges that a task holds to add equal ones up
BLOCK_BYTES, SLICE, HELD = 4 << 20, 1 << 19, 2_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _words(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, starts, ends, whether a piece begins there) of the words in ``raw``, some megabytes at a time.

    ``offsets`` are where texts begin, and the end; no word crosses one.  A chunk ends at a gap, so a word is never cut; the first
    word of a chunk begins a piece only if a mark or the beginning of a text lies since the word before.
    """
    marks = np.zeros(len(raw) + 1, bool)
    marks[:len(raw)] = _BREAK[raw]
    a, open_break = 0, True
    while a < len(raw):
        b = min(a + CHUNK, len(raw))
        while b < len(raw):
            near = offsets[np.searchsorted(offsets, b)]
            gap = np.flatnonzero(_GAP[raw[b:min(b + CHUNK, near)]])
            if len(gap) or near <= b + CHUNK:
                b = int(b + gap[0]) if len(gap) else int(near)
                break
            b += CHUNK
        part, gaps = raw[a:b], _GAP[raw[a:b]]
        lo, hi = np.searchsorted(offsets, [a, b])
        begins = offsets[lo:hi] - a
        first = ~gaps
        first[1:] &= gaps[:-1]
        first[begins] = ~gaps[begins]
        starts = np.flatnonzero(first)
        # breaks up to each byte: marks, and texts that begin
        broken = marks[a:b].astype(np.int32)
        np.add.at(broken, begins, 1)
        total = np.cumsum(broken)
        if len(starts):
            place = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
            value = _LOWER[part[starts[0]:]]
            inside = gaps[starts[0]:]
            value[inside], place[inside] = 0, 0
            value *= powers(_BASE, int(place.max()) + 1)[place]
            numbers = scramble(np.add.reduceat(value, starts - starts[0]))
            ends = starts + np.add.reduceat((~inside).astype(np.int64), starts - starts[0])
            seen = total[starts]
            new = np.concatenate([[open_break or seen[0] > 0], seen[1:] > seen[:-1]])
            yield numbers, starts + a, ends + a, new
            open_break = bool(total[-1] > seen[-1])
        else:
            open_break = open_break or bool(total[-1] > 0)
        a = b


def _language(names: pa.Array) -> np.ndarray:
    """A number for each language name."""
    known: dict[str, int] = {}
    for n in set(names.to_pylist()):
        known[n] = int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little")
    return np.array([known[n] for n in names.to_pylist()], np.uint64)


def _entries(block: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]], np.ndarray]:
    raw, offsets = text_bytes(block.column("text").combine_chunks())
    languages = _language(block.column("lang").combine_chunks())
    return raw, offsets, list(_words(raw, offsets[np.append(np.diff(offsets) > 0, True)])), languages


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): the words of a block, added up."""
    for block in blocks(batches, BLOCK_BYTES):
        names = block.column("lang").to_pylist()
        raw, offsets, parts, languages = _entries(block)
        for numbers, starts, ends, _ in parts:
            text = np.searchsorted(offsets, starts, side="right") - 1
            _, first, n = np.unique(scramble(numbers + languages[text]), return_index=True, return_counts=True)
            data, base = raw[starts[0]:ends[-1]].tobytes(), int(starts[0])
            spelled = [data[s - base:e - base].translate(_FOLD) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in text[first].tolist()], pa.string()),
                                              pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _with_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n, entry): an entry is a word's number in its language."""
    for b in batches:
        if b.num_rows:
            _, _, parts, languages = _entries(pa.Table.from_arrays([b.column("word"), b.column("lang")], names=["text", "lang"]))
            entry = scramble(np.concatenate([p[0] for p in parts]) + languages)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(entry.view(np.int64))], names=[*b.schema.names, "entry"])


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _pack(ids: np.ndarray) -> np.ndarray:
    """Five ids of 21 bits as two columns: the first two words, the last three."""
    return np.stack([ids[:, 0] << _BITS | ids[:, 1], ids[:, 2] << (_BITS + _BITS) | ids[:, 3] << _BITS | ids[:, 4]], 1)


def _ids(block: pa.Table, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of every word, whether a piece begins there, its text); with a dictionary, words outside it are 0 and pieces of their own."""
    _, offsets, parts, languages = _entries(block)
    ids, begin, text = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for numbers, starts, _, new in parts:
        text.append(np.searchsorted(offsets, starts, side="right") - 1)
        entry = scramble(numbers + languages[text[-1]])
        if known is not None:
            entry = entry.view(np.int64)
            at = np.minimum(np.searchsorted(known.value, entry), len(known.value) - 1)
            entry = np.where(known.value[at] == entry, at + 1, 0).astype(np.uint64)
        ids.append(entry)
        begin.append(new)
    ids, begin, text = np.concatenate(ids), np.concatenate(begin), np.concatenate(text)
    if known is not None:
        rare = ids == 0
        begin |= rare
        begin[1:] |= rare[:-1]
    return ids, begin, text


def _pairs(known):
    """(c0, n): neighbouring words of a piece as one number, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids, begin, _ = _ids(block, known)
            pair = (ids[:-1] << _BITS | ids[1:])[~begin[1:]]
            found, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["c0", "n"])
    return run


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ``keys`` added up, sorted."""
    order = np.lexsort(keys.T[::-1])
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[new], np.add.reduceat(n, new)


def _sums(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(c0.., n): the keys that a task finds, equal ones added up; at most ``HELD`` wait."""
    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(np.ascontiguousarray(keys[:, c]).view(np.int64)) for c in range(keys.shape[1])]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*[f"c{c}" for c in range(len(cols))], "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for keys in found:
        if len(keys):
            held.append(_added(keys, np.ones(len(keys), np.int64)))
        if sum(len(n) for _, n in held) > HELD:
            held = [_added(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][1]) > HELD // 2:
                yield out(*held.pop())
    if held:
        yield out(*_added(*(np.concatenate(x) for x in zip(*held))))


def _lengths(begin: np.ndarray) -> np.ndarray:
    """Words from each word to the end of its piece, itself included."""
    stops = np.append(np.flatnonzero(begin), len(begin))
    return stops[np.searchsorted(stops, np.arange(len(begin)), side="right")] - np.arange(len(begin))


def _keyed(ids: np.ndarray, length: np.ndarray, shortest: int, packed: bool) -> Iterator[np.ndarray]:
    """The edges of ``shortest`` words and more; ``length``: words left from each word on."""
    ids = np.append(ids, np.zeros(LONGEST, np.uint64))
    at, length = np.flatnonzero(length >= shortest), np.minimum(length, LONGEST)
    for lo in range(0, len(at), SLICE):
        p = at[lo:lo + SLICE]
        edge = np.where(np.arange(LONGEST) < length[p][:, None], ids[p[:, None] + np.arange(LONGEST)], np.uint64(0))
        yield _pack(edge) if packed else np.concatenate([edge, length[p][:, None].astype(np.uint64)], 1)


def _edges(known):
    """(c0.., n): the edges of two words and more of a task's texts; ``known``: broadcast sorted entries of frequent words, or None where any may occur."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for block in blocks(batches, BLOCK_BYTES):
            ids, begin, _ = _ids(block, known)
            yield from _keyed(ids, _lengths(begin), 2, known is not None)
    return lambda batches: _sums(found(batches))


def _runs(known, pairs):
    """(ids): per text its runs of three words and more in which all pairs are frequent, a 0 after each; none for texts without.

    ``pairs``: broadcast sorted numbers of the frequent pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids, begin, text = _ids(block, known)
            if not len(ids):
                continue
            pair = (ids[:-1] << _BITS | ids[1:]).view(np.int64)
            at = np.minimum(np.searchsorted(pairs.value, pair), len(pairs.value) - 1)
            begin[1:] |= pairs.value[at] != pair
            stops = np.append(np.flatnonzero(begin), len(ids))
            kept = np.repeat(np.diff(stops) >= 3, np.diff(stops))
            last = np.append(begin[1:], True)[kept]
            ids, text = ids[kept], text[kept]
            if not len(ids):
                continue
            # a 0 behind the last word of each run
            place = np.arange(len(ids)) + np.cumsum(last) - last
            flat, of = np.zeros(len(ids) + int(last.sum()), np.int32), np.zeros(len(ids) + int(last.sum()), np.int64)
            flat[place], of[place], of[place[last] + 1] = ids, text, text[last]
            rows = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(flat))], names=["ids"])
    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of stored runs, about ``SLICE`` at a time; runs stay whole."""
    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column("ids").flatten().to_numpy().astype(np.uint64))
        if sum(map(len, held)) >= SLICE:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _three(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all triples, whether each lies inside a run)."""
    return ids[:-2] << (_BITS + _BITS) | ids[1:-1] << _BITS | ids[2:], (ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c0, n): three neighbouring words of a run as one number, added up."""
    def found() -> Iterator[np.ndarray]:
        for ids in _flat(batches):
            triple, inside = _three(ids)
            yield triple[inside][:, None]
    return _sums(found())


def _long_edges(triples):
    """(c0, c1, n): the edges of four words and more of stored runs; ``triples``: broadcast sorted numbers of the frequent ones, or None where any may occur."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for ids in _flat(batches):
            triple, good = _three(ids)
            if triples is not None:
                at = np.minimum(np.searchsorted(triples.value, triple.view(np.int64)), len(triples.value) - 1)
                good &= triples.value[at] == triple.view(np.int64)
            # from a word on, two neighbouring triples make four words, three make five
            length = np.zeros(len(ids), np.int64)
            length[:-3] = 4 * (good[:-1] & good[1:])
            length[:-4] += good[:-2] & good[1:-1] & good[2:]
            yield from _keyed(ids, length, 4, True)
    return lambda batches: _sums(found(batches))


def _beginnings(keys: np.ndarray, k: int, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the first k words of each edge as a key, which edges have them)."""
    if packed:
        keep = {2: 0, 3: 42, 4: 21, 5: None}[k]
        last = keys[:, 1] if keep is None else np.zeros(len(keys), np.uint64) if keep == 0 else keys[:, 1] >> np.uint64(keep) << np.uint64(keep)
        least = {2: np.ones(len(keys), bool), 3: keys[:, 1] >> np.uint64(42) > 0, 4: keys[:, 1] >> _BITS & np.uint64(DICTIONARY) > 0, 5: keys[:, 1] & np.uint64(DICTIONARY) > 0}[k]
        return np.stack([keys[:, 0], last], 1), least
    out = keys.copy()
    out[:, k:LONGEST] = 0
    out[:, LONGEST] = k
    return out, keys[:, LONGEST] >= k


def _flows(least: int, packed: bool, shortest: int):
    """Counts of all beginnings of ``shortest`` words and more in one sorted range; those below ``least`` only where the range may hold a part of them."""
    columns = 2 if packed else LONGEST + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int, bool] | None] = {k: None for k in range(shortest, LONGEST + 1)}

        def rows(k: int, keys: np.ndarray, n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), *[pa.array(np.ascontiguousarray(keys[:, c]).view(np.int64)) for c in range(columns)],
                                               pa.array(n, pa.int64())], names=["k", *[f"c{c}" for c in range(columns)], "n"])

        for b in batches:
            if not b.num_rows:
                continue
            all_keys = np.stack([b.column(f"c{c}").to_numpy().view(np.uint64) for c in range(columns)], 1)
            weight = b.column("n").to_numpy()
            for k in held:
                keys, has = _beginnings(all_keys, k, packed)
                keys, w = keys[has], weight[has]
                if not len(keys):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
                n, at = np.add.reduceat(w, new), keys[new]
                edge = np.zeros(len(n), bool)
                if held[k] is None:
                    edge[0] = True
                else:
                    key, past, first = held[k]
                    if (key == at[0]).all():
                        n[0] += past
                        edge[0] = first
                    elif past >= least or first:
                        yield rows(k, key[None], [past])
                held[k] = (at[-1], int(n[-1]), bool(edge[-1]))
                out = np.flatnonzero((n[:-1] >= least) | edge[:-1])
                if len(out):
                    yield rows(k, at[out], n[out].tolist())
        for k, last in held.items():
            if last is not None:
                yield rows(k, last[0][None], [last[1]])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored (lang, word, n): how often each word occurs in each language."""
    made = _texts(docs).mapInArrow(_count_words, "lang string, word string, n bigint")
    return table(made.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def phrase_counts(docs: DataFrame, counts: DataFrame, least: int, dictionary: int = DICTIONARY) -> tuple[DataFrame, DataFrame]:
    """(phrases: stored (k, ids, n) of 2 to 5 words counted ``least`` times or more; words: stored (id, lang, word, n) of such words)."""
    spark, text = docs.sparkSession, _texts(docs)
    frequent = table(counts.filter(F.col("n") >= least).mapInArrow(_with_entry, "lang string, word string, n bigint, entry bigint"), "entries")

    def sorted_if_few(df: DataFrame) -> np.ndarray | None:
        some = df.limit(dictionary + 1).toArrow().column(0).to_numpy()
        return np.sort(some) if len(some) <= dictionary else None

    entries = sorted_if_few(frequent.select("entry"))
    packed = entries is not None
    if packed:
        # a word's id is its place among the sorted entries
        places = spark.createDataFrame(pa.table({"entry": entries, "id": np.arange(1, len(entries) + 1)}))
        words = table(frequent.join(places, "entry").select("id", "lang", "word", "n"), "frequent")
    else:
        words = table(frequent.select(F.col("entry").alias("id"), "lang", "word", "n"), "frequent")
    columns = [f"c{c}" for c in range(2 if packed else LONGEST + 1)]
    longs = ", ".join(f"{c} bigint" for c in columns)
    low = F.lit(DICTIONARY)

    def counted(df: DataFrame, label: str) -> DataFrame:
        return table(df.groupBy("c0").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), label)

    known, shortest, shorter = None, 2, []
    if packed and not len(entries):
        edges = None
    else:
        if packed:
            known = spark.sparkContext.broadcast(entries)
            often = counted(text.mapInArrow(_pairs(known), "c0 bigint, n bigint"), "pairs")
            pairs = sorted_if_few(often.select("c0"))
        if not packed or pairs is None:
            edges = table(text.mapInArrow(_edges(known), f"{longs}, n bigint"), "edges")
        else:
            # pairs and triples have their counts already: edges are left for four words and more, and only where all triples are frequent
            shortest, edges = 4, None
            shorter.append(often.select(F.lit(2).alias("k"), F.array(F.shiftright("c0", 21), F.col("c0").bitwiseAND(low)).alias("ids"), "n"))
            if len(pairs):
                runs = table(text.mapInArrow(_runs(known, spark.sparkContext.broadcast(pairs)), "ids array<int>"), "runs")
                often = counted(runs.mapInArrow(_triples, "c0 bigint, n bigint"), "triples")
                triples = sorted_if_few(often.select("c0"))
                shorter.append(often.select(F.lit(3).alias("k"), F.array(F.shiftright("c0", 42), F.shiftright("c0", 21).bitwiseAND(low), F.col("c0").bitwiseAND(low)).alias("ids"), "n"))
                if triples is None or len(triples):
                    held = spark.sparkContext.broadcast(triples) if triples is not None else None
                    edges = table(runs.mapInArrow(_long_edges(held), f"{longs}, n bigint"), "edges")
    if edges is None:
        edges = spark.createDataFrame([], f"{longs}, n bigint")
    # ranges of whole edges: a beginning may go on in the next range, so none is too frequent for a task
    ranged = edges.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).sortWithinPartitions(*columns)
    flows = ranged.mapInArrow(_flows(least, packed, shortest), f"k int, {longs}, n bigint").groupBy("k", *columns).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    if packed:
        mid = F.col("c1")
        ids = F.array(F.shiftright("c0", 21), F.col("c0").bitwiseAND(low), F.shiftright(mid, 42), F.shiftright(mid, 21).bitwiseAND(low), mid.bitwiseAND(low))
    else:
        ids = F.array(*columns[:LONGEST])
    phrases = flows.select("k", F.slice(ids, F.lit(1), F.col("k")).alias("ids"), "n")
    for more in shorter:
        phrases = phrases.unionAll(more)
    return table(phrases, "flows"), words


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 100, dictionary: int = DICTIONARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase counted a times whose cut leaves parts counted l and r scores floor(1000 a n / (l r)) at its worst cut, n
    being all words of the language.  A phrase inside a longer one that holds ``share`` per cent of its count or more is
    left out: as counts only fall from a phrase to a longer one, it is enough to look one word further on either side.
    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they stand; ties
    go to the phrase that comes first by its bytes.  Other columns are not read; an empty table gives no row.
    """
    prepare(docs.sparkSession)
    counts = word_counts(docs)
    phrases, words = phrase_counts(docs, counts, least, dictionary)
    parts = phrases.select("ids", "n").unionAll(words.select(F.array("id").alias("ids"), "n"))
    longer = phrases.filter("k > 2").select("ids", F.col("n").alias("m"), F.explode(F.array(F.slice("ids", F.lit(1), F.col("k") - 1), F.slice("ids", F.lit(2), F.col("k") - 1))).alias("inner"))
    fullest = longer.groupBy("inner").agg(F.max("m").alias("m"))
    kept = phrases.join(fullest, F.col("ids") == F.col("inner"), "left").filter(F.col("m").isNull() | (F.lit(100) * F.col("m") < F.lit(share) * F.col("n"))).select("k", "ids", F.col("n").alias("a"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = kept.withColumn("id", F.col("ids")[0]).join(words.select("id", "lang"), "id").join(totals, "lang").select("lang", "n", "k", "ids", "a")
    cuts = kept.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("at")), "right": F.slice("ids", F.col("at") + 1, F.col("k") - F.col("at"))})
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.withColumns({"over": _wide(F.lit(1000)) * _wide(F.col("a")) * _wide(F.col("n")), "under": _wide(F.col("l")) * _wide(F.col("r"))})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "n", "ids", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("w"))
    worst = table(worst.select("lang", "n", "ids", "a", "w.score", "w.l", "w.r"), "scored")
    named = worst.select("ids", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = named.select("ids", F.array_join(F.transform("w", lambda x: x.word), " ").alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = worst.join(named, "ids").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) AS t(k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND f >= 100),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS m
  FROM (SELECT lang, w, a, j, unnest(range(1, k - j + 2)) AS i FROM cand, range(2, 5) AS t(j) WHERE j < k)
  GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.m IS NULL OR 100 * i.m < 100 * c.a),
cut AS (
  SELECT c.lang, c.phrase, c.a, n, cut_at, x.f AS l, y.f AS r, ((1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM kept) c JOIN total USING (lang)
  JOIN gram x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut_at], ' ')
  JOIN gram y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut_at + 1:], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) AS o FROM cut),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst WHERE o = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
