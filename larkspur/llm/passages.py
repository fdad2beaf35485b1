"""Removing passages that an earlier document already holds, with automata of the recurring phrases.

A window is ``WINDOW`` consecutive words.  Of the phrases of ``PHRASE`` words inside it, the one with the smallest
number stands for the window, so equal windows are stood for by equal phrases.

1. Phrases that stand for windows in two documents or more are confirmed as recurring.
2. Confirmed phrases are dealt to shards by the smallest document that holds them, and each shard compiles them into an
   Aho-Corasick automaton.  All documents that hold a shard's phrases stream through it.  A shard with much to read is
   read in parts.
3. Every occurrence names the windows it stands for; the smallest document of each window is found, and all later
   documents lose the words the window covers.  The first holder of a phrase is the first of every window the phrase
   stands for, and first holders are read in all parts.  So a part settles its own windows; only those it finds first in
   a document that is not its phrase's first holder are compared between parts, as runs, once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import prepare, table
from larkspur.llm.jaccard import blocks
from larkspur.llm.words import powers, scramble, word_numbers

WINDOW, PHRASE = 50, 16
#: Confirmed phrases of an automaton; occurrences that one task reads for it
SHARD_PHRASES, PART_OCCURRENCES = 8_000, 120_000
#: Text bytes that stream through an automaton at a time
STEP_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k words from each start."""
    odd, total = powers(_ODD, k), np.full(len(starts), np.uint64(k), np.uint64)
    for j in range(k):
        total += words[starts + j] * odd[j]
    return scramble(total)


def standing(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase numbers by position, window starts, text of each window, position of the phrase that stands for it)."""
    count = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    if not len(text):
        return np.zeros(0, np.uint64), text, text, text
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(text))
    numbers = runs(words, np.arange(len(words) - PHRASE + 1), PHRASE)
    least, reach = np.arange(len(numbers)), 1
    span = WINDOW - PHRASE + 1

    def lower(a, b):
        return np.where(numbers[b] < numbers[a], b, a)

    while 2 * reach <= span:
        least = lower(least[:-reach], least[reach:])
        reach *= 2
    return numbers, starts, text, lower(least[starts], least[starts + span - reach])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        words, offsets = word_numbers(block.column("text").combine_chunks())
        numbers, _, text, at = standing(words, offsets)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        ids = block.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at[new]].view(np.int64)), pa.array(ids[text[new]].astype(np.int64))], names=["phrase", "doc_id"])


class _Shard:
    """One shard, or a part of it: its automaton, and the windows found so far."""

    def __init__(self, tile: int, parts: int):
        self.tile, self.parts = tile, parts
        self.wanted, self.patterns, self.waiting = [], {}, []
        self.known = self.first = None
        self.automaton = None
        self.found: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def spell(words: np.ndarray) -> str:
        """A text with one character for each word."""
        return (words % np.uint64(0xF0000) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")

    def settle(self) -> None:
        """Sort the wanted phrases, each with the smallest document that holds it."""
        if self.known is None:
            phrase, first = (np.concatenate(x) for x in zip(*self.wanted)) if self.wanted else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(phrase)
            self.known, self.first = phrase[order], first[order]

    def learn(self, batch: pa.RecordBatch) -> None:
        """Spell the wanted phrases out of the documents that hold them first."""
        self.settle()
        for rows in blocks([batch], STEP_BYTES):
            words, offsets = word_numbers(rows.column("text").combine_chunks())
            numbers, _, _, at = standing(words, offsets)
            at = np.unique(at)
            spelled = self.spell(words)
            for p in at[np.isin(numbers[at], self.known)].tolist():
                self.patterns[int(numbers[p])] = spelled[p:p + PHRASE]
        self.waiting.append(batch)

    def read(self, batch: pa.RecordBatch) -> None:
        """Let documents stream through the automaton and gather the windows its phrases stand for."""
        if self.automaton is None:
            self.settle()
            self.automaton = ahocorasick.Automaton()
            for number, phrase in self.patterns.items():
                self.automaton.add_word(phrase, number)
            self.patterns = {}
            if len(self.automaton):
                self.automaton.make_automaton()
            for early in self.waiting:
                self.read(early)
            self.waiting = []
        if not len(self.automaton):
            return
        for rows in blocks([batch], STEP_BYTES):
            words, offsets = word_numbers(rows.column("text").combine_chunks())
            numbers, starts, text, at = standing(words, offsets)
            if not len(starts):
                continue
            hit = np.zeros(len(words) + 1, bool)
            for end, number in self.automaton.iter(self.spell(words)):
                p = end - PHRASE + 1
                hit[p] |= int(numbers[p]) == number
            of = hit[at]
            starts, text, phrase = starts[of], text[of], numbers[at[of]]
            if len(starts):
                own = [rows.column(c).to_numpy()[text] for c in ("doc_id", "version", "emit")]
                self.found.append((runs(words, starts, WINDOW), *own, starts - offsets[text], self.first[np.searchsorted(self.known, phrase)]))

    def closed(self) -> Iterator[pa.RecordBatch]:
        """The spans that a smaller document in this part covers, and runs of windows whose smallest document may be in another part."""
        if self.automaton is None and self.waiting:
            self.read(self.waiting.pop(0))
        if not self.found:
            return
        number, doc, version, emit, start, holder = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        order = np.lexsort((doc, number))
        number, doc, version, emit, start, holder = (x[order] for x in (number, doc, version, emit, start, holder))
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        later = doc > np.repeat(doc[first], np.diff(np.append(first, len(number))))
        yield from _runs(doc, version, start, None, later & emit)
        if self.parts > 1:
            yield from _runs(doc, version, start, number, ~later & emit & (doc != holder))


def _runs(doc, version, start, number, wanted) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, numbers, start, stop): windows of a document one word apart as one row; without numbers, any that touch."""
    doc, version, start = doc[wanted], version[wanted], start[wanted]
    if not len(doc):
        return
    order = np.lexsort((start, version, doc))
    doc, version, start = doc[order], version[order], start[order]
    other = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    new = np.flatnonzero(np.concatenate([[True], other | (start[1:] > start[:-1] + (WINDOW if number is None else 1))]))
    if number is None:
        numbers = pa.nulls(len(new), pa.list_(pa.int64()))
    else:
        # a text that stands in several rows gives a window more than once: it then begins a run of its own
        numbers = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(number[wanted][order].view(np.int64)))
    last = np.append(new[1:], len(doc)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(doc[new].astype(np.int64)), pa.array(version[new].astype(np.int64)), numbers, pa.array(start[new].astype(np.int64)),
                                      pa.array((start[last] + WINDOW).astype(np.int64))], names=["doc_id", "version", "numbers", "start", "stop"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard: _Shard | None = None
    for b in batches:
        tile, kind, parts = (b.column(c).to_numpy() for c in ("tile", "kind", "parts"))
        cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tile)]):
            if lo == hi:
                continue
            rows = b.slice(lo, hi - lo)
            if shard is None or shard.tile != tile[lo]:
                if shard is not None:
                    yield from shard.closed()
                shard = _Shard(int(tile[lo]), int(parts[lo]))
            if kind[lo] == 0:
                shard.wanted.append((rows.column("phrase").to_numpy().view(np.uint64), rows.column("doc_id").to_numpy()))
            elif kind[lo] == 1:
                shard.learn(rows)
            else:
                shard.read(rows)
    if shard is not None:
        yield from shard.closed()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, version, start, stop): version is the text's hash, for rows that repeat a doc_id; word spans covered by windows that a smaller doc_id holds too; spans may touch or overlap."""
    prepare(docs.sparkSession)
    text = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    stands = table(text.mapInArrow(_phrases, "phrase bigint, doc_id bigint"), "phrases")
    recurring = stands.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    recurring = table(recurring, "recurring")
    shards = max(1, math.ceil(recurring.count() / SHARD_PHRASES))
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    held = stands.join(recurring, "phrase").groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("first")).alias("early"))
    held = table(held, "held")
    load = held.groupBy("shard").agg(F.ceil(F.sum("n") / PART_OCCURRENCES).alias("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    tile = (F.col("shard") * (1 << 24) + F.col("part")).alias("tile")
    none = {"phrase": F.lit(None).cast("bigint"), "doc_id": F.lit(None).cast("bigint"), "version": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string"), "emit": F.lit(False)}
    cols = ["tile", "kind", "parts", "phrase", "doc_id", "version", "text", "emit"]
    held = held.join(load, "shard")
    wanted = recurring.join(load, "shard").select("phrase", "first", "shard", "parts", every).select(
        tile, F.lit(0).alias("kind"), "parts", "phrase", F.col("first").alias("doc_id"), none["version"].alias("version"), none["text"].alias("text"), none["emit"].alias("emit"))
    early = F.col("early")
    parts = F.when(early, F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    # the texts are always shuffled, at every size: whether the other side could be broadcast depends on how much recurs
    read = held.join(text.hint("merge"), "doc_id").select("doc_id", "text", "shard", "parts", "early", F.explode(parts).alias("part")).select(
        tile, F.when(early, 1).otherwise(2).alias("kind"), "parts", none["phrase"].alias("phrase"), "doc_id", F.xxhash64("text").alias("version"), "text", (~early | (F.col("part") == 0)).alias("emit"))
    stream = wanted.unionByName(read.select(*cols)).repartition("tile").sortWithinPartitions("tile", "kind")
    found = table(stream.mapInArrow(_streamed, "doc_id bigint, version bigint, numbers array<bigint>, start bigint, stop bigint"), "windows")
    apart = found.filter("numbers is not null").select("doc_id", "version", "start", F.posexplode("numbers").alias("i", "number"))
    # of one window each part names one document at most, so no number gathers more rows than there are parts
    least = table(apart.groupBy("number").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("number", "least"), "least")
    at = F.col("start") + F.col("i")
    apart = apart.join(least, "number").filter("doc_id > least").select("doc_id", "version", at.alias("start"), (at + WINDOW).alias("stop"))
    return table(found.filter("numbers is null").select("doc_id", "version", "start", "stop").unionAll(apart), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: kept are the words left, joined by one space.

    Null and empty texts have no words.  Texts shorter than a window lose nothing.  Rows with a null doc_id lose
    nothing and take nothing from others; rows that repeat a doc_id are judged alike, each against smaller ids only.
    Other columns are not read; an empty table gives no row.
    """
    spans = repeated_spans(docs).groupBy("doc_id", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version")).join(spans.hint("merge"), ["doc_id", "version"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, kept = [], [], []
            for t, starts, stops in zip(b.column("text"), b.column("starts"), b.column("stops")):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                size.append(len(words))
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts.values.to_numpy(), 1)
                    np.add.at(edge, stops.values.to_numpy(), -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                gone.append(size[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "starts", "stops").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def removal_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
