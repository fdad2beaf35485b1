"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's token ids are counted into a hashed vector, projected to a few dimensions and given the position of
its cell on a Hilbert curve.  Documents are laid end to end in the order of that curve, so a sequence holds documents
that resemble each other, and the line is cut every ``length`` ids.  Only the last sequence can be short.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import ordered, prepare, table

LENGTH = 2048
END_ID = 1
#: Buckets of the hashed vector, dimensions of the projection, bits per dimension of the curve
BUCKETS, DIMS, BITS = 256, 4, 10
#: Chunks whose ids one Python worker remembers
MEMORY = 400_000


class _Ids(dict):
    """Ids per chunk of text without spaces, little-endian; a full memory starts anew."""

    #: Latin letters alone are one pre-token.
    PLAIN = re.compile(r"[a-zß-öø-ÿ]+")

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        letters = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)] if chr(c).isalpha()]
        self.spelling = str.maketrans({c: tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = [t.id for t in self.tokenize(chunk.translate(self.spelling))] if self.PLAIN.fullmatch(chunk) else self.encode(chunk, add_special_tokens=False).ids
        out = self[chunk] = np.asarray(ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=4)
def chunk_ids(vocabulary: str) -> _Ids:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return _Ids(Tokenizer.from_file(vocabulary))


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS)) / np.sqrt(BUCKETS)


#: A full stop or comma right after another mark belongs to that mark's pre-token.
_RUN_OF_MARKS = re.compile(r"(?:[^\w\s]|[_\x1c-\x1f])[.,]")


def encode(text: str | None, ids: _Ids) -> bytes:
    """Ids of a whole text, little-endian.

    The tokenizer drops white space, so a text may be cut at its spaces.  In Latin-1 texts, where lower case goes letter
    by letter, case and single stops and commas are taken off first: more chunks are alike.
    """
    if not text:
        return b""
    try:
        text.encode("latin-1")
        if "<|" not in text:
            low = text.lower()
            if not _RUN_OF_MARKS.search(low):
                text = low.replace(".", " .").replace(",", " ,").replace("\n", " ")
    except UnicodeEncodeError:
        pass
    return b"".join(map(ids.__getitem__, text.split(" ")))


def place(ids: np.ndarray) -> np.ndarray:
    """Project the hashed, damped counts of a document's ids; an empty document sits at the origin."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    counts = np.log1p(np.bincount(bucket.astype(np.int64), minlength=BUCKETS))
    norm = np.linalg.norm(counts)
    return (counts / norm if norm else counts) @ projection()


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer grid cells (rows of ``cells``) on the Hilbert curve of their dimension.

    The cell's coordinates are turned into the curve's Gray-coded form axis by axis, from the highest bit down:
    a set bit mirrors the lower bits of the first axis, a clear one swaps them with the axis at hand.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(n):
            on = (x[:, axis] >> bit) & 1 == 1
            x[on, 0] ^= low
            moved = np.where(on, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= moved
            x[:, axis] ^= moved
    for axis in range(1, n):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[:, axis] >> bit) & 1)
    return key


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Stored rows (row, doc_id, n, spot, ids): ids end with ``END_ID``, spot is the projected vector."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = chunk_ids(vocabulary), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            raw = [encode(t.as_py(), ids) for t in b.column(1)]
            spots = [place(np.frombuffer(r, "<u4")).tolist() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) // 4 + 1 for r in raw], pa.int64()), pa.array(spots, pa.list_(pa.float64())), pa.array([r + end for r in raw], pa.binary())],
                names=["doc_id", "n", "spot", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, spot array<double>, ids binary")
    return table(out.select(F.monotonically_increasing_id().alias("row"), "*"), "ids")


def curve_keys(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n, key): each dimension is centred and scaled by its spread over all documents before it is cut into cells."""
    stats = rows.agg(*[f(F.col("spot")[i]).alias(f"{name}{i}") for i in range(DIMS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])

    @F.pandas_udf("long")
    def key(spot: pd.Series) -> pd.Series:
        z = (np.stack(spot.to_numpy()) - mean) / spread
        return pd.Series(hilbert(np.clip((z + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))

    return table(rows.select("row", "doc_id", "n", key("spot").alias("key")), "keys")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents.

    Null and empty texts are documents of the end id alone.  Repeated rows, also of one doc_id, are packed each on
    their own; ties on the curve go by doc_id.  ``ids`` are the piece's little-endian 32-bit ids.  A long document is
    cut where the line is cut; an empty table gives no piece.
    """
    rows = tokenized(docs, vocabulary)
    line = ordered(curve_keys(rows), ["key", F.col("doc_id").asc_nulls_last(), "row"], "n", label="line").select("row", "before")
    first, last = F.floor(F.col("before") / length), F.floor((F.col("before") + F.col("n") - 1) / length)

    def piece(s):
        start = F.greatest(s * length - F.col("before"), F.lit(0).cast("long"))
        end = F.least((s + 1) * length - F.col("before"), F.col("n"))
        return F.struct(start.alias("start"), (end - start).alias("length"), s.alias("sequence_id"), (F.col("before") + start - s * length).alias("offset"),
                        F.substring("ids", (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")).alias("ids"))

    cut = F.transform(F.sequence(first, last), piece)
    return rows.join(line, "row").select("doc_id", F.col("n").alias("doc_tokens"), F.inline(cut)).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def pack_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
