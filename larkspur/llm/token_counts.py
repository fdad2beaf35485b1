"""Exact token counts with a whole-token shortcut.

A byte-pair tokenizer first cuts a text into pre-tokens and then merges each one.  Which vocabulary strings come
out of that as exactly one pre-token and one token is proven once, before any document: those pre-tokens count one
without being merged.  Only the rest go through the merges, and each distinct chunk of text is worked out once per
worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Chunks whose counts one Python worker remembers; a full memory starts anew, the counts stay the same.
MEMORY = 300_000


class _Costs(dict):
    """Tokens per chunk of text, worked out at first sight."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[chunk] = self.work(chunk)
        return n


class TokenCounter:
    """Counts what ``Tokenizer.encode(text, add_special_tokens=False)`` returns, without building it."""

    #: A space between two non-spaces starts a pre-token, so a text may be cut in front of it.
    SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
    UNSAFE_SPACE = re.compile(r" \s|\s |^ | $")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.prove()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = _Costs(self.merge)
        self.later = _Costs(lambda chunk: self.merge(" " + chunk))

    def prove(self) -> frozenset[str]:
        """Vocabulary strings, as pre-tokens, that the merges turn into a single token."""
        model = self.tokenizer.model
        return frozenset(t for t in self.tokenizer.get_vocab(with_added_tokens=False) if len(model.tokenize(t)) == 1)

    def merge(self, chunk: str) -> int:
        whole, tokenize = self.whole, self.tokenizer.model.tokenize
        return sum(1 if piece in whole else len(tokenize(piece)) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        chunks = self.SAFE_CUT.split(text) if self.UNSAFE_SPACE.search(text) else text.split(" ")
        return self.first[chunks[0]] + sum(map(self.later.__getitem__, chunks[1:]))


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a tokenizers file that every worker can open.

    A null or empty text has no bytes and no tokens.  Repeated rows and null keys give a row each.  Special strings
    inside a text are the tokens the library makes of them by default.  Other columns are not read.  One narrow pass:
    a lost executor costs only its own partitions.
    """
    schema = f"{key} {dict(docs.dtypes)[key]}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, schema)
