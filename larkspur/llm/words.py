"""Words and word sequences of whole Arrow string columns as 64-bit numbers.

A word is a run of bytes outside the six ASCII white-space bytes.  Its number depends on its bytes alone, a sequence's
number on its words alone, so equal passages have equal numbers in every task.  Two different sequences among n share
a number with probability about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes worked on at a time: bounds the memory a very long text takes
CHUNK = 1 << 20


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _chunk_words(raw: np.ndarray, breaks: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, start positions) of the words of ``raw``; no word crosses a position in ``breaks``."""
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1] | False
    first[breaks] = ~space[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    length = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, length)
    value = letters[raw[starts[0]:]]
    value[space[starts[0]:]] = 0
    place[space[starts[0]:]] = 0
    value *= powers(_BASE, int(place.max()) + 1)[place]
    return scramble(np.add.reduceat(value, starts - starts[0])), starts


def word_numbers(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, word offsets per text)."""
    raw, offsets = text_bytes(texts)
    letters = _LOWER if lower else _AS_IS
    numbers, starts, a = [], [], 0
    while a < len(raw):
        b = min(a + CHUNK, len(raw))
        while b < len(raw):  # cut at a space or where a text begins
            nearest = offsets[np.searchsorted(offsets, b)]
            gap = np.flatnonzero(_SPACE[raw[b:min(b + CHUNK, nearest)]])
            if len(gap) or nearest <= b + CHUNK:
                b = int(b + gap[0]) if len(gap) else int(nearest)
                break
            b += CHUNK
        lo, hi = np.searchsorted(offsets, [a, b])
        v, s = _chunk_words(raw[a:b], offsets[lo:hi] - a, letters)
        numbers.append(v)
        starts.append(s + a)
        a = b
    if not numbers:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(numbers), np.searchsorted(np.concatenate(starts), offsets)


def sequences(words: np.ndarray, offsets: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, text index, first word) of all runs of k words; with ``short``, texts of 1 to k - 1 words give their whole run."""
    n = np.diff(offsets)
    runs = np.maximum(n - k + 1, 0)
    text = np.repeat(np.arange(len(n)), runs)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum()) if len(n) else np.zeros(0, np.int64)
    odd = powers(_STEP, k)
    total = np.full(len(first), np.uint64(k), np.uint64)
    for j in range(k):
        total += words[first + j] * odd[j]
    numbers = scramble(total)
    if not short:
        return numbers, text, first
    few = np.flatnonzero((n > 0) & (n < k))
    whole = np.array([np.uint64(n[i]) + (words[offsets[i]:offsets[i + 1]] * odd[:n[i]]).sum(dtype=np.uint64) for i in few], np.uint64)
    return np.concatenate([numbers, scramble(whole)]), np.concatenate([text, few]), np.concatenate([first, offsets[few]])
