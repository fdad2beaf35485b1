"""Packing and token counts against the library, mixing against its contract."""

import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from larkspur.llm.mixing import mix, mix_report
from larkspur.llm.packing import chunk_ids, encode, hilbert, pack_report
from larkspur.llm.token_counts import counter, token_counts

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  two  spaces ", "line\nbreak \n x", "it's we'll <|endoftext|> x<|endoftext|>", "ÀÉ ΑΣ ß İ é ́", "　wide no-break\x1cunit", "a" * 5000,
       "12345 7,8!!", "tab\tand\r\nreturn", "emoji \U0001f600\U0001f680 x"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z'sné\n\t 1,. ́<|>Σ\U0001f600"), max_size=40))
def test_counts_and_ids_equal_the_library(text):
    assert counter(BYTE).count(text) == len(Tokenizer_of(BYTE).encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encode(text, chunk_ids(WORDS)), "<u4").tolist() == Tokenizer_of(WORDS).encode(text, add_special_tokens=False).ids


_MADE = {}


def Tokenizer_of(path):
    return _MADE.setdefault(path, Tokenizer.from_file(path))


def test_every_code_point_between_letters():
    texts = [f"a{chr(c)} {chr(c)}b {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    want = Tokenizer_of(BYTE).encode_batch(texts, add_special_tokens=False)
    assert [counter(BYTE).count(t) for t in texts] == [len(e.ids) for e in want]
    want = Tokenizer_of(WORDS).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(encode(t, chunk_ids(WORDS)), "<u4").tolist() for t in texts] == [e.ids for e in want]


def test_token_counts(spark, make_docs):
    docs = make_docs(ODD + ODD[:2]).withColumnRenamed("n_chars", "n_tokens")
    got = {r.doc_id: r for r in token_counts(docs, BYTE).collect()}
    for i, t in enumerate(ODD):
        n = len(Tokenizer_of(BYTE).encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_counts(docs.limit(0), BYTE).count() == 0


def test_hilbert_steps_are_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    walk = cells[np.argsort(hilbert(cells, 3))]
    assert sorted(hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pack(spark, make_docs):
    texts = ODD + ["word " * 6000] + ODD
    docs = make_docs([(i % 9, t, "s") for i, t in enumerate(texts)]).withColumnRenamed("n_chars", "ids")
    pieces = pack_report(docs, WORDS).toPandas()
    total = sum(len(Tokenizer_of(WORDS).encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert pieces.length.sum() == total and (pieces.length > 0).all()
    for s, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() == 2048 or s == pieces.sequence_id.max()
    whole = {zlib.crc32(np.array(Tokenizer_of(WORDS).encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for t in texts}
    assert set(pieces[pieces.length == pieces.doc_tokens].ids_crc32) <= whole
    assert pack_report(docs.limit(0), WORDS).count() == 0


def test_pack_cuts_are_the_ids(spark, make_docs):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n)) for n in (900, 1500, 4000, 3, 700)]
    for r in pack_report(make_docs(texts), WORDS).collect():
        ids = np.array(Tokenizer_of(WORDS).encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_mix(spark, make_docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 11 else None, [None, "a", "b", "é", "z", "zz"][min(int(rng.integers(0, 9)), 5)]) for i in range(900)]
    rows += [(5, "twice the same", "a")] * 3 + [(None, "no id", "b")]
    got = mix_report(make_docs(rows)).toPandas()
    again = mix_report(make_docs(rows[::-1])).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    sources = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sources.taken - sources.target) <= 60).all()
    assert abs(sources.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert (sources.target <= 2 * sources.index + 1e-9).all()


def test_mix_emits_the_plan(spark, make_docs):
    rows = [(i % 40, f"text {'x ' * (i % 7)}", "abcd"[i % 4]) for i in range(200)] + [(1, None, None)]
    docs = make_docs(rows).withColumnRenamed("n_chars", "size")
    taken = defaultdict(int)
    for r in mix(docs).collect():
        taken[r.doc_id] += len((r.text or "").split())
    want = defaultdict(int)
    for r in mix_report(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}
    assert mix(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0 and mix_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("path", [BYTE])
def test_whole_tokens_are_proven(path):
    c = counter(path)
    assert 40_000 < len(c.whole) <= c.tokenizer.get_vocab_size(with_added_tokens=False)
    assert sys.getsizeof(c.whole) < 1 << 23
