"""Jaccard join of documents on word shingles by vertical partitioning.

The global order of all shingles is cut into fragments, and every step counts overlaps per fragment and sums them:

1. Blocks of documents send each fragment their shingles.  The fragment learns which occur in two documents or more;
   summed over the fragments, that bounds any document's overlap.  Documents whose shared shingles can't reach the
   threshold drop out.  A shingle that a block holds more than once is counted there and sent once.
2. The order is made final: rarer shingles first.  Two linked documents share a shingle among the first
   ``n - ceil(0.75 n) + 1`` of each, so only those prefixes go to fragments again, where documents meet.
   A parity bitmap per document bounds the overlap of a pair from above, without loss.
3. Pairs that remain are counted exactly.  Copies of a set are joined beforehand, and links are sought in two rounds:
   neighbours in each list first; then all pairs that are not yet in one component.  No link between components is lost,
   while a large group of copies never spells out its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import groups, prepare, table
from larkspur.llm.components import components
from larkspur.llm.words import scramble, sequences, word_numbers

K = 5
#: Jaccard of at least NUM / DEN
NUM, DEN = 3, 4
#: Text bytes in a block of documents, shingles in a fragment (on average), documents of one list in a tile
BLOCK_BYTES, FRAGMENT, TILE = 8 << 20, 4_000_000, 4096
LOW48 = np.uint64((1 << 48) - 1)
BITMAP_WORDS = 16
#: Prefix entries of a fragment (on average), and the fewest fragments
ENTRIES, LEAST_FRAGMENTS = 1_000_000, 8


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Gather the stream into tables of about ``most`` bytes and under 65,536 rows."""
    held, size, rows = [], 0, 0
    for b in batches:
        lo = 0
        ends = np.cumsum(np.fromiter((len(x) if x is not None else 0 for x in (t.as_buffer() for t in b.column("text"))), np.int64, b.num_rows)) if b.nbytes > most else None
        while lo < b.num_rows:
            hi = b.num_rows
            if ends is not None:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            part = b.slice(lo, hi - lo)
            if held and (size + part.nbytes > most or rows + part.num_rows > 65_000):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            held.append(part)
            size += part.nbytes
            rows += part.num_rows
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


def distinct_shingles(text: pa.Array, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, text index), ordered by number then text, without repeats inside a text.

    Numbers keep the fragment (the ``bits`` highest bits) and the 48 lowest bits.  Fragments grow in number with the
    corpus, so the chance that different shingles of a fragment share a number stays below 1e-7 for each.
    """
    words, offsets = word_numbers(text, lower=True)
    h, doc, _ = sequences(words, offsets, k, short=True)
    h = (h >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (h & LOW48)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    tied = np.flatnonzero(h[1:] == h[:-1])
    if len(tied):  # the whole runs that end a short text were appended: put ties in order of text
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _sent(batches: Iterator[pa.RecordBatch], bits: int, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, block in enumerate(blocks(batches)):
        rows = block.num_rows
        h, doc = distinct_shingles(block.column("text").combine_chunks(), k, bits)
        sizes = np.bincount(doc, minlength=rows).astype("<i4")
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        repeats = np.diff(np.append(starts, len(h)))
        many = np.repeat(repeats > 1, repeats)
        name = (task << 24) | number
        out = {f: [] for f in schema.names}

        def add(**row):
            for f in out:
                out[f].append(row.get(f))

        add(frag=-1 - (name % 65_536), block=name, ids=block.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes(),
            known=np.asarray(block.column("doc_id").is_valid()).astype(np.uint8).tobytes(), sizes=sizes.tobytes(),
            hashes=h[many].astype("<u8").tobytes(), docs=doc[many].astype("<u2").tobytes())
        one, one_doc = h[~many], doc[~many]
        more, times = h[starts[repeats > 1]], repeats[repeats > 1]
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        a, b = np.append(np.searchsorted(one, edges), len(one)), np.append(np.searchsorted(more, edges), len(more))
        for f in range(1 << bits):
            part, owner = one[a[f]:a[f + 1]], one_doc[a[f]:a[f + 1]]
            order = np.argsort(owner.astype("<u2"), kind="stable")
            add(frag=f, block=name, hashes=pack48((part & LOW48)[order]), docs=np.bincount(owner, minlength=rows).astype("<u2" if len(part) < 65_536 else "<u4").tobytes(),
                sizes=np.array([rows], "<i4").tobytes(), ids=pack48(more[b[f]:b[f + 1]] & LOW48), known=times[b[f]:b[f + 1]].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _met(batches: Iterator[pa.RecordBatch], bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per fragment and block: the shingles found in two documents or more, with how many hold them."""
    for frag, g in groups(batches, "frag"):
        if frag < 0:
            yield from g.select(schema.names).combine_chunks().to_batches()
            continue
        cols = {c: g.column(c).to_pylist() for c in ("block", "hashes", "docs", "sizes", "ids", "known")}
        ones, mores = [unpack48(x) for x in cols["hashes"]], [unpack48(x) for x in cols["ids"]]
        values = np.concatenate(ones + mores)
        weight = np.concatenate([np.ones(sum(map(len, ones)), np.int64)] + [np.frombuffer(x, "<u4").astype(np.int64) for x in cols["known"]])
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        held = np.empty(len(values), np.int64)
        if len(starts):
            held[order] = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(ranked))))
        a, b = 0, sum(map(len, ones))
        out = {f: [] for f in schema.names}
        for i, block in enumerate(cols["block"]):
            n, m = len(ones[i]), len(mores[i])
            rows = int(np.frombuffer(cols["sizes"][i], "<i4")[0])
            counts = np.frombuffer(cols["docs"][i], "<u2" if n < 65_536 else "<u4")
            owner = np.repeat(np.arange(rows), counts)
            common = held[a:a + n] >= 2
            full = lambda low: ((np.uint64(frag) << np.uint64(64 - bits)) | low).astype("<u8")
            if common.any() or m:
                for f, v in (("block", block), ("frag", frag), ("hashes", full(ones[i][common]).tobytes()), ("docs", owner[common].astype("<u2").tobytes()),
                             ("sizes", np.minimum(held[a:a + n][common], 1 << 30).astype("<i4").tobytes()), ("ids", full(mores[i]).tobytes()),
                             ("known", np.minimum(held[b:b + m], 1 << 30).astype("<i4").tobytes())):
                    out[f].append(v)
            a, b = a + n, b + m
        if out["block"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


DOC_SCHEMA = "doc_id bigint, n bigint, shared bigint, digest binary, hashes binary, bands binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its set's size; where it can still link, its shared shingles, rare ones first."""
    for _, g in groups(batches, "block"):
        cols = {c: g.column(c).to_pylist() for c in ("frag", "ids", "known", "sizes", "hashes", "docs")}
        own = next(i for i, f in enumerate(cols["frag"]) if f < 0)
        rest = [i for i in range(len(cols["frag"])) if i != own]
        ids, known = np.frombuffer(cols["ids"][own], "<i8"), np.frombuffer(cols["known"][own], np.uint8)
        sizes = np.frombuffer(cols["sizes"][own], "<i4").astype(np.int64)
        join = lambda c, kind: np.concatenate([np.frombuffer(cols[c][i], kind) for i in rest] or [np.zeros(0, kind)])
        h, doc, held = join("hashes", "<u8"), join("docs", "<u2").astype(np.int64), join("sizes", "<i4")
        more, times = join("ids", "<u8"), join("known", "<i4")
        order = np.argsort(more)
        local, local_doc = np.frombuffer(cols["hashes"][own], "<u8"), np.frombuffer(cols["docs"][own], "<u2").astype(np.int64)
        local_held = times[order][np.searchsorted(more[order], local)] if len(local) else np.zeros(0, "<i4")
        h, doc, held = np.concatenate([h, local]), np.concatenate([doc, local_doc]), np.concatenate([held, local_held])
        band = np.log2(np.maximum(held, 1)).astype(np.uint8)
        shared = np.bincount(doc, minlength=len(ids))
        open_ = (DEN * shared >= NUM * sizes) & (sizes > 0)
        use = open_[doc]
        h, doc, band = h[use], doc[use], band[use]
        order = np.lexsort((h, band, doc))
        h, band = h[order].astype("<u8"), band[order]
        ends = np.concatenate([[0], np.cumsum(np.where(open_, shared, 0))])
        digest = [hashlib.md5(h[ends[i]:ends[i + 1]].tobytes()).digest() if open_[i] and shared[i] == sizes[i] else None for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(shared.astype(np.int64)), pa.array(digest, pa.binary()),
            pa.array([h[ends[i]:ends[i + 1]].tobytes() if open_[i] else None for i in range(len(ids))], pa.binary()),
            pa.array([band[ends[i]:ends[i + 1]].tobytes() if open_[i] else None for i in range(len(ids))], pa.binary())],
            names=["doc_id", "n", "shared", "digest", "hashes", "bands"])


_BLOB = pa.schema([("frag", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary())])
_BLOB_SQL = "frag bigint, block bigint, ids binary, known binary, sizes binary, hashes binary, docs binary"


def shingle_sets(docs: DataFrame, k: int = K) -> DataFrame:
    """Stored rows (row, doc_id, n, shared, digest, hashes, bands): hashes only where the document can still link."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(chars / 6 / FRAGMENT).bit_length())
    sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda b: _sent(b, bits, k, _BLOB), _BLOB_SQL)
    met = sent.repartition("frag").sortWithinPartitions("frag").mapInArrow(lambda b: _met(b, bits, _BLOB), _BLOB_SQL)
    rows = met.repartition("block").sortWithinPartitions("block").mapInArrow(_gathered, DOC_SCHEMA)
    return table(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of a set's elements in each of 1,024 cells: the cells in which two bitmaps differ never outnumber the elements in which the sets do."""
    cells = np.bincount((scramble(h) >> np.uint64(54)).astype(np.int64), minlength=BITMAP_WORDS * 64) & 1
    return np.packbits(cells.astype(np.uint8)).view("<u8")


_TILE = pa.schema([("tile", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("bits", pa.binary()), ("hashes", pa.binary())])
_TILE_SQL = "tile bigint, row bigint, doc_id bigint, comp bigint, n bigint, alone bigint, bits binary, hashes binary"


def _prefixes(batches: Iterator[pa.RecordBatch], fragments: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {f: [] for f in _TILE.names}
        for r in b.to_pylist():
            h, band = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["bands"], np.uint8)
            alone = r["n"] - r["shared"]
            first = r["n"] - -(-NUM * r["n"] // DEN) + 1 - alone
            bits = bitmap(h).tobytes()
            h, band = h[:first], band[:first]
            tiles: dict[int, list] = {}
            frag = (h % np.uint64(fragments)).astype(np.int64)
            parts = np.maximum(1, (2 << band.astype(np.int64)) // TILE)
            for f in np.unique(frag[parts == 1]):
                tiles[int(f)] = h[(parts == 1) & (frag == f)]
            for x, c in zip(h[parts > 1], parts[parts > 1]):  # a very common shingle: its list is dealt to pairs of parts
                own = int(scramble(np.array([r["row"]], np.uint64))[0] % np.uint64(c))
                for j in range(int(c)):
                    spot = scramble(np.array([x], np.uint64) + np.uint64(min(own, j) * int(c) + max(own, j)))[0]
                    tiles[fragments + int(spot >> np.uint64(2))] = np.array([x], "<u8")
            for t, own in tiles.items():
                for f, v in (("tile", t), ("row", r["row"]), ("doc_id", r["doc_id"]), ("comp", r["comp"]), ("n", r["n"]), ("alone", alone), ("bits", bits), ("hashes", own.tobytes())):
                    out[f].append(v)
            if len(out["row"]) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _TILE], schema=_TILE)
                out = {f: [] for f in _TILE.names}
        if out["row"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _TILE], schema=_TILE)


_PAIR_SQL = "row_a bigint, row_b bigint, a bigint, b bigint"


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs to keep so that what they connect stays connected."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _pairs(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile that share a prefix shingle and may link: neighbours at 1, 2, 4, .. places in each list, or with ``every`` all pairs of different components."""
    for _, g in groups(batches, "tile"):
        row, ids, comp, n, alone = (g.column(c).to_numpy() for c in ("row", "doc_id", "comp", "n", "alone"))
        bits = np.frombuffer(b"".join(g.column("bits").to_pylist()), "<u8").reshape(-1, BITMAP_WORDS)
        lists = [np.frombuffer(x, "<u8") for x in g.column("hashes").to_pylist()]
        h = np.concatenate(lists)
        doc = np.repeat(np.arange(len(row)), [len(x) for x in lists])
        order = np.lexsort((row[doc], n[doc], h))
        h, doc = h[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(starts, len(h)))
        left = np.repeat(length, length) - (np.arange(len(h)) - np.repeat(starts, length))  # entries from here to the list's end
        found = [np.zeros(0, np.int64)]

        def test(x, y):
            other = (x != y) & ((comp[x] != comp[y]) if every else True) & (DEN * n[x] >= NUM * n[y]) & (DEN * n[y] >= NUM * n[x])
            x, y = x[other], y[other]
            for lo in range(0, len(x), 100_000):
                p, q = x[lo:lo + 100_000], y[lo:lo + 100_000]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) + alone[p] + alone[q]
                ok = (DEN + NUM) * apart <= (DEN - NUM) * (n[p] + n[q])
                found.append(np.unique(np.minimum(p, q)[ok] * len(row) + np.maximum(p, q)[ok]))

        if not every:
            test(np.repeat(doc[starts], length), doc)
        spots, step = np.arange(len(h)), 1
        while len(spots := spots[left[spots] > step]):
            test(doc[spots], doc[spots + step])
            step += 1 if every else step
        both = np.unique(np.concatenate(found))
        x, y = both // len(row), both % len(row)
        if not every:
            keep = _forest(x, y)
            x, y = x[keep], y[keep]
        for lo in range(0, len(x), 20_000):
            p, q = x[lo:lo + 20_000], y[lo:lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (row[p], row[q], ids[p], ids[q])], names=["row_a", "row_b", "a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y, n, m in zip(b.column("hashes_a"), b.column("hashes_b"), b.column("n_a").to_pylist(), b.column("n_b").to_pylist()):
            both = np.concatenate([np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")])
            both.sort()
            o = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * o >= NUM * (n + m - o))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(sets: DataFrame, fragments: int, every: bool) -> DataFrame:
    """Stored links (a, b) between documents of ``sets`` (.., comp)."""
    tiles = sets.select("row", "doc_id", "comp", "n", "shared", "hashes", "bands").mapInArrow(lambda b: _prefixes(b, fragments), _TILE_SQL)
    pairs = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: _pairs(b, every), _PAIR_SQL)
    pairs = table(pairs.distinct(), "pairs")
    a = sets.select(F.col("row").alias("row_a"), F.col("n").alias("n_a"), F.col("hashes").alias("hashes_a"))
    b = sets.select(F.col("row").alias("row_b"), F.col("n").alias("n_b"), F.col("hashes").alias("hashes_b"))
    both = pairs.join(a, "row_a").join(b, "row_b").select("a", "b", "n_a", "n_b", "hashes_a", "hashes_b")
    return table(both.mapInArrow(_linked, "a bigint, b bigint"), "links")


def jaccard_components(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents linked at Jaccard >= 3/4 on distinct k-word shingles, A-Z lowered.

    Texts of fewer words are one shingle; null and empty texts have none and link with nothing.  A repeated doc_id is
    one node with the links of all its rows.  Rows with a null doc_id keep their count, link with nothing and have a
    null component.  Other columns are not read.  An empty table gives no row.
    """
    prepare(docs.sparkSession)
    sets = shingle_sets(docs, k)
    open_ = sets.filter("hashes is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    same = table(open_.filter("digest is not null").groupBy("digest").agg(first), "firsts")
    copies = open_.filter("digest is not null").select("digest", "doc_id").join(same, "digest").select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b"))
    copies = table(copies.filter("a <> b").distinct(), "copies")
    keep = same.select(F.col("first.row").alias("row"))
    kept = open_.filter("digest is null").unionByName(open_.filter("digest is not null").join(keep, "row", "left_semi"))
    kept = table(kept.withColumn("comp", F.col("doc_id")), "kept")
    entries = kept.agg(F.sum(F.col("n") / DEN)).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, int(entries / ENTRIES))
    near = _links(kept, fragments, every=False)
    roots = table(components(near.unionAll(copies)), "roots")
    marked = kept.drop("comp").join(roots, kept.doc_id == roots.node, "left").withColumn("comp", F.coalesce("root", "doc_id"))
    far = _links(table(marked.drop("node", "root"), "marked"), fragments, every=True)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(far))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = K) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of the smallest doc_id.

    Rows are numbered and stored, and the components are those of the rows: rows that repeat a doc_id are judged by their
    own texts and only one of their copies stays; rows with a null doc_id are compared too and give way to any other.
    Null and empty texts link with nothing and stay.  All columns are kept, whatever their names; an empty table gives none.
    """
    prepare(docs.sparkSession)
    rows = table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "rows")
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), k).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")
    stay = found.join(rows.select("row", F.col("doc.doc_id").alias("doc_id")), "row").groupBy("component_id").agg(first)
    return rows.join(stay.select("row"), "row", "left_semi").select("doc.*")
