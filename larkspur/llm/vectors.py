"""Vectors: which take part, exact nearest neighbours by multi-index hashing, near-duplicates by random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.common import groups, prepare, table
from larkspur.llm.components import components
from larkspur.llm.words import scramble

#: Multi-index hashing: rows the rotation is learned from, rows of one indexed block, substrings of a code, sampled
#: neighbours that the radius must reach
FIT_ROWS, INDEX_ROWS, SUBSTRINGS, REACH = 20_000, 4_000, 8, 0.985
#: Hyperplane tables: share of the pairs at the threshold that meet in a table, rows of a tile
RECALL, TILE_ROWS = 0.999, 1_024


def usable(vec: str) -> Column:
    """Not null, not empty, not all zero, no component null, NaN or infinite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish; directions stay."""
    return x / np.abs(x).max(1)[:, None] if x.size else x


def learn_codes(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(centre, rotation): principal directions turned so that the signs lose as little as possible."""
    centre = sample.mean(0)
    x = sample - centre
    _, _, v = np.linalg.svd(x.T @ x)
    main = v[:bits].T
    y = x @ main
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(y @ turn).T @ y)
        turn = (u @ w).T
    return centre, main @ turn


def codes_of(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    on = (x - centre) @ rotation > 0
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def learn_radius(sample: np.ndarray, codes: np.ndarray, k: int, reach: float = REACH, queries: int = 400) -> int:
    """Hamming radius that holds ``reach`` of the sample's true neighbours; among more rows neighbours are nearer, so it holds more.

    The first ``queries`` rows are measured: ``sample`` must hold distinct vectors in an order that has nothing to do with the table's.
    """
    q = min(queries, len(sample))
    apart = np.empty((q, min(k, len(sample) - 1)), np.int64)
    for i in range(q):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, apart.shape[1] - 1)[:apart.shape[1]]
        apart[i] = np.bitwise_count(codes[near] ^ codes[i])
    return int(np.quantile(apart, reach, method="higher")) if apart.size else 0


def draw(base: DataFrame) -> np.ndarray:
    """At most ``FIT_ROWS`` distinct vectors ``v``, chosen and ordered by their hash, so that copies count once wherever they stand."""
    hashed = base.select("v", F.xxhash64("v").alias("_at"))
    distinct = hashed.agg(F.approx_count_distinct("_at", 0.02)).first()[0]
    share = F.pmod("_at", F.lit(1 << 30)) < int(min(1.0, 1.1 * FIT_ROWS / max(distinct, 1)) * (1 << 30))
    return matrix(hashed.filter(share).groupBy("_at").agg(F.min("v").alias("v")).orderBy("_at").limit(FIT_ROWS).select("v").toArrow().column("v"))


class MultiIndex:
    """One block of rows: a table per substring of the code, probed within radius // substrings of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, bits: int):
        self.ids, self.x, self.codes, self.bits = ids, x, codes, bits
        self.width = -(-bits // SUBSTRINGS)
        self.tables, self.lists = [], {}
        for t in range(SUBSTRINGS):
            part = self.part(codes, t)
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << self.width) + 1))))

    def part(self, codes, t):
        return ((codes >> np.uint64(t * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, t: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring t lies within ``radius`` of ``value``."""
        key = (t, value, radius)
        if key not in self.lists:
            order, starts = self.tables[t]
            probes = np.arange(1 << self.width)
            probes = probes[np.bitwise_count(probes ^ value) <= radius]
            self.lists[key] = np.concatenate([order[starts[p]:starts[p + 1]] for p in probes])
        return self.lists[key]

    def search(self, own: int, query: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest by exact distance of the rows within the Hamming radius, which widens until k are found."""
        while True:
            met = np.zeros(len(self.ids), bool)
            for t in range(SUBSTRINGS):
                met[self.near(t, int(self.part(code, t)), min(self.width, radius // SUBSTRINGS))] = True
            met &= (np.bitwise_count(self.codes ^ code) <= radius) & (self.ids != own)
            rows = np.flatnonzero(met)
            if len(rows) >= k or radius >= self.bits:
                break
            radius = min(self.bits, radius + SUBSTRINGS)
        score = np.sqrt(((self.x[rows] - query) ** 2).sum(1))
        order = np.lexsort((self.ids[rows], score))
        _, first = np.unique(self.ids[rows][order], return_index=True)  # rows that repeat a vec_id: the nearest counts
        order = order[np.sort(first)][:k]
        return self.ids[rows][order], score[order]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", block_rows: int = INDEX_ROWS) -> DataFrame:
    """(query_id, rank, key, score): for each row of ``queries`` the ``k`` nearest rows of ``df`` with another key.

    Unusable vectors and null keys take no part on either side; vectors of each length are searched among themselves, as
    distances between lengths are not defined.  A query key that is repeated asks once a length, with its smallest
    vector.  Ties go to the smaller key; if there are fewer rows, all are returned; an empty table gives no row; other
    columns are not read.  The rotation and the radius are learned from at most ``FIT_ROWS`` distinct vectors of a length; every
    row is indexed.  Queries visit each block of ``block_rows`` rows once and stream past it; a block returns k rows a query.
    """
    prepare(df.sparkSession)
    base = df.filter(F.col(key).isNotNull() & usable(vec)).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    base = table(base, "vectors")
    asked = queries.filter(F.col(key).isNotNull() & usable(vec)).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    found = df.sparkSession.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    # one row for each length that occurs
    for r in base.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        near = _nearest(base.filter(F.size("v") == r.d), asked.filter(F.size("v") == r.d).groupBy("id").agg(F.min("v").alias("v")), r.d, r["count"], k, key, block_rows)
        found = found.unionByName(near)
    return found


def _nearest(base: DataFrame, asked: DataFrame, size: int, n: int, k: int, key: str, block_rows: int) -> DataFrame:
    blocks = max(1, math.ceil(n / block_rows))
    out = f"query_id bigint, {key} bigint, score double"
    sample = draw(base) if n > 1 else np.zeros((0, size))
    if len(sample) < 2:
        sample = np.concatenate([np.eye(size), -np.eye(size)])
    bits = min(64, size)
    # a power of two keeps products of very large or small components finite and changes no digit
    scale = 2.0 ** -int(np.frexp(np.abs(sample).max())[1])
    centre, rotation = learn_codes(sample * scale, bits)
    radius = learn_radius(sample * scale, codes_of(sample * scale, centre, rotation), k)

    indexed = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "v")
    visiting = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, at = [], None, None
        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if block[lo] != at:
                    held, index, at = [], None, block[lo]
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    rows = pa.Table.from_batches(held)
                    x = matrix(rows.column("v"))
                    index = MultiIndex(rows.column("id").to_numpy(), x, codes_of(x * scale, centre, rotation), bits)
                q = matrix(part.column("v"))
                found = [(int(i), *index.search(int(i), v, c, radius, k)) for i, v, c in zip(part.column("id").to_numpy(), q, codes_of(q * scale, centre, rotation))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                    pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                    names=["query_id", key, "score"])

    found = indexed.unionByName(visiting).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def hyperplanes(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): codes lengthen with the rows, tables are as many as keep ``RECALL`` of the pairs at the threshold."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / 256)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _spread(pairs_x: np.ndarray, pairs_y: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n points reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs_x], label[pairs_y])
        now = label.copy()
        np.minimum.at(now, pairs_x, low)
        np.minimum.at(now, pairs_y, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def vector_links(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): vectors of one label linked at cosine >= ``threshold``.

    Equal vectors of a label are joined first and stand for each other.  Distinct ones meet where the signs against a
    table's random hyperplanes agree; each meeting pair is measured exactly, and counted only in the first table where
    it meets.  A bucket of many rows is cut into tiles, so that no task grows with it; a tile returns counts and
    one edge per row, never its pairs.  Vectors of different lengths link with nothing, as do null labels and unusable
    vectors; rows with a null key are left out; rows that repeat key, label and vector are one.  An empty table gives no row.
    """
    prepare(df.sparkSession)
    every = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v")).distinct()
    every = table(every.withColumn("ok", F.coalesce(usable("v"), F.lit(False)) & F.col("label").isNotNull()), "vectors")
    good = every.filter("ok")
    reps = table(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct")
    bits, tables = hyperplanes(reps.count(), threshold)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        normals: dict[int, np.ndarray] = {}
        for whole, size in ((b, d) for b in batches for d in np.unique(b.column("size").to_numpy()).tolist()):
            b = whole.filter(pa.array(whole.column("size").to_numpy() == size))
            if size not in normals:
                normals = {size: np.random.default_rng([11, size]).standard_normal((size, bits * tables))}
            on = (unit_scaled(matrix(b.column("v"))) @ normals[size] > 0).reshape(b.num_rows, tables, bits)
            code = (on * weight).sum(2, dtype=np.uint64).astype("<u8")
            lab = b.column("h").to_numpy().view(np.uint64)
            spot = scramble(scramble(code + lab[:, None]) + np.arange(tables, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("rep"), b.column("copies"), b.column("v"), pa.array([c.tobytes() for c in code], pa.binary()),
                                              pa.array(spot.tolist(), pa.list_(pa.int64())), b.column("size")], names=["label", "rep", "copies", "v", "codes", "spots", "size"])

    kind = dict(good.dtypes)["label"]
    # a length is a group of its own, as a label is
    coded = reps.select("label", "rep", "copies", "v", F.size("v").alias("size"), F.xxhash64("label", F.size("v")).alias("h")).mapInArrow(codes, f"label {kind}, rep bigint, copies bigint, v array<double>, codes binary, spots array<bigint>, size int")
    coded = table(coded, "codes")
    spots = coded.select("label", "size", "rep", F.posexplode("spots").alias("at", "spot"))
    crowd = spots.groupBy("label", "size", "at", "spot").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / TILE_ROWS))
    met = spots.join(crowd, ["label", "size", "at", "spot"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    tiles = met.withColumn("other", other).select(
        F.xxhash64("label", "size", "at", "spot", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "rep", "at", "part")
    rows = tiles.join(coded.select("rep", "copies", "v", "codes"), "rep")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in groups(batches, "tile"):
            rep, copies, part, at = (g.column(c).to_numpy() for c in ("rep", "copies", "part", "at"))
            x = unit_scaled(matrix(g.column("v")))
            x /= np.linalg.norm(x, axis=1)[:, None]
            code = np.frombuffer(b"".join(g.column("codes").to_pylist()), "<u8").reshape(len(rep), tables)
            near = x @ x.T >= threshold
            if part[0] != part[-1] or (part != part[0]).any():  # two parts meet: each is compared within itself elsewhere
                near &= part[:, None] != part[None, :]
            p, q = np.nonzero(np.triu(near, 1))
            if not len(p):
                continue
            met_before = (code[p, :at[0]] == code[q, :at[0]]).any(1)
            new_p, new_q = p[~met_before], q[~met_before]
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, new_p, copies[new_q])
            np.add.at(links, new_q, copies[new_p])
            root = _spread(p, q, len(rep))
            use = (links > 0) | (root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(rep[root[use]]), pa.array(links[use])], names=["a", "b", "links"])

    found = table(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(measure, "a bigint, b bigint, links bigint"), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    # copies stand in the edges too: a key repeated with other vectors joins what it links
    members = good.join(reps.select("label", "v", "rep", "copies"), ["label", "v"]).select("id", "rep", "copies")
    members = table(members, "members")
    edges = found.select("a", "b").distinct().unionAll(members.filter("id <> rep").select("id", "rep"))
    roots = components(edges)
    counted = members.join(counts, F.col("rep") == F.col("a"), "left").select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    alone = every.filter(~F.col("ok")).select("id", F.lit(0).cast("bigint").alias("links"))
    out = counted.unionByName(alone).join(roots, F.col("id") == F.col("node"), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), root.alias("component_id"), (root == F.col("id")).alias("kept"))
