"""Clustering steps that pyspark.ml does not offer."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larkspur import session
from larkspur.session import cut, release


def assign_nearest(df: DataFrame, centres: np.ndarray, vec: str = "vec", out: str = "cluster") -> DataFrame:
    """Nearest centre per row (ties to the lower index); only the k x d centres travel."""
    c = np.asarray(centres, dtype=float)

    @F.pandas_udf("struct<cluster:int,d2:double>")
    def near(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float)
        d = np.stack([((x - m) ** 2).sum(1) for m in c], axis=1)
        k = d.argmin(1)
        return pd.DataFrame({"cluster": k.astype("int32"), "d2": d[np.arange(len(d)), k]})

    return df.withColumn("_n", near(vec)).withColumns({out: F.col("_n.cluster"), "d2": F.col("_n.d2")}).drop("_n")


def centre_means(df: DataFrame, by: str, dims: int, vec: str = "vec") -> DataFrame:
    """(by, n, mean array) with one average per dimension: a single map-side combined pass."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(vec)[i]) for i in range(dims)]).alias("mean"))


def kmeans_step(df: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """One assign + update; an empty cluster simply has no row."""
    return centre_means(assign_nearest(df, centres, vec), "cluster", np.asarray(centres).shape[1], vec)


def minibatch_kmeans(df: DataFrame, key: str, centres: np.ndarray, batches: int, vec: str = "vec") -> np.ndarray:
    """Centres moved batch by batch toward each batch's means with weight n_batch / n_seen (hash batches)."""
    c = np.array(centres, dtype=float)
    seen = np.zeros(len(c))
    marked = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(batches))).cache()
    for b in range(batches):
        for r in kmeans_step(marked.filter(F.col("_b") == b), c, vec).collect():
            seen[r.cluster] += r.n
            c[r.cluster] += (np.array(r["mean"]) - c[r.cluster]) * (r.n / seen[r.cluster])
    marked.unpersist()
    return c


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): smallest node of each connected component; nodes are those that ``edges`` name.

    Contracting rounds: every node points at its smallest neighbour, pointers jump to the end of their chain, and edges
    move to where their ends point, so what is left of a component halves at least every round.  A step is an equi join
    and a written table; the one before is deleted.  Null ends are left out.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    links = cut(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    # every node with the root it has now: loops keep nodes without another neighbour
    labels = cut(links.select(F.col("x").alias("node")).union(links.select("y")).distinct().withColumn("root", F.col("node")))
    old = links
    links = cut(links.filter("x <> y"))
    release(old)
    while links.limit(1).count():
        both = links.union(links.select("y", "x"))
        least = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("up")))
        # pointers jump until all point at a local minimum: the steps grow with the logarithm of the longest chain
        while True:
            far = least.select(F.col("x").alias("up"), F.col("up").alias("top"))
            jumped = cut(least.select("x", "up").join(far, "up").select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            release(least)
            least = jumped
            if not least.filter("moved").limit(1).count():
                break
        to = least.select(F.col("x").alias("root"), "up")
        moved = cut(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left, right = least.select("x", F.col("up").alias("ux")), least.select(F.col("x").alias("y"), F.col("up").alias("uy"))
        rest = links.join(left, "x").join(right, "y").select(F.greatest("ux", "uy").alias("x"), F.least("ux", "uy").alias("y"))
        rest = cut(rest.filter("x <> y").distinct())
        release(labels, links, least)
        labels, links = moved, rest
    release(links)
    return labels


#: Grid axes by which neighbouring cells are looked up; further axes only test the gap
_LOOKUP = 3


def _gap(a: str, b: str, side: float) -> Column:
    """Squared distance between two grid cells."""
    steps = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double") * side)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x * x)


def _around(rows: DataFrame, cells: DataFrame, side: float, eps: float, dims: int) -> DataFrame:
    """``rows`` (with ``cell``) joined to every filled cell within ``eps`` of theirs: columns of ``cells`` as they are.

    Only the first axes are looked up by equi join, so the copies of a row do not grow with the number of axes.
    """
    axes, reach = min(dims, _LOOKUP), math.ceil(math.sqrt(dims))
    steps = [s for s in itertools.product(range(-reach, reach + 1), repeat=axes) if sum((max(abs(x) - 1, 0) * side) ** 2 for x in s) <= eps * eps * (1 + 1e-9)]
    near = F.array(*[F.array(*[F.col("cell")[i] + F.lit(x).cast("bigint") for i, x in enumerate(s)]) for s in steps])
    asked = rows.withColumn("spot", F.explode(near))
    held = cells.withColumn("spot", F.slice("other", F.lit(1), F.lit(axes)))
    return asked.join(held, "spot").drop("spot").filter(_gap("cell", "other", side) <= eps * eps * (1 + 1e-9))


def _within(queries: DataFrame, base: DataFrame, side: float, eps: float, dims: int, block_rows: int) -> DataFrame:
    """(id, other, hits): points of each neighbouring cell within ``eps`` of a query, per block of the cell.

    A cell with more than ``block_rows`` points is many blocks, each a group of its own that the queries visit.
    """
    sizes = base.groupBy(F.col("cell").alias("other")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    asked = _around(queries.select("id", "vec", "cell"), sizes, side, eps, dims)
    asked = asked.select("id", "vec", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    # new names throughout: both sides of the cogroup may come from one table
    held = base.select(F.col("vec").alias("point"), F.col("cell").alias("at"), F.xxhash64("id").alias("h")).join(sizes.select(F.col("other").alias("at"), F.col("blocks").alias("of")), "at")
    held = held.select("point", F.col("at").alias("spot"), F.pmod("h", "of").alias("part"))

    def count(asking: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(asking), np.int64)
        if len(asking) and len(points):
            q, b = np.stack(asking["vec"].to_numpy()), np.stack(points["point"].to_numpy())
            step = max(1, 2_000_000 // len(b))
            for lo in range(0, len(q), step):
                n[lo:lo + step] = (_distance(q[lo:lo + step], b) <= eps).sum(1)
        hit = n > 0
        return pd.DataFrame({"id": asking["id"].to_numpy()[hit], "other": asking["other"].to_numpy()[hit], "hits": n[hit]})

    kind = queries.schema["id"].dataType.simpleString()
    return asked.groupBy("other", "block").cogroup(held.groupBy("spot", "part")).applyInPandas(count, f"id {kind}, other array<bigint>, hits bigint")


def _distance(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(q), len(b)))
    for j in range(q.shape[1]):
        d2 += (q[:, j:j + 1] - b[:, j]) ** 2
    return np.sqrt(d2)


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Is a point of ``a`` within ``eps`` of one of ``b``?  Both are walked along the first axis; only a strip is compared."""
    a, b = a[np.argsort(a[:, 0])], b[np.argsort(b[:, 0])]
    for lo in range(0, len(a), 256):
        part = a[lo:lo + 256]
        strip = b[np.searchsorted(b[:, 0], part[0, 0] - eps * (1 + 1e-9)):np.searchsorted(b[:, 0], part[-1, 0] + eps * (1 + 1e-9), side="right")]
        for at in range(0, len(strip), 8192):
            if (_distance(part, strip[at:at + 8192]) <= eps).any():
                return True
    return False


def _cell_links(core: DataFrame, side: float, eps: float, dims: int, block_rows: int) -> DataFrame:
    """Stored (cell, root): cells of core points and the smallest cell each is connected with.

    Core points of one cell are one cluster, so only pairs of cells are linked.  First the outermost points of each cell
    are compared, which settles nearly every pair.  Pairs that stay apart although their components differ are settled
    by all points near the other cell's box, in blocks.
    """
    tips = [F.min_by("vec", F.col("vec")[i]) for i in range(dims)] + [F.max_by("vec", F.col("vec")[i]) for i in range(dims)]
    box = [F.array(*[F.min(F.col("vec")[i]) for i in range(dims)]).alias("low"), F.array(*[F.max(F.col("vec")[i]) for i in range(dims)]).alias("high")]
    cells = cut(core.groupBy("cell").agg(F.array_distinct(F.array(*tips)).alias("tips"), *box, F.count(F.lit(1)).alias("n")))
    other = cells.select(F.col("cell").alias("other"), F.col("tips").alias("other_tips"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = _around(cells, other, side, eps, dims).filter(F.col("cell") < F.col("other"))
    apart = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.greatest(
        F.get("low", i) - F.get("other_high", i), F.get("other_low", i) - F.get("high", i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    pairs = pairs.filter(apart <= eps * eps * (1 + 1e-9))

    @F.pandas_udf("boolean")
    def tips_touch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool((_distance(np.stack(p), np.stack(q)) <= eps).any()) for p, q in zip(x, y)], dtype=bool)

    pairs = cut(pairs.select("cell", "other", tips_touch("tips", "other_tips").alias("linked"), "low", "high", "other_low", "other_high"))
    own = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    roots = components(pairs.filter("linked").select(F.col("cell").alias("a"), F.col("other").alias("b")).union(own))
    left, right = roots.select(F.col("node").alias("cell"), F.col("root").alias("ra")), roots.select(F.col("node").alias("other"), F.col("root").alias("rb"))
    open_ = cut(pairs.filter("not linked").join(left, "cell").join(right, "other").filter("ra <> rb")
                .select("cell", "other", "low", "high", "other_low", "other_high"))
    if open_.limit(1).count():
        def beside(this: str, low: str, high: str) -> DataFrame:
            gap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.greatest(
                F.get(low, i) - F.get("vec", i), F.get("vec", i) - F.get(high, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
            joined = core.select(F.col("cell").alias(this), "vec", "id").join(open_, this).filter(gap <= eps * eps * (1 + 1e-9))
            return joined.select("cell", "other", "vec", "id")

        a, b = cut(beside("cell", "other_low", "other_high")), cut(beside("other", "low", "high"))
        blocks = a.groupBy("cell", "other").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("na")).join(
            b.groupBy("cell", "other").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("nb")), ["cell", "other"])
        zero = F.lit(0).cast("bigint")
        a = a.join(blocks, ["cell", "other"]).select("cell", "other", "vec", F.pmod(F.xxhash64("id"), F.col("na")).alias("ba"), F.explode(F.sequence(zero, F.col("nb") - 1)).alias("bb"))
        b = b.join(blocks, ["cell", "other"]).select("cell", "other", "vec", F.explode(F.sequence(zero, F.col("na") - 1)).alias("ba"), F.pmod(F.xxhash64("id"), F.col("nb")).alias("bb"))
        keys = ["cell", "other", "ba", "bb"]

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if len(x) and len(y) and _touch(np.stack(x["vec"].to_numpy()), np.stack(y["vec"].to_numpy()), eps):
                return x[["cell", "other"]].head(1).rename(columns={"cell": "a", "other": "b"})
            return pd.DataFrame({"a": [], "b": []})

        more = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(meet, "a array<bigint>, b array<bigint>")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return roots.select(F.col("node").alias("cell"), "root")


def dbscan(df: DataFrame, key: str, vec: str, eps: float, min_pts: int, dims: int, block_rows: int | None = None) -> DataFrame:
    """(key, cluster, is_core): density clusters, noise -1; a border point joins the smallest cluster in reach.

    A graph of grid cells of diagonal ``eps``.  A cell with ``min_pts`` points is all core and one cluster.  Points of
    thinner cells (fewer than ``min_pts`` each) count their neighbours in the cells around, so the distances measured
    grow with rows times ``min_pts``, not with the square of a crowded cell.  Cells are then linked pair by pair and
    their components are the clusters.  Rows with a null vector are noise; a null key stays a row of its own only if
    keys are otherwise unique.  An empty table gives no row.
    """
    block_rows = block_rows or session.block_rows(df.sparkSession)
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    pts = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    blank = pts.filter("vec is null").select("id", F.lit(-1).cast(pts.schema["id"].dataType).alias("cluster"), F.lit(False).alias("is_core"))
    pts = pts.filter("vec is not null").withColumn("cell", F.array(*[F.floor(F.col("vec")[i] / side).cast("bigint") for i in range(dims)]))
    pts = cut(pts)
    crowd = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    pts = cut(pts.join(crowd, "cell").select("id", "vec", "cell", (F.col("n") >= min_pts).alias("dense")))
    thin = pts.filter("not dense")
    reach = _within(thin, pts, side, eps, dims, block_rows).groupBy("id").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= min_pts).select("id")
    marked = cut(pts.join(reach.withColumn("near", F.lit(True)), "id", "left").select("id", "vec", "cell", (F.col("dense") | F.coalesce("near", F.lit(False))).alias("is_core")))
    core = marked.filter("is_core")
    roots = cut(_cell_links(core, side, eps, dims, block_rows))
    firsts = core.groupBy("cell").agg(F.min("id").alias("first")).join(roots, "cell")
    named = firsts.groupBy("root").agg(F.min("first").alias("cluster"))
    named = cut(roots.join(named, "root").select("cell", "cluster"))
    inner = core.join(named, "cell").select("id", "cluster", "is_core")
    rest = marked.filter("not is_core")
    touched = _within(rest, core, side, eps, dims, block_rows).join(named.withColumnRenamed("cell", "other"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    outer = rest.select("id").join(touched, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast(pts.schema["id"].dataType)).alias("cluster"), F.lit(False).alias("is_core"))
    return inner.unionByName(outer).unionByName(blank).withColumnRenamed("id", key)
