"""Approximate nearest neighbours by inverted lists under a coarse quantiser.

The centres are learned from a bounded sample; every row is then put into the list of its nearest centre.  A query
opens only the lists of its nearest centres and measures their rows exactly, so its cost follows the rows in the opened
lists and not the table.  A list with many rows is cut into blocks that are searched apart, so no list makes a task
large.  How many lists a query opens is learned on the sample too, for the recall that is asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from larkspur import session
from larkspur.session import cut

#: Rows the fit may read on the driver, and most centres: 4,096 centres of 1,000 numbers are 33 MB in every task
SAMPLE_ROWS, MOST_CENTRES, TRIAL_QUERIES = 20_000, 4096, 256


def _squares(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * q @ b.T


def _lloyd(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class InvertedLists:
    """``lists``: stored (id, vec, list, block); ``blocks``: blocks of each list; ``probes``: lists a query opens."""

    centres: np.ndarray
    lists: DataFrame
    blocks: DataFrame
    probes: int

    def search(self, queries: DataFrame, key: str, k: int, vec: str = "vec", not_self: bool = True, probes: int | None = None) -> DataFrame:
        """(qid, rank, bid, dist): the ``k`` nearest rows found, nearest first, ties to the smaller id.

        Null vectors ask for nothing; an empty index answers nothing.
        """
        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], "qid bigint, rank int, bid bigint, dist double")
        asked = self._opened(queries, key, vec, probes).join(self.blocks.select(F.col("list").alias("of"), "n_blocks"), "of")
        asked = asked.select("qid", "qvec", "of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("part"))
        # queries that meet a block are dealt out as well: a popular list is no large task
        ways = F.lit(max(1, session.n_buckets(queries.sparkSession)))
        few = session.block_rows(queries.sparkSession)
        crowd = asked.groupBy("of", "part").agg(F.least(ways, F.ceil(F.count(F.lit(1)) / few)).alias("ways"))
        asked = asked.join(crowd, ["of", "part"]).withColumn("way", F.pmod(F.xxhash64("qid"), F.col("ways")))
        base = self.lists.join(crowd.select(F.col("of").alias("list"), F.col("part").alias("block"), "ways"), ["list", "block"])
        base = base.select("id", "vec", "list", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("slot"))

        def measure(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "bid": np.zeros(0, np.int64), "dist": np.zeros(0)})
            if not len(qs) or not len(bs):
                return empty
            b, bid = np.stack(bs["vec"].to_numpy()), bs["id"].to_numpy()
            out, step = [empty], max(1, 2_000_000 // len(b))
            for lo in range(0, len(qs), step):
                part = qs.iloc[lo:lo + step]
                q, qid = np.stack(part["qvec"].to_numpy()), part["qid"].to_numpy()
                d = _squares(q, b)
                if not_self:
                    d[qid[:, None] == bid] = np.inf
                kth = np.partition(d, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                slack = 1e-9 * ((b * b).sum(1).max() + (q * q).sum(1))
                rows, cols = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
                exact = np.sqrt(((q[rows] - b[cols]) ** 2).sum(1))
                order = np.lexsort((bid[cols], exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                out.append(pd.DataFrame({"qid": qid[rows[keep]], "bid": bid[cols[keep]], "dist": exact[keep]}))
            return pd.concat(out, ignore_index=True)

        hits = asked.groupBy("of", "part", "way").cogroup(base.groupBy("list", "block", "slot")).applyInPandas(measure, "qid bigint, bid bigint, dist double")
        # at most k rows for each block that a query met
        best = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "bid"))).filter(F.col("rank") <= k)
        return best.select("qid", "rank", "bid", "dist")

    def _opened(self, queries: DataFrame, key: str, vec: str, probes: int | None) -> DataFrame:
        """(qid, qvec, of): one row for each list that a query opens."""
        centres, open_ = self.centres, min(probes or self.probes, len(self.centres))

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            d = _squares(np.stack(v.to_numpy()).astype(float), centres)
            return pd.Series(list(np.argpartition(d, open_ - 1, axis=1)[:, :open_].astype("int32")))

        asked = queries.filter(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("qid"), F.col(vec).cast("array<double>").alias("qvec"))
        return asked.withColumn("of", F.explode(nearest("qvec")))

    def candidates(self, queries: DataFrame, key: str, vec: str = "vec", probes: int | None = None) -> DataFrame:
        """(qid, candidates): rows in the lists that a query opens."""
        sizes = self.lists.groupBy(F.col("list").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        return self._opened(queries, key, vec, probes).join(sizes, "of").groupBy("qid").agg(F.sum("n").alias("candidates"))


def build_lists(df: DataFrame, key: str, vec: str = "vec", recall: float = 0.95, k: int = 10, sample_rows: int = SAMPLE_ROWS) -> InvertedLists:
    """Put every row of ``df`` with a vector into a list.

    The centres and the number of lists to open are learned from at most ``sample_rows`` rows drawn by a hash of the
    key: of the sample's own neighbours, found exactly, at least ``recall`` must lie in the opened lists.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("lists")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(int(1.2 * sample_rows)).select("vec")
    x = np.array([r.vec for r in drawn.collect()], float)
    if not len(x):
        return InvertedLists(np.zeros((0, 0)), spark.createDataFrame([], "id bigint, vec array<double>, list int, block bigint"), spark.createDataFrame([], "list int, n_blocks bigint"), 0)
    centres = _lloyd(x, min(MOST_CENTRES, max(1, round(math.sqrt(min(n, len(x)))))))
    probes = _probes(x, centres, recall, k)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.stack(v.to_numpy()), centres).argmin(1).astype("int32"))

    listed = cut(rows.withColumn("list", home("vec")))
    limit = session.block_rows(spark)
    blocks = cut(listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / limit).alias("n_blocks")))
    lists = cut(listed.join(blocks, "list").select("id", "vec", "list", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block")))
    return InvertedLists(centres, lists, blocks, probes)


def _probes(x: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    """Fewest lists that hold ``recall`` of the true neighbours of queries drawn from the sample."""
    rng = np.random.default_rng(11)
    at = rng.choice(len(x), min(TRIAL_QUERIES, len(x)), replace=False)
    d = _squares(x[at], x)
    d[np.arange(len(at)), at] = np.inf
    near = np.argsort(d, axis=1)[:, :min(k, max(1, len(x) - 1))]
    home = _squares(x, centres).argmin(1)
    place = np.empty((len(at), len(centres)), int)
    np.put_along_axis(place, np.argsort(_squares(x[at], centres), axis=1), np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1
