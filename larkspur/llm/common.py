"""What the training-data operators share: scratch tables, Arrow streams by group, positions in a global order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.session import scratch_path, shared_dir

#: Rows in one Arrow batch: whole texts and packed blocks make wide rows, so batches stay small.
BATCH_ROWS = 512

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Set what the operators rely on: a shared folder for cut lineage and small Arrow batches."""
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither recompute nor reorder it."""
    path = scratch_path(df.sparkSession, label)
    for made in _MADE:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lists that take the paths of the tables now being written; see :func:`tables_into`
_MADE: list[list[str]] = []


@contextmanager
def tables_into(paths: list[str]):
    """Add the paths of all tables written inside the block to ``paths``."""
    _MADE.append(paths)
    try:
        yield
    finally:
        _MADE.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by path and empty the list; no frame that still has to run may read them."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while paths:
        target = jvm.org.apache.hadoop.fs.Path(paths.pop())
        target.getFileSystem(conf).delete(target, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Whole groups of an Arrow stream sorted by the integer column ``key``; one group is held at a time."""
    open_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
            if held and k[a] != open_key:
                yield open_key, pa.Table.from_batches(held)
                held = []
            open_key = int(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield open_key, pa.Table.from_batches(held)


def ordered(df: DataFrame, order: Sequence[Column | str], value: str | None = None, label: str = "ordered") -> DataFrame:
    """Add ``before``: the sum of the long column ``value`` (or the row count) of all rows earlier in the global order.

    The order must be total.  Rows are cut into ranges, written once, and each range is summed on its own;
    only one total per range meets in a single task, so no key and no source can make a task large.
    """
    spark = df.sparkSession
    cols = df.columns
    amount = F.col(value).cast("long") if value else F.lit(1).cast("long")
    ranged = table(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), label)
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: the broadcast is bounded by the number of shuffle partitions
    return ranged.join(F.broadcast(offsets), "_range").select(
        *cols, (F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).alias("before"))


def unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a string; SQL twin: ``('0x' || substr(md5(x), 1, 8))::BIGINT / 4294967296.0``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
