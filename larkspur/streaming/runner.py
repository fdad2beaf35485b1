"""Structured Streaming jobs as repeated available-now runs over a landing folder.

Files land in batches, each run picks up what is new under one checkpoint, results go to a file sink.
Everything lives in the shared folder, so a lost executor or driver resumes from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import scratch_path
from larkspur.streaming.ordered import PROVIDER


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that processors with their own state need; a query's checkpoint remembers it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Replay:
    """Feeds parts of a table to a streaming query, one available-now run per part."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, f"stream-{label}")
        self.schema = None
        self.last = None

    def land(self, df: DataFrame) -> None:
        self.schema = df.schema
        df.write.mode("append").parquet(f"{self.root}/in")

    def source(self, files: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{self.root}/in")

    def run(self, build: Callable[[DataFrame], DataFrame]) -> None:
        """One run to the end of the landed data, appended to the file sink."""
        with keyed_state(self.spark):
            q = (build(self.source()).writeStream.format("parquet").outputMode("append")
                 .option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/check").trigger(availableNow=True).start())
            q.awaitTermination()
        self.last = q

    def run_batches(self, build: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None], files: int | None = None) -> None:
        """One run handing every micro-batch (``files`` of them at a time) to ``each``, which must be safe to repeat for a batch id."""
        q = (build(self.source(files)).writeStream.outputMode("append").foreachBatch(each)
             .option("checkpointLocation", f"{self.root}/check").trigger(availableNow=True).start())
        q.awaitTermination()
        self.last = q

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/out")
