"""State of foreachBatch jobs as tables by batch id: a batch that runs twice writes the same state twice, a new session goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener


class BatchState:
    """One folder per batch; a folder without its success marker was never finished and is written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(conf)

    def batches(self) -> list[int]:
        """Finished batches, the newest last."""
        jvm, root, files = self._files()
        if not files.exists(root):
            return []
        done = []
        for f in files.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                done.append(int(name[6:]))
        return sorted(done)

    def before(self, batch_id: int) -> DataFrame | None:
        """The state that batch ``batch_id`` starts from: that of the newest finished batch before it."""
        older = [b for b in self.batches() if b < batch_id]
        return self.spark.read.parquet(self._folder(older[-1])) if older else None

    def write(self, batch_id: int, state: DataFrame) -> None:
        """Write whole and leave a marker last; a later reader takes marked folders only."""
        state.write.mode("overwrite").parquet(self._folder(batch_id))

    def newest(self) -> DataFrame | None:
        done = self.batches()
        return self.spark.read.parquet(self._folder(done[-1])) if done else None

    def all(self) -> DataFrame | None:
        """Every finished batch's rows with their ``batch``."""
        done = self.batches()
        if not done:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*[self._folder(b) for b in done])

    def forget(self, keep: int = 2) -> None:
        """Delete the folders of all but the newest ``keep`` batches."""
        jvm, _, files = self._files()
        for b in self.batches()[:-keep]:
            files.delete(jvm.org.apache.hadoop.fs.Path(self._folder(b)), True)


def late_split(spark: SparkSession, root: str, clock: str, window: str, delay: str, count: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that counts rows in time and keeps the late ones.

    The watermark of a batch is the latest ``clock`` of all batches before it minus ``delay``, as the engine has it.  A
    row is late when its tumbling ``window`` had ended by then.  ``{root}/kept`` gets ``count`` of the window and rows
    in time, ``{root}/late`` the late rows as they came, ``{root}/clock`` the latest time seen; each by batch.
    """
    kept, late, seen = (BatchState(spark, f"{root}/{n}") for n in ("kept", "late", "clock"))

    def each(batch: DataFrame, batch_id: int) -> None:
        past = seen.before(batch_id)
        latest = past.first().latest if past is not None else None
        limit = F.lit(latest).cast("timestamp") - F.expr(f"interval {delay}") if latest is not None else F.lit(None).cast("timestamp")
        rows = batch.withColumn("_w", F.window(clock, window))
        is_late = F.coalesce(F.col("_w.end") <= limit, F.lit(False))
        late.write(batch_id, rows.filter(is_late).drop("_w"))
        kept.write(batch_id, count(rows.filter(~is_late).withColumn("start", F.col("_w.start")).drop("_w")))
        now = batch.agg(F.max(clock).cast("timestamp").alias("latest")).select(F.greatest("latest", F.lit(latest).cast("timestamp")).alias("latest"))
        seen.write(batch_id, now)

    return each


class Progress(StreamingQueryListener):
    """Sums over every batch of the queries it hears, however many: the engine's own record keeps a hundred."""

    def __init__(self):
        self.batches, self.rows, self.dropped = 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows or 0
        self.dropped += sum(s.numRowsDroppedByWatermark or 0 for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
