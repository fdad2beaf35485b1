"""Session defaults and the few cluster settings the operators read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest group one task may hold before an operator takes its split path.
GROUP_ROWS_CONF = "spark.larkspur.maxGroupRows"
GROUP_ROWS_DEFAULT = 4_000_000
BLOCK_ROWS_CONF = "spark.larkspur.blockRows"
BLOCK_ROWS_DEFAULT = 20_000

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Folders made for local sessions without the setting, by application
_LOCAL_DIRS: dict[str, str] = {}


def build_session(cores: str = "*", app: str = "larkspur", **conf) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, few shuffle partitions)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python workers unpickle functions of this package by name: they need its folder wherever the session starts
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [_ROOT, os.environ.get("PYTHONPATH")])))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def block_rows(spark: SparkSession) -> int:
    """Rows of one side of a neighbour-search block."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS_DEFAULT)))


def n_buckets(spark: SparkSession) -> int:
    """How many ordered slices a global order is cut into: one per shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session takes a temporary folder of its own; a cluster must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(spark.sparkContext.applicationId)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="larkspur-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage, plan and size estimate all begin anew.

    A checkpoint would keep the estimate of the plan it cuts, and estimates multiply over the rounds of an iteration.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables that :func:`cut` wrote for ``frames``; nothing lazy may still read them."""
    for df in frames:
        path = df.__dict__.pop("_scratch", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
