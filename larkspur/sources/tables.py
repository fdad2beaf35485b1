"""Table reader: parquet with known names, NaN read as NULL, columns pruned by Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers arrive as NaN from pandas-made files; every operator here expects NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


#: Tables whose rows cost much to process (long texts, vectors)
HEAVY = {"documents", "pages", "conversations", "embeddings"}


class Tables:
    """Lazy access to the parquet tables of one folder: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        # texts and vectors are heavy per row: a table of fewer files than cores would be one task
        slots = self.spark.sparkContext.defaultParallelism
        if name in HEAVY and len(df.inputFiles()) < slots:
            df = df.repartition(slots, df.columns[0])
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over named frames: ``t.sql("SELECT .. FROM {e}", e=t.events)``."""
        return self.spark.sql(text, **frames)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with a fixed schema; a cell that does not parse becomes NULL instead of failing the job."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("header", header).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Partitioned write; the partition columns also decide the shuffle so each folder gets few files."""
    out = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(16))) if partition_by else df
    writer = out.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
