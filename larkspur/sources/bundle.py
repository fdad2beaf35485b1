"""Fitted pipelines with their threshold, calibrator and version as one folder, and batch scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def save_bundle(model: PipelineModel, path: str, version: str, threshold: float, config: dict[str, str], calibrator: PipelineModel | None = None) -> None:
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    if calibrator is not None:
        calibrator.write().overwrite().save(f"{path}/calibrator")
    row = [(version, float(threshold), config, calibrator is not None)]
    spark.createDataFrame(row, "version string, threshold double, config map<string,string>, calibrated boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineModel | None, dict]:
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    calibrator = PipelineModel.load(f"{path}/calibrator") if meta["calibrated"] else None
    return PipelineModel.load(f"{path}/model"), calibrator, meta


def decide(df: DataFrame, probability: Column, threshold: float, version: str, labels: tuple[str, str] = ("no", "yes")) -> DataFrame:
    """Probability, decision (p >= threshold), label, version and threshold columns."""
    p = df.withColumn("probability", probability)
    hit = F.col("probability") >= threshold
    return p.withColumns({"prediction": hit.cast("int"), "label": F.when(hit, labels[1]).otherwise(labels[0]), "version": F.lit(version), "threshold": F.lit(float(threshold))})


def append_log(df: DataFrame, path: str, inputs: list[str], reasons: Column, at: Column) -> None:
    """Append decisions with time, input hash and top reasons, partitioned by day."""
    log = df.select(at.alias("scored_at"), F.to_date(at).alias("day"), "version", "threshold", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in inputs]), 256).alias("input_hash"),
                    F.col("probability"), F.col("prediction"), reasons.alias("reasons"))
    log.write.mode("append").partitionBy("day").parquet(path)
