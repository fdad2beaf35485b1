"""Thin helpers around pyspark.ml: vectors, probabilities, fold loops, metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import mix_hash


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> list:
    """Numeric branch (scaled) and categorical branch (one-hot, unseen kept) into ``features``."""
    stages, parts = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"))
        parts.append("_num")
        if scale:
            stages.append(StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True))
            parts = ["_scaled"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", dropLast=False)]
        parts.append(f"_o_{c}")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def assembled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True, train: Column | None = None) -> DataFrame:
    """Feature stages fitted on the ``train`` rows (all rows where none is given) and applied to every row; helper vectors dropped."""
    made = Pipeline(stages=feature_stages(numeric, categorical, scale)).fit(df if train is None else df.filter(train)).transform(df)
    return made.drop(*[c for c in made.columns if c.startswith("_")])


def p1(c: str = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col(c))[1]


def with_fold(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.floor(mix_hash(key, 11) * k).cast("int"))


def out_of_fold(df: DataFrame, make, key: str, pick: Column, name: str, k: int = 3) -> DataFrame:
    """(key, name): each fold predicted by a model fitted on the other folds."""
    folded = with_fold(df, key, k, "_fold").cache()
    out = None
    for i in range(k):
        part = make().fit(folded.filter(F.col("_fold") != i)).transform(folded.filter(F.col("_fold") == i)).select(key, pick.alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def rows(spark, data: list[tuple], schema: str) -> DataFrame:
    """Small result table (one row per model, step or parameter)."""
    return spark.createDataFrame(data, schema)
