"""The library's stages inside a Pipeline: fitted rows only, saved and loaded elsewhere, refitted per fold."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from larkspur.models.estimators import FrequencyEncoder, GroupImputer, QuantileCapper, TargetEncoder, TextBayes

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 11 = 0 THEN NULL ELSE substr('abcd', 1 + int(id % 4), 1) END AS c", "CASE WHEN id % 7 = 0 THEN NULL ELSE double((id * 37) % 101) END AS x",
        "double((id * 37) % 101 > 50) AS label", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('word', id % 5, ' other', id % 3) END AS text", "double(id % 5 > 2) AS tag")
    return r.cache()


def stages():
    return [GroupImputer(inputCols=["x"], outputCols=["x_full"], groupCols=["c"], strategy="median"), QuantileCapper(inputCols=["x_full"], outputCols=["x_capped"], lower=.05, upper=.95),
            FrequencyEncoder(inputCols=["c"], outputCols=["c_share"]), TargetEncoder(inputCols=["c"], outputCols=["c_mean"], smoothing=5.0),
            TextBayes(textCol="text", labelCol="tag", predictionCol="tag_pred", probabilityCol="tag_prob", rawPredictionCol="tag_raw"),
            VectorAssembler(inputCols=["x_capped", "c_share", "c_mean", "tag_pred"], outputCol="features"), LogisticRegression(maxIter=10)]


SHOWN = ["x_full", "x_capped", "c_share", "c_mean", "tag_pred", "prediction"]


def test_one_pipeline_saved_and_loaded_in_another_session(spark, rows, tmp_path):
    model = Pipeline(stages=stages()).fit(rows.filter("id % 5 <> 0"))
    path, data = str(tmp_path / "model"), str(tmp_path / "rows")
    model.write().overwrite().save(path)
    rows.write.parquet(data)
    Pipeline(stages=stages()).write().overwrite().save(str(tmp_path / "unfitted"))
    assert len(Pipeline.load(str(tmp_path / "unfitted")).getStages()) == 7
    want = sorted(map(str, model.transform(rows).select("id", *SHOWN).collect()))
    assert len(want) == 400
    here = sorted(map(str, PipelineModel.load(path).transform(rows).select("id", *SHOWN).collect()))
    assert here == want
    script = f"""
from larkspur.session import build_session
from pyspark.ml import PipelineModel
spark = build_session("2", "second")
rows = PipelineModel.load({path!r}).transform(spark.read.parquet({data!r})).select("id", *{SHOWN!r}).collect()
print("\\n".join(sorted(map(str, rows))))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=ROOT, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    assert out.stdout.split("\n")[:-1] == want, out.stderr[-2000:]


def test_held_out_labels_change_nothing(rows):
    flipped = rows.withColumn("label", F.when(F.col("id") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("tag", F.when(F.col("id") % 5 == 0, 1 - F.col("tag")).otherwise(F.col("tag")))
    a, b = (Pipeline(stages=stages()).fit(r.filter("id % 5 <> 0")).transform(r).select("id", *SHOWN).orderBy("id").collect() for r in (rows, flipped))
    assert a == b


def test_cross_validation_refits_every_stage(rows):
    ps = stages()
    grid = ParamGridBuilder().addGrid(ps[3].smoothing, [0.0, 50.0]).build()
    cv = CrossValidator(estimator=Pipeline(stages=ps), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=3).fit(rows)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > .95
    bayes = TextBayes(labelCol="tag")
    best = CrossValidator(estimator=bayes, estimatorParamMaps=ParamGridBuilder().addGrid(bayes.modelType, ["multinomial", "complement"]).build(),
                          evaluator=MulticlassClassificationEvaluator(labelCol="tag", metricName="accuracy"), numFolds=2, seed=3).fit(rows)
    assert min(best.avgMetrics) > .8


def test_values_against_plain_python(rows):
    train = [r for r in rows.collect() if r.id % 5]
    model = Pipeline(stages=stages()[:4]).fit(rows.filter("id % 5 <> 0"))
    prior = sum(r.label for r in train) / len(train)
    for r in model.transform(rows).collect():
        own = [q for q in train if q.c == r.c and r.c is not None]
        assert r.c_share == pytest.approx(len(own) / len(train))
        assert r.c_mean == pytest.approx((sum(q.label for q in own) + 5 * prior) / (len(own) + 5))
        same = sorted(q.x for q in train if q.c == r.c and q.x is not None)
        middle = (same[(len(same) - 1) // 2] + same[len(same) // 2]) / 2
        assert r.x_full == pytest.approx(middle if r.x is None else r.x)
    empty = Pipeline(stages=stages()[:4]).fit(rows).transform(rows.limit(0))
    assert empty.count() == 0


def test_top_terms_and_texts_without_words(spark):
    rows = spark.createDataFrame([(i, "spam offer now" if i % 2 else "kind letter now", float(i % 2)) for i in range(8)] + [(8, None, None), (9, "", 1.0)], "id int, text string, label double")
    model = TextBayes(grams=1, minDocs=2).fit(rows)
    top = {(r.cls, r["rank"]): r.term for r in model.top_terms(2).collect()}
    assert top == {(0.0, 1): "kind", (0.0, 2): "letter", (1.0, 1): "now", (1.0, 2): "offer"}
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert [got[i] for i in range(10)] == [0.0, 1.0] * 4 + [1.0, 1.0]
