"""The library's own stages in Pipelines: fitted on train rows, saved, loaded and applied."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from larkspur.functions.scalar import rnd
from larkspur.models import gram
from larkspur.models.estimators import FrequencyEncoder, GroupImputer, QuantileCapper, TargetEncoder, TextBayes
from larkspur.plans.learning import _NB
from larkspur.plans.registry import query, r6
from larkspur.plans.views import view
from larkspur.session import scratch_path


@query("assemble_pipeline", f"""WITH g AS (SELECT *, CAST((event_id * 7) % 13 > 6 AS DOUBLE) AS y, event_id % 5 <> 0 AS tr FROM v_gap), m AS (SELECT event_type, avg(value) AS m FROM g WHERE tr GROUP BY 1), o AS (SELECT avg(value) AS o FROM g WHERE tr),
    f AS (SELECT g.*, coalesce(value, m, o) AS full_value FROM g LEFT JOIN m USING (event_type), o), q AS (SELECT quantile_cont(full_value, .05) AS lo, quantile_cont(full_value, .95) AS hi FROM f WHERE tr),
    s AS (SELECT user_id, count(*) / (SELECT count(*) FROM g WHERE tr) AS share FROM g WHERE tr GROUP BY 1), p AS (SELECT avg(y) AS p FROM g WHERE tr),
    e AS (SELECT event_type, (sum(y) + 10 * max(p)) / (count(*) + 10) AS code FROM g, p WHERE tr GROUP BY 1)
    SELECT event_id, {r6('full_value')} AS full_value, {r6('least(greatest(full_value, lo), hi)')} AS capped, {r6('coalesce(share, 0)', 8)} AS user_share, {r6('coalesce(code, p)')} AS type_code
    FROM f LEFT JOIN s USING (user_id) LEFT JOIN e USING (event_type), q, p""")
def assemble_pipeline(t):
    """Imputer, caps and encoders fitted on four of five rows, saved, loaded again and applied to all."""
    g = view(t, "v_gap").withColumn("y", ((F.col("event_id") * 7) % 13 > 6).cast("double"))
    stages = [GroupImputer(inputCols=["value"], outputCols=["full_value"], groupCols=["event_type"]), QuantileCapper(inputCols=["full_value"], outputCols=["capped"], lower=.05, upper=.95),
              FrequencyEncoder(inputCols=["user_id"], outputCols=["user_share"]), TargetEncoder(inputCols=["event_type"], outputCols=["type_code"], labelCol="y")]
    path = scratch_path(t.spark, "pipeline")
    Pipeline(stages=stages).fit(g.filter("event_id % 5 <> 0")).write().save(path)
    out = PipelineModel.load(path).transform(g)
    return out.select("event_id", rnd("full_value").alias("full_value"), rnd("capped").alias("capped"), rnd("user_share", 8).alias("user_share"), rnd("type_code").alias("type_code"))


@query("class_terms", f"""WITH {_NB}, w AS (SELECT cls, term, ln((n + 1) / (sum(n) OVER (PARTITION BY cls) + count(*) OVER (PARTITION BY cls))) AS w FROM fu)
    SELECT CAST(cls AS DOUBLE) AS cls, CAST(rn AS INT) AS rank, term, {r6('w')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(w, 9) DESC, term) AS rn FROM w) WHERE rn <= 20""")
def class_terms(t):
    """The 20 terms of the largest log probability per class."""
    model = TextBayes(textCol="text", labelCol="y").fit(view(t, "v_text").filter("doc_id % 5 <> 0"))
    return model.top_terms(20).select("cls", "rank", "term", rnd("w").alias("weight"))


PENALTIES = (0.001, 0.1, 1.0, 10.0)


@query("ridge_path", f"""WITH r AS (SELECT x1, x2, y, l_orderkey % 5 AS f FROM v_reg), k AS (SELECT unnest(range(0, 5)) AS f), l AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PENALTIES)}]) AS lam),
    m AS (SELECT k.f, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS c, covar_pop(x1, y) / stddev_pop(x1) AS a, covar_pop(x2, y) / stddev_pop(x2) AS b FROM k JOIN r ON r.f <> k.f GROUP BY 1),
    w AS (SELECT *, (a * (1 + lam) - c * b) / ((1 + lam) * (1 + lam) - c * c) / s1 AS w1, (b * (1 + lam) - c * a) / ((1 + lam) * (1 + lam) - c * c) / s2 AS w2 FROM m, l)
    SELECT lam AS penalty, {r6('sqrt(avg((y - my - w1 * (x1 - m1) - w2 * (x2 - m2)) ^ 2))', 2)} AS rmse FROM r JOIN w USING (f) GROUP BY 1""")
def ridge_path(t):
    """The whole penalty path over five folds from one job: a fold's fit is the total's matrix less its own."""
    r = view(t, "v_reg").select("x1", "x2", "y", (F.col("l_orderkey") % 5).alias("f"))
    path = gram.ridge_path(gram.fold_grams(r, ["x1", "x2"], "y", ["f"]), PENALTIES)
    return t.spark.createDataFrame(path, "penalty double, rmse double").select("penalty", rnd("rmse", 2).alias("rmse"))
