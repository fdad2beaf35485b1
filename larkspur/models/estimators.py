"""The library's encoders, imputers, caps and text Bayes as ``pyspark.ml`` stages.

They sit in a ``Pipeline`` beside Spark's own stages, are refitted per fold by ``CrossValidator``, and are saved and loaded
with it.  What a fit learns is a table, never a driver object: it is written to the shared folder, joined when the
model is applied, and copied into the model's folder when it is saved.  Fitting reads the rows it is given and no others.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.text import each, run_counts, with_terms
from larkspur.models import bayes
from larkspur.operators.prefix import exact_quantiles
from larkspur.session import cut


class _StateWriter(MLWriter):
    """Params as metadata, the learned table as Parquet beside them."""

    def __init__(self, instance: StateModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.state.write.mode("overwrite").parquet(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StateModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.state = self.sparkSession.read.parquet(f"{path}/state")
        return model


class StateModel(Model, MLReadable, MLWritable):
    """A fitted stage whose learned values are the DataFrame ``state``."""

    state: DataFrame

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class StateEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``learn`` returns the state; the model takes over the params and the stored state."""

    model_class: type

    def learn(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> StateModel:
        model = self._copyValues(self.model_class())
        model._resetUid(self.uid)
        model.state = cut(self.learn(dataset))
        return model


def _cells(cols: list[str], *more: Column) -> Column:
    """One struct (feature, level, ..) per input column; levels are compared as strings."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"), *more) for c in cols]))


def _lookup(df: DataFrame, state: DataFrame, c: str, out: str, value: str, otherwise: Column) -> DataFrame:
    """Join one feature's levels; a level without a row gets ``otherwise``.  A hot level is split by the skew join."""
    own = state.filter(F.col("feature") == c).select(F.col("level").alias("_level"), F.col(value).alias("_value"))
    joined = df.join(own, F.col(c).cast("string") == F.col("_level"), "left")
    return joined.withColumn(out, F.coalesce("_value", otherwise)).drop("_level", "_value")


# ---- categories ----------------------------------------------------------------------------------

class _TargetParams(HasInputCols, HasOutputCols, HasLabelCol):
    smoothing = Param(Params._dummy(), "smoothing", "rows of prior that a level's own mean is weighed against", TypeConverters.toFloat)
    form = Param(Params._dummy(), "form", "m: n / (n + smoothing); sigmoid: 1 / (1 + exp(smoothing - n))", TypeConverters.toString)


class TargetEncoderModel(StateModel, _TargetParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for c, name in zip(self.getInputCols(), self.getOutputCols()):
            prior = self.state.filter((F.col("feature") == c) & F.col("level").isNull()).agg(F.max("code")).scalar()
            out = _lookup(out, self.state.filter("level is not null"), c, name, "code", prior)
        return out


class TargetEncoder(StateEstimator, _TargetParams):
    """Smoothed mean of the label per level; null and unseen levels get the mean of all rows.  Rows without a label teach nothing."""

    model_class = TargetEncoderModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, labelCol="label", smoothing=10.0, form="m"):
        super().__init__()
        self._setDefault(labelCol="label", smoothing=10.0, form="m")
        self._set(**self._input_kwargs)

    def learn(self, dataset: DataFrame) -> DataFrame:
        y = F.col(self.getLabelCol()).cast("double")
        rows = dataset.select(*[F.col(c).cast("string").alias(c) for c in self.getInputCols()], y.alias("_y")).filter("_y is not null")
        sums = rows.select(_cells(self.getInputCols(), F.col("_y").alias("y"))).groupBy("feature", "level").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
        whole = sums.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("prior"))
        n, a = F.col("n").cast("double"), F.lit(self.getOrDefault(self.smoothing))
        w = n / (n + a) if self.getOrDefault(self.form) == "m" else 1 / (1 + F.exp(a - n))
        own = sums.filter("level is not null").join(whole, "feature").select("feature", "level", (w * F.col("s") / n + (1 - w) * F.col("prior")).alias("code"))
        return own.unionByName(whole.select("feature", F.lit(None).cast("string").alias("level"), F.col("prior").alias("code")))


class FrequencyEncoderModel(StateModel, HasInputCols, HasOutputCols):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for c, name in zip(self.getInputCols(), self.getOutputCols()):
            out = _lookup(out, self.state, c, name, "share", F.lit(0.0))
        return out


class FrequencyEncoder(StateEstimator, HasInputCols, HasOutputCols):
    """Share of the level among the fitted rows; null and unseen levels get 0."""

    model_class = FrequencyEncoderModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def learn(self, dataset: DataFrame) -> DataFrame:
        counts = dataset.select(_cells(self.getInputCols())).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
        total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        return counts.filter("level is not null").join(total, "feature").select("feature", "level", (F.col("n") / F.col("total")).alias("share"))


# ---- numbers -------------------------------------------------------------------------------------

class _CapParams(HasInputCols, HasOutputCols):
    lower = Param(Params._dummy(), "lower", "quantile below which values are raised to it", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "quantile above which values are lowered to it", TypeConverters.toFloat)


class QuantileCapperModel(StateModel, _CapParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for c, name in zip(self.getInputCols(), self.getOutputCols()):
            bounds = self.state.filter(F.col("feature") == c).agg(F.struct(F.max("low").alias("low"), F.max("high").alias("high")).alias("b")).scalar()
            out = out.withColumn("_b", bounds)
            # least and greatest skip nulls: a null value has to stay one
            out = out.withColumn(name, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col("_b.low")), F.col("_b.high")))).drop("_b")
        return out


class QuantileCapper(StateEstimator, _CapParams):
    """Values outside the two exact, interpolated quantiles of the fitted rows are moved to them; nulls stay."""

    model_class = QuantileCapperModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.01, upper=0.99):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def learn(self, dataset: DataFrame) -> DataFrame:
        long = dataset.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in self.getInputCols()])))
        return exact_quantiles(long, "v", {"low": self.getOrDefault(self.lower), "high": self.getOrDefault(self.upper)}, ["feature"])


class _ImputeParams(HasInputCols, HasOutputCols):
    groupCols = Param(Params._dummy(), "groupCols", "columns whose values make a group", TypeConverters.toListString)
    strategy = Param(Params._dummy(), "strategy", "mean or median", TypeConverters.toString)


def _group(cols: list[str]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols])) if cols else F.lit("[]")


class GroupImputerModel(StateModel, _ImputeParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_group", _group(self.getOrDefault(self.groupCols)))
        for c, name in zip(self.getInputCols(), self.getOutputCols()):
            own = self.state.filter((F.col("feature") == c) & F.col("grp").isNotNull()).select(F.col("grp").alias("_grp"), F.col("value").alias("_own"))
            whole = self.state.filter((F.col("feature") == c) & F.col("grp").isNull()).agg(F.max("value")).scalar()
            out = out.join(own, F.col("_group") == F.col("_grp"), "left").withColumn(name, F.coalesce(F.col(c).cast("double"), "_own", whole)).drop("_grp", "_own")
        return out.drop("_group")


class GroupImputer(StateEstimator, _ImputeParams):
    """Nulls get the mean or exact median of their group, and that of all rows where the group has no value; a null group is one."""

    model_class = GroupImputerModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, groupCols=(), strategy="mean"):
        super().__init__()
        self._setDefault(groupCols=[], strategy="mean")
        self._set(**{k: list(v) if k == "groupCols" else v for k, v in self._input_kwargs.items()})

    def learn(self, dataset: DataFrame) -> DataFrame:
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in self.getInputCols()]))
        long = dataset.select(_group(self.getOrDefault(self.groupCols)).alias("grp"), cells).filter("v is not null")
        none = F.lit(None).cast("string")
        if self.getOrDefault(self.strategy) == "median":
            own, whole = exact_quantiles(long, "v", {"value": 0.5}, ["feature", "grp"]), exact_quantiles(long, "v", {"value": 0.5}, ["feature"])
        else:
            parts = long.groupBy("feature", "grp").agg(F.avg("v").alias("value"), F.sum("v").alias("s"), F.count("v").alias("n"))
            own, whole = parts.select("feature", "grp", "value"), parts.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("value"))
        return own.select("feature", "grp", "value").unionByName(whole.select("feature", none.alias("grp"), "value"))


# ---- text ----------------------------------------------------------------------------------------

class _BayesParams(HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    textCol = Param(Params._dummy(), "textCol", "the text", TypeConverters.toString)
    modelType = Param(Params._dummy(), "modelType", "multinomial, complement or bernoulli", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "added to every count", TypeConverters.toFloat)
    minDocs = Param(Params._dummy(), "minDocs", "fewest fitted documents of a term", TypeConverters.toInt)
    grams = Param(Params._dummy(), "grams", "1: words, 2: words and pairs of neighbours", TypeConverters.toInt)


class TextBayesModel(StateModel, _BayesParams):
    """``state``: (term, cls, w) and, with a null term, each class's bias; cls null and w the fitted documents."""

    def classes(self) -> list[float]:
        return [r.cls for r in self.state.filter("term is null").select("cls").orderBy("cls").collect()]

    def top_terms(self, n: int = 20) -> DataFrame:
        """(cls, rank, term, w): the terms with the largest weight per class, ties by term."""
        from pyspark.sql import Window
        best = Window.partitionBy("cls").orderBy(F.round("w", 9).desc(), "term")
        rows = self.state.filter("term is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
        return rows.select("cls", "rank", "term", "w")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bias = {r.cls: r.w for r in self.state.filter("term is null").collect()}  # one row per class
        classes = sorted(bias)
        wide = bayes.wide_weights(self.state.filter("term is not null"), classes)
        text = F.coalesce(F.col(self.getOrDefault(self.textCol)), F.lit(""))
        rows = dataset.withColumn("_text", F.md5(text))
        # a prediction depends on the text alone: each text is read once, however often it stands
        once = dataset.select(F.md5(text).alias("_of"), text.alias("_body")).dropDuplicates(["_of"])
        once = with_terms(once, "_body", grams=self.getOrDefault(self.grams))
        terms = F.array_distinct("terms") if self.getOrDefault(self.modelType) == "bernoulli" else F.col("terms")
        sums = once.select("_of", each(terms).alias("term")).join(wide, "term").groupBy("_of").agg(F.array(*[F.sum(f"w{i}") for i in range(len(classes))]).alias("_sums"))
        scored = rows.join(sums, F.col("_text") == F.col("_of"), "left")
        raw = F.array(*[F.lit(float(bias[c])) + F.coalesce(F.get("_sums", F.lit(i)), F.lit(0.0)) for i, c in enumerate(classes)])
        scored = scored.withColumn("_raw", raw).withColumn("_top", F.array_max("_raw"))
        scored = scored.withColumn("_odds", F.transform("_raw", lambda x: F.exp(x - F.col("_top"))))
        total = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
        # as in the table form, scores equal to six places go to the larger class
        best = F.array_max(F.transform("_raw", lambda x, i: F.struct(F.round(x, 6).alias("s"), i.alias("i"))))["i"]
        names = F.array(*[F.lit(float(c)) for c in classes])
        scored = scored.withColumns({
            self.getRawPredictionCol(): array_to_vector("_raw"), self.getProbabilityCol(): array_to_vector(F.transform("_odds", lambda x: x / total)), self.getPredictionCol(): F.get(names, best)})
        return scored.drop("_text", "_of", "_sums", "_raw", "_top", "_odds")


class TextBayes(StateEstimator, _BayesParams):
    """Naive Bayes on the words of a text, all words that ``minDocs`` fitted documents hold; rows without a label teach nothing."""

    model_class = TextBayesModel

    @keyword_only
    def __init__(self, *, textCol="text", labelCol="label", modelType="multinomial", alpha=1.0, minDocs=3, grams=2, predictionCol="prediction", probabilityCol="probability",
                 rawPredictionCol="rawPrediction"):
        super().__init__()
        self._setDefault(textCol="text", labelCol="label", modelType="multinomial", alpha=1.0, minDocs=3, grams=2, predictionCol="prediction", probabilityCol="probability",
                         rawPredictionCol="rawPrediction")
        self._set(**self._input_kwargs)

    def learn(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("cls"), F.col(self.getOrDefault(self.textCol)).alias("_body")).filter("cls is not null")
        docs = with_terms(rows, "_body", grams=self.getOrDefault(self.grams)).select("cls", run_counts(F.col("terms")).alias("runs"))
        table = cut(bayes.class_term_table(docs, "cls", self.getOrDefault(self.minDocs)))
        fit = {"multinomial": bayes.multinomial_fit, "complement": bayes.complement_fit, "bernoulli": bayes.bernoulli_fit}[self.getOrDefault(self.modelType)]
        weights, bias = fit(table, docs, "cls", self.getOrDefault(self.alpha))
        return weights.select("term", "cls", "w").unionByName(bias.select(F.lit(None).cast("string").alias("term"), "cls", F.col("bias").alias("w")))
