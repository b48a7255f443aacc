"""Classifiers of ragas over feature vectors, with Spark's ML library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragaloom.ml import nets
from ragaloom.operators import ranks

#: Parts of a feature vector, by the name of the subset.
SUBSETS = {"histogram": 120, "pairs": 264, "all": 480}
MODES = tuple(nets.MODES)


def subset(features: Column, name: str = "all") -> Column:
    """The first part of a feature vector: histogram, histogram and pairs, or all."""
    return F.slice(features, 1, SUBSETS[name])


def chosen(mode: str, distribution: Column, contour: Column) -> Column:
    """The vector a model of that mode takes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return distribution if mode == "pcd" else contour


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The rows with ``fold``: each label's rows dealt out evenly, in an order that depends on key and seed only. The rows
    of a label are ranked in slices of that order, so a label may hold most rows."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    piece = F.coalesce(F.conv(F.substring(mixed, 1, 2), 16, 10).cast("int"), F.lit(0))
    dealt = ranks.ranked(df, [label], piece, [mixed, F.col(key)], "_rank")
    return dealt.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def random_features(column: Column, size: int, width: int = 300, gamma: float | None = None, seed: int = 42) -> Column:
    """Random Fourier features, whose dot products approach an RBF kernel; so a linear machine learns as a kernel one."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((size, width)) * np.sqrt(2 * (gamma or 1.0 / size))
    shift = rng.uniform(0, 2 * np.pi, width)

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / width) * np.cos(np.stack(v.to_list()) @ directions + shift))) if len(v) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(column)


def classifier(kind: str, inputs: int, classes: int, trees: int = 300, seed: int = 42, iterations: int = 600):
    """The estimators on offer: forest, mlp (480-256-128-classes), small_mlp (inputs-128-64-classes), svm (on random features)."""
    if kind == "forest":
        return [RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=seed, labelCol="code", featuresCol="vector")]
    if kind in ("mlp", "small_mlp"):
        hidden = [256, 128] if kind == "mlp" else [128, 64]
        return [StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], seed=seed, maxIter=iterations, labelCol="code", featuresCol="scaled")]
    if kind == "svm":
        return [OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=30, featuresCol="vector", labelCol="code"), labelCol="code", featuresCol="vector")]
    raise ValueError(f"unknown classifier {kind!r}")


def fit(train: DataFrame, kind: str = "forest", trees: int = 300, seed: int = 42) -> PipelineModel:
    """A pipeline fitted on (label string, features array<double>); labels are coded in sorted order, unknown ones are errors."""
    rows = train.filter("label is not null and features is not null").withColumn("vector", array_to_vector("features"))
    inputs, classes = rows.select(F.size("features").alias("n")).first()["n"], rows.select("label").distinct().count()
    coder = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="error").fit(rows)
    stages = [coder, *classifier(kind, inputs, classes, trees, seed), IndexToString(inputCol="prediction", outputCol="told", labels=coder.labels)]
    return Pipeline(stages=stages).fit(rows)


def top(model: PipelineModel, rows: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, rank, raga_name, confidence) of the k likeliest labels; a model without probabilities gives its one label."""
    coder = model.stages[0]
    vectors = rows.filter("features is not null").withColumn("vector", array_to_vector("features"))
    scored = vectors
    for stage in model.stages[1:-1]:
        scored = stage.transform(scored)
    names = F.array(*[F.lit(x) for x in coder.labels])
    if "probability" in scored.columns:
        each = scored.select(key, F.posexplode(vector_to_array("probability")).alias("code", "confidence"))
    else:
        each = scored.select(key, F.col("prediction").cast("int").alias("code"), F.lit(1.0).alias("confidence"))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "code")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", F.get(names, F.col("code")).alias("raga_name"), "confidence")


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline and, beside it, its labels in the order of their codes; what was there is replaced."""
    model.write().overwrite().save(f"{path}/pipeline")
    labels = [(i, x) for i, x in enumerate(model.stages[0].labels)]
    SparkSession.active().createDataFrame(labels, "code int, label string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load(path: str) -> PipelineModel | None:
    """The fitted pipeline of a path; None if there is none."""
    try:
        return PipelineModel.load(f"{path}/pipeline")
    except Exception as e:  # noqa: BLE001
        if "Path does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def labels_of(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) as written beside a pipeline."""
    return spark.read.schema("code int, label string").json(f"{path}/labels")


def encoded(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ``code`` of their label; one that isn't in ``labels`` (code, label) fails the job, null stays null."""
    known = rows.join(F.broadcast(labels.select(F.col("label").alias(column), "code")), column, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.col(column))).cast("int")
    return known.withColumn("code", F.when(F.col("code").isNull() & F.col(column).isNotNull(), unknown).otherwise(F.col("code")))


def decoded(rows: DataFrame, labels: DataFrame, name: str = "label") -> DataFrame:
    """``rows`` with the label of their ``code``; a code out of range fails the job, null stays null."""
    known = rows.join(F.broadcast(labels.select("code", F.col("label").alias(name))), "code", "left")
    unknown = F.raise_error(F.concat(F.lit("code out of range "), F.col("code").cast("string"))).cast("string")
    return known.withColumn(name, F.when(F.col(name).isNull() & F.col("code").isNotNull(), unknown).otherwise(F.col(name)))


class Classifier:
    """A stored model with what it reads: ``features`` (a fitted pipeline), ``pcd`` or ``contour`` (a net). Without a stored
    model nothing is told; another mode is an error."""

    def __init__(self, spark: SparkSession, path: str | None, mode: str = "features") -> None:
        if mode not in ("features", *MODES):
            raise ValueError(f"unknown mode {mode!r}")
        self.mode, self.model = mode, None
        if path is not None and mode == "features":
            self.model = load(path)
        elif path is not None:
            try:
                self.model = nets.load(spark, path, mode)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise

    def classify(self, rows: DataFrame, key: str, k: int = 3) -> DataFrame:
        """(key, rank, raga_name, confidence) of rows (key, features), of which null ones are left out."""
        if self.model is None:
            return rows.select(key, F.lit(0).alias("rank"), F.lit(None).cast("string").alias("raga_name"), F.lit(0.0).alias("confidence")).limit(0)
        fine = rows.filter("features is not null")
        return top(self.model, fine, key, k) if self.mode == "features" else nets.top(self.model, fine, key, k)

    @staticmethod
    def uncertain(told: DataFrame, rows: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
        """(key, uncertain) of each row: whether nothing was told, or the best under the threshold."""
        best = told.filter("rank = 1").select(key, "confidence")
        return rows.select(key).distinct().join(best, key, "left").select(key, F.coalesce(F.col("confidence") < threshold, F.lit(True)).alias("uncertain"))


def cross_validated(rows: DataFrame, key: str, kind: str = "forest", k: int = 5, trees: int = 300) -> tuple[float, float]:
    """Mean and population deviation of the accuracy over the folds."""
    dealt, got = folds(rows, "label", key, k), []
    for i in range(k):
        model = fit(dealt.filter(F.col("fold") != i), kind, trees)
        held = dealt.filter(F.col("fold") == i).withColumn("vector", array_to_vector("features"))
        got.append(MulticlassClassificationEvaluator(labelCol="code", predictionCol="prediction", metricName="accuracy").evaluate(model.transform(held)))
    return float(np.mean(got)), float(np.std(got))


def best_of(rows: DataFrame, key: str, kinds: tuple[str, ...] = ("forest", "svm", "mlp"), names: tuple[str, ...] = ("histogram", "pairs", "all"), k: int = 5, trees: int = 300) -> tuple[PipelineModel, dict]:
    """Every kind with every subset, each once; the best by mean accuracy is fitted again on all rows."""
    scores = {}
    for kind in kinds:
        for name in names:
            scores[kind, name] = cross_validated(rows.withColumn("features", subset(F.col("features"), name)), key, kind, k, trees)
    best = max(scores, key=lambda c: scores[c][0])
    return fit(rows.withColumn("features", subset(F.col("features"), best[1])), best[0], trees), {"scores": scores, "best": best}


def noisy(values: Column, deviation: float, seed: int = 42) -> Column:
    """Gaussian noise on values that aren't 0; the same for equal rows and seed."""

    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            x = np.asarray(x, float)
            draw = np.random.default_rng([seed, int(np.abs(x).sum() * 1e6) % (1 << 32)])
            out.append(np.where(x != 0, x + draw.standard_normal(len(x)) * deviation, x))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(values)
