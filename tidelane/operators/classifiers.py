"""Classifiers of a label (0 or 1) on prediction frames with Spark ML: baselines, choice by validation measures, calibrated probabilities, saved models."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.models import split

KINDS = ("majority", "momentum", "logistic", "random_forest", "boosted")
ESTIMATORS = {
    "logistic": lambda: LogisticRegression(labelCol="label", featuresCol="x", regParam=0.01),
    "random_forest": lambda: RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=300, maxDepth=8, minInstancesPerNode=20, seed=42),
    "boosted": lambda: GBTClassifier(labelCol="label", featuresCol="x", maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=42),
    "shallow": lambda: GBTClassifier(labelCol="label", featuresCol="x", maxIter=100, maxDepth=3, seed=42),
}
#: Validation measures in the order in which they decide; larger is better.
ORDER = ("roc_auc", "pr_auc", "f1", "accuracy")


def fit(kind: str, columns: list[str], rows: DataFrame):
    """A function that adds ``p`` (probability of label 1) to a table. ``majority`` gives the training share of 1, ``momentum`` 1 where the
    first column is above 0, else 0; the others impute medians and scale as fitted on ``rows``."""
    if kind == "majority":
        share = rows.agg(F.avg("label")).first()[0]
        return lambda table: table.withColumn("p", F.lit(share).cast("double"))
    if kind == "momentum":
        return lambda table: table.withColumn("p", F.when(F.col(columns[0]) > 0, 1.0).otherwise(0.0))
    return lambda table, fitted=pipeline(kind, columns).fit(rows): with_probability(fitted, table)


def pipeline(kind: str, columns: list[str]) -> Pipeline:
    filled = [f"{c}_" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), ESTIMATORS[kind]()])


def with_probability(fitted: Transformer, table: DataFrame) -> DataFrame:
    return fitted.transform(table).withColumn("p", vector_to_array("probability")[1]).select(*table.columns, "p")


def measures(scored: DataFrame) -> dict[str, float | None]:
    """``ORDER``'s measures of (label, p) with the cut at 0.5; the areas are null without both classes, f1 without a hit."""
    n, ones, right, hits, called = scored.selectExpr("count(*)", "count_if(label = 1)", "count_if((p >= 0.5) = (label = 1))", "count_if(p >= 0.5 AND label = 1)", "count_if(p >= 0.5)").first()
    out = {"roc_auc": None, "pr_auc": None, "f1": 2 * hits / (ones + called) if hits else None, "accuracy": right / n if n else None}
    if 0 < ones < n:
        rated = scored.select(F.col("label").cast("double").alias("label"), F.col("p").alias("rawPrediction"))
        for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR")):
            out[name] = BinaryClassificationEvaluator(labelCol="label", numBins=0, metricName=metric).evaluate(rated)
    return out


def select(table: DataFrame, columns: list[str], kinds: tuple[str, ...] = KINDS, purge: int = 6) -> DataFrame:
    """model, its validation measures and whether it is the choice, and for the choice the test measures (test_*) after a fit on train and validation.

    Measures decide in ``ORDER``, nulls last, ties to the earlier kind; baselines may win. Rows without a label take no part.
    """
    train, validation, test = split(table.where("label IS NOT NULL").withColumn("label", F.col("label").cast("int")), purge)
    found = {k: measures(fit(k, columns, train)(validation)) for k in kinds}
    worst = -math.inf
    best = min(kinds, key=lambda k: [-(worst if found[k][m] is None else found[k][m]) for m in ORDER])
    final = measures(fit(best, columns, train.union(validation))(test))
    rows = [(k, *(found[k][m] for m in ORDER), *(final[m] if k == best else None for m in ORDER), k == best) for k in kinds]
    return table.sparkSession.createDataFrame(rows, ", ".join(["model string", *(f"{m} double" for m in ORDER), *(f"test_{m} double" for m in ORDER), "chosen boolean"]))


def calibrated(rows: DataFrame, columns: list[str], method: str = "isotonic", kind: str = "shallow"):
    """A function that adds the calibrated probability ``p`` of label 1, fitted on ``rows`` (h, label, columns) alone: never pass test rows.

    Rows are dealt in two or three stratified folds (no more than the rarer class has rows, never under two); for each fold a classifier is fitted on the others and
    calibrated on the fold, by isotonic regression or (``sigmoid``) a logistic curve of the score; ``p`` is the mean of the folds. Values that are null or
    not finite count as 0. One class alone is an error, since there is nothing to learn.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"no such calibration: {method}")
    counts = {r.label: r["count"] for r in rows.where("label IS NOT NULL").groupBy(F.col("label").cast("int").alias("label")).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("both labels must be present")
    folds = max(2, min(3, min(counts.values())))
    known = rows.where("label IS NOT NULL").withColumn("label", F.col("label").cast("int"))
    dealt = known.withColumn("fold", F.expr(f"CAST(pmod(row_number() OVER (PARTITION BY symbol, label ORDER BY h), {folds}) AS INT)")).persist()
    parts = []
    for k in range(folds):
        score = pipeline(kind, columns).fit(finite(dealt.where(F.col("fold") != k), columns))
        held = _scored(score, finite(dealt.where(F.col("fold") == k), columns))
        curve = IsotonicRegression(labelCol="label", featuresCol="s") if method == "isotonic" else Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="sv"), LogisticRegression(labelCol="label", featuresCol="sv", probabilityCol="pv", rawPredictionCol="rv", predictionCol="class")])
        parts.append((score, curve.fit(held.select("label", "s"))))
    dealt.unpersist()

    def run(table: DataFrame) -> DataFrame:
        out = finite(table, columns, keep=True)
        names = []
        for k, (score, curve) in enumerate(parts):
            scored = curve.transform(_scored(score, out))
            p = F.col("prediction") if method == "isotonic" else vector_to_array("pv")[1]
            names.append(f"p_{k}")
            out = scored.withColumn(names[-1], F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).select(*out.columns, names[-1])
        return out.select(*(F.col(f"given_{c}").alias(c) if c in columns else c for c in table.columns), (sum(map(F.col, names[1:]), F.col(names[0])) / len(names)).alias("p"))

    return run


def finite(table: DataFrame, columns: list[str], keep: bool = False) -> DataFrame:
    """The columns as doubles, with 0 where they are null or not finite; with ``keep`` the given values stay as given_*."""
    given = {f"given_{c}": F.col(c) for c in columns} if keep else {}
    return table.withColumns(given | {c: F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")).otherwise(0.0) for c in columns})


def _scored(fitted: Transformer, table: DataFrame) -> DataFrame:
    return fitted.transform(table).withColumn("s", vector_to_array("rawPrediction")[1]).select(*table.columns, "s")


def reliability(scored: DataFrame, bins: int = 5) -> DataFrame:
    """bin, n, mean p and share of label 1 of equal widths of p, with the Brier score and share of label 1 of all rows beside each."""
    known = scored.where("label IS NOT NULL AND p IS NOT NULL")
    whole = known.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), F.avg("label").alias("base_rate")).first()
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("share"), F.lit(whole.brier).cast("double").alias("brier"), F.lit(whole.base_rate).cast("double").alias("base_rate"))


def save(fitted: PipelineModel, path: str) -> None:
    """Write a fitted pipeline, in place of an earlier one."""
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def latest(fitted: PipelineModel, table: DataFrame) -> DataFrame:
    """symbol, h, p of the newest row of each symbol; of several with one h, any."""
    newest = table.groupBy("symbol").agg(F.max_by(F.struct(*table.columns), "h").alias("r")).select("r.*")
    return with_probability(fitted, newest).select("symbol", "h", "p")
