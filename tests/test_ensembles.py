"""Ensembles grown inside a task against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from tidelane.operators import ensembles, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    x[:, 2] = rng.integers(0, 4, 400)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.1 * rng.standard_normal(400)
    table = spark.createDataFrame([(*a, float(b)) for a, b in zip(x.tolist(), y, strict=True)], "a double, b double, c double, y double").coalesce(1)
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(table).persist()


@pytest.mark.parametrize("estimator", [lambda: GBTRegressor(labelCol="y", featuresCol="x", maxIter=8, maxDepth=4, stepSize=0.1, seed=1), lambda: RandomForestRegressor(labelCol="y", featuresCol="x", numTrees=1, maxDepth=12, bootstrap=False, seed=1)])
def test_same_as_spark_without_random_draws(rows, estimator):
    (x, y, table), estimator = rows, estimator()
    told = np.array([r.prediction for r in estimator.fit(table).transform(table).collect()])
    assert ensembles.predict(ensembles.plan(estimator), x, y, x) == pytest.approx(told, abs=1e-6)


def test_registered_ensembles_are_grown_whole_and_learn(rows):
    x, y, _ = rows
    for kind, params in (("random_forest", {}), ("boosted", {"maxDepth": 3}), ("boosted", {"maxDepth": 5})):
        plan = ensembles.plan(models.ESTIMATORS[kind](**params))
        assert (plan.trees, plan.depth) == (300, params.get("maxDepth", 30)) and plan.bootstrap == (kind == "random_forest")
        told = ensembles.predict(plan, x[:300], y[:300], x[300:])
        assert np.mean((told - y[300:]) ** 2) < 0.5 * y[300:].var()


def test_registered_queries_end(spark):
    import time

    from tidelane.plans import registry

    began = time.time()
    got = registry.QUERIES["model_per_asset_vs_global"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 5 and all(r.n_test > 0 and r.rmse_own > 0 and r.rmse_global > 0 for r in got) and time.time() - began < 120


def test_half_widths_of_jobs_are_those_of_each(spark):
    rng = np.random.default_rng(7)
    rows = [(j, float(a), 0.0) for j, n in enumerate((19, 20, 50, 137)) for a in rng.standard_normal(n)]
    scored = spark.createDataFrame(rows, "job int, y double, prediction double")
    for alpha in (0.1, 0.02):
        told = models.half_widths(scored, alpha)
        assert [told.get(j) for j in range(4)] == [models._half_width(scored.where(f"job = {j}"), alpha) for j in range(4)]
