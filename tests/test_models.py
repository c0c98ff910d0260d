"""Sizes of the registered models, and what choosing, walking forward and comparing give, on smaller ensembles."""

import math
import random

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from tidelane.operators import models
from tidelane.plans import operators, registry


def test_registered_sizes(spark, monkeypatch):
    forest, boosted = models.ESTIMATORS["random_forest"](), models.ESTIMATORS["boosted"]()
    assert (forest.getNumTrees(), boosted.getMaxIter()) == (300, 300)
    assert [p["alpha"] for p in models.GRIDS["ridge"]] == [1, 10, 100] and [p["maxDepth"] for p in models.GRIDS["boosted"]] == [3, 5]
    seen = []
    for name in ("paired_block_auc", "stationary_sharpe"):
        monkeypatch.setattr(operators.bootstrap, name, lambda *a, **b: seen.append(b["resamples"]))
    for name in ("bootstrap_block_auc", "bootstrap_sharpe"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [1000, 1000]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setitem(models.ESTIMATORS, "random_forest", lambda: RandomForestRegressor(labelCol="y", featuresCol="x", numTrees=3, maxDepth=4, seed=1))
    monkeypatch.setitem(models.ESTIMATORS, "boosted", lambda maxDepth=4: GBTRegressor(labelCol="y", featuresCol="x", maxIter=2, maxDepth=maxDepth, seed=1))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(s, h, 3 * a + rng.gauss(0, 0.1), a, rng.gauss(0, 1)) for s in ("p", "q") for h in range(180) for a in [rng.gauss(0, 1)]]
    return spark.createDataFrame(rows, "symbol string, h long, y double, a double, b double").coalesce(1).persist()


def test_selection_names_its_parameters(table, small):
    got = {r.model: r for r in models.select(table, ["a", "b"]).collect()}
    assert got["ridge"].chosen and got["ridge"].params == "{'alpha': 1.0}" and got["ridge"].test_rmse < 0.2


def test_walk_forward_chooses_and_gives_conformal_bands(table, small):
    got = models.walk_forward(table, ["a", "b"], folds=2, purge=6).collect()
    assert {(r.fold, r.model) for r in got} == {(f, m) for f in (0, 1) for m in ("zero", "mean", "trailing_mean", "ridge", "random_forest", "boosted")}
    first, width = 89, 46
    assert {(r.symbol, r.h) for r in got} == {(s, h) for s in ("p", "q") for h in range(first, 180)}
    for fold in (0, 1):
        a = first + fold * width
        held = sorted(abs(r.y) for r in table.where(f"h >= {a - width} and h < {a - 6}").collect())
        zero = next(r for r in got if r.fold == fold and r.model == "zero")
        assert zero.hi == pytest.approx(held[math.ceil((len(held) + 1) * 0.9) - 1]) and zero.lo == -zero.hi
    assert {r.params for r in got if r.model == "ridge"} == {"{'alpha': 1.0}"}


def test_gains_and_models_of_one_symbol(table, small):
    assert [(r.feature, r["rank"]) for r in models.gain_importance(table, ["b", "a"]).collect()] == [("a", 1), ("b", 2)]
    got = {r.symbol: r for r in models.per_asset(table, ["a", "b"]).collect()}
    assert set(got) == {"p", "q"} and all(r.n_test == 28 and 0 < r.rmse_own < 3 and 0 < r.rmse_global < 3 for r in got.values())
