"""Classifiers on small ensembles: choice, calibration, saved models."""

import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

from tidelane.operators import classifiers


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setitem(classifiers.ESTIMATORS, "random_forest", lambda: RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=3, maxDepth=3, seed=1))
    for kind in ("boosted", "shallow"):
        monkeypatch.setitem(classifiers.ESTIMATORS, kind, lambda: GBTClassifier(labelCol="label", featuresCol="x", maxIter=2, maxDepth=2, seed=1))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = []
    for h in range(400):
        a = rng.gauss(0, 1)
        rows.append(("p", h, int(rng.random() < 1 / (1 + math.exp(-3 * a))), None if h == 3 else a, rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "symbol string, h long, label int, a double, b double").coalesce(1).persist()


def test_choice_goes_by_the_measures_in_order(table, small):
    rows = classifiers.select(table, ["a", "b"]).collect()
    got = {r.model: r for r in rows}
    assert [r.model for r in rows if r.chosen] == ["logistic"] and got["logistic"].test_roc_auc > 0.8
    assert got["majority"].roc_auc == pytest.approx(0.5) and got["majority"].test_accuracy is None
    # the momentum baseline calls label 1 where the first column is above 0
    held = [r for r in table.collect() if 279 <= r.h < 333]
    assert got["momentum"].accuracy == pytest.approx(sum((r.a > 0) == (r.label == 1) for r in held) / len(held), abs=0.02)


def test_calibration_keeps_columns_and_bounds(table, small):
    for method in ("isotonic", "sigmoid"):
        out = classifiers.calibrated(table.where("h < 300"), ["a", "b"], method)(table.where("h >= 300"))
        assert out.columns == [*table.columns, "p"] and out.count() == 100
        assert out.where("p < 0 OR p > 1 OR p IS NULL").isEmpty()
        first = classifiers.reliability(out).orderBy("bin").collect()
        assert sum(r.n for r in first) == 100 and first[0].brier < 0.23
    kept = classifiers.calibrated(table, ["a", "b"])(table.where("h = 3")).first()
    assert kept.a is None and 0 <= kept.p <= 1
    for bad in (lambda: classifiers.calibrated(table, ["a"], "other"), lambda: classifiers.calibrated(table.where("label = 1"), ["a"])):
        with pytest.raises(ValueError):
            bad()


def test_saved_models_score_the_newest_row(table, tmp_path):
    fitted = classifiers.pipeline("logistic", ["a", "b"]).fit(table)
    for _ in range(2):
        classifiers.save(fitted, str(tmp_path / "model"))
    again = classifiers.load(str(tmp_path / "model"))
    got, want = classifiers.latest(again, table).first(), classifiers.with_probability(fitted, table.where("h = 399")).first()
    assert (got.symbol, got.h) == ("p", 399) and got.p == pytest.approx(want.p)
