"""Rules of the quality classifier as a Spark column."""

import numpy as np
import pytest

from tidelane.llm import quality


def test_many_rules_are_one_column(spark):
    rng = np.random.default_rng(3)
    x = rng.random((50, len(quality.STATISTICS)))
    rules = [(quality.Rule(tuple((int(rng.integers(x.shape[1])), bool(rng.integers(2)), float(rng.random())) for _ in range(3))), float(rng.normal())) for _ in range(801)]
    got = [r.p for r in spark.createDataFrame(x.tolist(), quality.STATISTICS).coalesce(1).select(quality.compiled(rules, 0.25).alias("p")).collect()]
    total = 0.25 + sum(w * r.holds(x) for r, w in rules)
    assert got == pytest.approx((1 / (1 + np.exp(-total))).tolist(), rel=1e-9)
    assert spark.createDataFrame(x.tolist(), quality.STATISTICS).select(quality.compiled([], 0.0).alias("p")).first().p == 0.5
