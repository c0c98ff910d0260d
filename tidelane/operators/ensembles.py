"""Spark ML's regression forests and boosted trees, grown inside one task.

Prediction frames hold bars, not events, so they are small, and growing hundreds of trees as chains of Spark jobs costs far more
than the trees. Here a whole ensemble is grown on one task's rows with the same rules as Spark ML's (binned thresholds, variance
gain, level by level, first boosted tree with weight 1, squared error's residuals doubled) and an estimator's own parameters;
only the random draws differ. Without any it gives Spark ML's predictions (tested).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GBTRegressor


@dataclass(frozen=True)
class Plan:
    """Parameters of an estimator."""

    boosted: bool
    trees: int
    depth: int
    bins: int
    least: int
    gain: float
    step: float
    rate: float
    bootstrap: bool
    features: str
    seed: int


def plan(estimator) -> Plan:
    boosted = isinstance(estimator, GBTRegressor)
    return Plan(
        boosted, estimator.getMaxIter() if boosted else estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMaxBins(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(),
        estimator.getStepSize() if boosted else 1.0, estimator.getSubsamplingRate(), not boosted and estimator.getBootstrap(), estimator.getFeatureSubsetStrategy(), estimator.getSeed(),
    )


def tried(strategy: str, d: int, trees: int) -> int:
    """How many of d features a node tries."""
    named = {"all": d, "onethird": math.ceil(d / 3), "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "auto": d if trees == 1 else math.ceil(d / 3)}
    if strategy in named:
        return named[strategy]
    return min(d, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * d)


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between all distinct values, or those nearest to equal shares of the rows."""
    distinct, count = np.unique(values, return_counts=True)
    middle, most = (distinct[:-1] + distinct[1:]) / 2, min(bins, len(values)) - 1
    if len(middle) <= most:
        return middle
    stride, found = len(values) / (most + 1), []
    target, seen = stride, np.cumsum(count).tolist()
    for i in range(1, len(seen)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def tree(x: np.ndarray, y: np.ndarray, weight: np.ndarray, p: Plan, rng: np.random.Generator, bins: int) -> tuple[np.ndarray, ...]:
    """Feature (-1: leaf), last bin that goes left, left child (the right one follows) and value of each node. x: bins of rows."""
    d, rows = x.shape[1], np.flatnonzero(weight > 0)
    some = tried(p.features, d, 1 if p.boosted else p.trees)
    feature, edge, left, value = [], [], [], []
    node, n = np.zeros(len(rows), np.int64), 1  # place of each row among the level's n nodes
    for level in range(p.depth + 1):
        w, target = weight[rows], y[rows]
        total, first, second = (np.bincount(node, v, n) for v in (w, w * target, w * target * target))
        mean = first / np.maximum(total, 1e-300)
        impurity = second / np.maximum(total, 1e-300) - mean * mean
        open_ = np.zeros(n, bool) if level == p.depth else np.abs(impurity) > 2.0**-52 if level else np.ones(n, bool)
        best, best_f, best_b = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        if open_.any():
            allowed = np.ones((n, d), bool) if some == d else rng.random((n, d)).argsort(1).argsort(1) < some
            for f in range(d):
                key = node * bins + x[rows, f]
                a, b, c = (np.bincount(key, v, n * bins).reshape(n, bins).cumsum(1)[:, :-1] for v in (w, w * target, w * target * target))
                ra, rb, rc = total[:, None] - a, first[:, None] - b, second[:, None] - c
                ok = (a >= p.least) & (ra >= p.least)
                gain = np.where(ok, impurity[:, None] - ((c - b * b / np.maximum(a, 1)) + (rc - rb * rb / np.maximum(ra, 1))) / total[:, None], -1.0)
                at = gain.argmax(1)
                got = gain[np.arange(n), at]
                better = open_ & allowed[:, f] & (got > best) & (got >= p.gain)
                best, best_f, best_b = np.where(better, got, best), np.where(better, f, best_f), np.where(better, at, best_b)
        split = best_f >= 0
        begin = sum(map(len, value)) + n
        feature.append(best_f)
        edge.append(best_b)
        left.append(np.where(split, begin + 2 * (np.cumsum(split) - 1), 0))
        value.append(mean)
        if not split.any():
            break
        go = split[node]
        rows, node = rows[go], node[go]
        node = 2 * (np.cumsum(split) - 1)[node] + (x[rows, best_f[node]] > best_b[node])
        n = 2 * int(split.sum())
    return tuple(np.concatenate(v) for v in (feature, edge, left, value))


def told(grown: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """A tree's value of each row of bins."""
    feature, edge, left, value = grown
    at = np.zeros(len(x), np.int64)
    todo = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(todo):
        here = at[todo]
        at[todo] = left[here] + (x[todo, feature[here]] > edge[here])
        todo = todo[feature[at[todo]] >= 0]
    return value[at]


def _filled(train: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Missing values (null, NaN) become the training rows' median."""
    out = rows.copy()
    for j in range(rows.shape[1]):
        known = np.sort(train[~np.isnan(train[:, j]), j])
        out[np.isnan(rows[:, j]), j] = known[(len(known) - 1) // 2] if len(known) else 0.0
    return out


def predict(p: Plan, train: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Predictions for ``rows`` of the ensemble grown on the training rows."""
    train, rows = _filled(train, train), _filled(train, rows)
    cuts = [thresholds(train[:, j], p.bins) for j in range(train.shape[1])]
    x, z = (np.stack([np.searchsorted(c, m[:, j]) for j, c in enumerate(cuts)], 1) for m in (train, rows))
    bins, out, own = max(map(len, cuts)) + 1, np.zeros(len(rows)), np.zeros(len(y))
    for i in range(p.trees):
        rng = np.random.default_rng((p.seed % (1 << 63), i))
        weight = rng.poisson(p.rate, len(y)).astype(float) if p.bootstrap else (rng.random(len(y)) < p.rate).astype(float) if p.rate < 1 else np.ones(len(y))
        if not p.boosted:
            out += told(tree(x, y, weight, p, rng, bins), z) / p.trees
            continue
        grown = tree(x, 2 * (y - own) if i else y, weight, p, rng, bins)
        own += (p.step if i else 1.0) * told(grown, x)
        out += (p.step if i else 1.0) * told(grown, z)
    return out
