"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed with vector operations. Shallow trees are grown on
random parts of a bounded labelled sample; each path from a root is a rule (a conjunction of
thresholds). Lasso logistic regression weights the rules, most get none, and the others are
compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.labelled import FIT_ROWS, held_out, lasso_logistic, sample
from tidelane.llm.textcore import LOWER, SPACES, buffers, chunks, runs, word_codes, word_spans

STATISTICS = ["n_words", "mean_word", "longest_word", "upper", "lower", "digit", "symbol", "stop", "bang", "bar", "non_ascii", "newline", "distinct", "top_word", "distinct_pairs", "n_lines", "distinct_lines", "mean_line", "symbol_ends", "upper_words"]

#: Bytes of text counted at a time.
SLICE = 1 << 20

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_KINDS = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "symbol": [ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"],
    "stop": [ord(c) for c in ".,;:?"],
    "bang": [0x21],
    "bar": [0x7C],
    "non_ascii": [*range(0xC2, 0xF5)],
    "newline": [10],
}
_TABLES = {}
for _name, _bytes in _KINDS.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][_bytes] = True
_UPPER, _ENDS = _TABLES["upper"], _TABLES["symbol"] | _TABLES["bang"]


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each document."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n documents: number of distinct codes (from 0, dense), and how often its commonest one occurs."""
    size = int(codes.max()) + 1 if len(codes) else 1
    keys = np.sort(owner * size + codes)
    first, _ = runs(keys)
    count = np.diff(np.append(first, len(keys)))
    whose = keys[first] // size
    top = np.zeros(n)
    np.maximum.at(top, whose, count)
    return np.bincount(whose, minlength=n).astype(float), top


def _slice(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1).astype(float)
    starts, ends, offsets = word_spans(text, bounds, SPACES)
    count = np.diff(offsets).astype(float)
    words = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    codes, _ = word_codes(LOWER[text], starts, ends)
    distinct, top = _distinct(codes, owner, n)
    inside = owner[1:] == owner[:-1]
    pairs = pd.factorize((codes[:-1] * (int(codes.max(initial=0)) + 1) + codes[1:])[inside])[0]
    distinct_pairs, _ = _distinct(pairs, owner[:-1][inside], n)
    a, b, lines = word_spans(text, bounds, _NEWLINE)
    n_lines = np.diff(lines).astype(float)
    distinct_lines, _ = _distinct(word_codes(text, a, b)[0], np.repeat(np.arange(n), np.diff(lines)), n)
    upper = _UPPER[text]
    out = {
        "n_words": np.log1p(count),
        "mean_word": _per(length, offsets) / words,
        "longest_word": np.log1p(longest),
        **{k: _per(t[text], bounds) / size for k, t in _TABLES.items()},
        "distinct": distinct / words,
        "top_word": top / words,
        "distinct_pairs": distinct_pairs / np.maximum(count - 1, 1),
        "n_lines": np.log1p(n_lines),
        "distinct_lines": distinct_lines / np.maximum(n_lines, 1),
        "mean_line": np.log1p(count / np.maximum(n_lines, 1)),
        "symbol_ends": _per(_ENDS[text[ends - 1]] if len(ends) else np.zeros(0), offsets) / words,
        "upper_words": _per((upper[starts] & upper[np.minimum(starts + 1, ends - 1)]) if len(starts) else np.zeros(0), offsets) / words,
    }
    return np.stack([out[k] for k in STATISTICS], 1)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the ``keep`` columns and ``STATISTICS`` (doubles) of each whole text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            got = [_slice(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, SLICE)]
            x = np.round(np.concatenate(got), 9) if got else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), *(pa.array(x[:, i].copy()) for i in range(x.shape[1]))], names=["doc_id", *keep, *STATISTICS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)), *(f"{c} double" for c in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for column, above, edge in self.terms:
            ok &= (x[:, column] > edge) == above
        return ok

    def column(self) -> Column:
        cond = F.lit(True)
        for column, above, edge in self.terms:
            cond = cond & ((F.col(STATISTICS[column]) > edge) if above else (F.col(STATISTICS[column]) <= edge))
        return cond


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int):
    """The (gain, column, threshold) that separates y best by Gini impurity."""
    best = None
    n, total = len(y), y.sum()
    for c in columns.tolist():
        order = np.argsort(x[:, c], kind="stable")
        v, s = x[order, c], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        left, right = s[:-1], total - s[:-1]
        gain = np.where(ok, left * left / k + right * right / (n - k), -1)
        at = int(gain.argmax())
        if best is None or gain[at] > best[0]:
            best = (gain[at], c, float((v[at] + v[at + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 3, least: int = 15) -> set[Rule]:
    """Paths of one tree over a random part of rows and statistics."""
    found: set[Rule] = set()
    rows = rng.choice(len(y), min(len(y), 2500), replace=False)
    todo = [((), rows)]
    while todo:
        path, mine = todo.pop()
        if path:
            found.add(Rule(tuple(sorted(path))))
        if len(path) == depth or len(mine) < 2 * least or y[mine].min() == y[mine].max():
            continue
        cut = _split(x[mine], y[mine], rng.choice(x.shape[1], min(x.shape[1], 8), replace=False), least)
        if cut:
            _, column, edge = cut
            high = x[mine, column] > edge
            todo += [((*path, (column, True, edge)), mine[high]), ((*path, (column, False, edge)), mine[~high])]
    return found


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, penalty: float = 2e-3, seed: int = 7) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with lasso weights, and the intercept. With one class or no rows: no rule and the class's share (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return [], float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    rules = sorted(set().union(*(tree_rules(x, y.astype(float), rng) for _ in range(trees))), key=lambda r: r.terms)
    hold, kept, seen = [], [], set()
    for r in rules:
        h = r.holds(x)
        if 10 <= h.sum() <= len(y) - 10 and (key := h.tobytes()) not in seen:
            seen.add(key)
            hold.append(h)
            kept.append(r)
    if not kept:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    w, b = lasso_logistic(np.stack(hold, 1).astype(float), y.astype(float), penalty, steps=400)
    return [(r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-3], b


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The probability as a column over STATISTICS. Weights are summed in a balanced tree: a chain of some hundred sums overflows the stack of Spark's parser and optimiser."""
    terms = [F.lit(intercept), *(F.when(rule.column(), weight).otherwise(0.0) for rule, weight in rules)]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return 1 / (1 + F.exp(-terms[0]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, rows: int = FIT_ROWS, keep: tuple[str, ...] = (), learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted (score >= threshold) and the ``keep`` columns of each row of docs.

    Learns from ``rows`` labelled rows at most outside fold 0, and from texts alone
    (of ``learn_from`` if given, else of docs). Null texts count
    as empty and are scored; a null doc_id is held out. Labels that are null or neither 0 nor 1 are ignored.
    """
    table = statistics(sample(docs if learn_from is None else learn_from, labels, label, rows), "y").toPandas().sort_values(["doc_id", *STATISTICS]).reset_index(drop=True)
    rules, intercept = fit_rules(table[STATISTICS].to_numpy(float), table["y"].to_numpy(float))
    scored = statistics(docs, *keep).select("doc_id", *keep, compiled(rules, intercept).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
