"""Suffix trees of op1: nodes by definition, sizes of groups, heavy prefixes."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tidelane.llm import substrings as sub  # noqa: E402


def brute(rows, window=20):
    seen, want = set(), {}
    for i, text in sorted(rows):
        w = text.split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        want[i] = sum(gone)
    return want


def test_nodes_are_shared_by_equal_prefixes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (6, 300)).astype(np.uint64)
    tree = sub.Tree(words)
    for depth in range(7):
        node = tree.nodes(depth)
        paths = [tuple(words[:depth, i]) for i in range(300)]
        assert len(set(zip(node.tolist(), paths, strict=True))) == len(set(paths)) == len(set(node.tolist()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    common = [rng.choices("abcdefgh", k=90) for _ in range(4)]
    out = []
    for i in range(160):
        w = rng.choices("abcdefgh", k=rng.choice([10, 30, 120]))
        for part in rng.sample(common, 2):
            a = rng.randrange(60)
            w[len(w) // 2 : len(w) // 2] = part[a : a + 30]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("frequent", [1, 10**6])
def test_frequent_prefixes_change_only_the_dealing(spark, rows, frequent, monkeypatch):
    monkeypatch.setattr(sub, "FREQUENT", frequent)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(sub.frequent_prefixes(d, sub.Shape())) == (0 if frequent == 1 else 8)
    got = {r.doc_id: r.n_removed for r in sub.dedup_substrings(d).collect()}
    assert got == brute(rows)


def test_rows_of_one_id_and_of_none_are_spread_over_buckets(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None if i % 2 else 5, f"{text} n{i} " + " ".join(f"{i}_{k}" for k in range(25))) for i in range(60)]
    got = sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # one row of the 60 keeps the passage, and a row with an id is before those without
    assert sorted(r.n_removed for r in got) == [0] + [40] * 59 and [r.doc_id for r in got if not r.n_removed] == [5]


def test_tasks_get_bounded_parts_of_windows():
    rng = np.random.default_rng(3)
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 50, 400)) for _ in range(50)]
    import pyarrow as pa

    shape = sub.Shape()
    table = pa.table({"doc_id": pa.array(range(50), pa.int64()), "text": docs})
    c = sub.Candidates(table, np.unique(np.concatenate([s.fps for _, s in sub.Candidates(table, np.zeros(0, np.uint64), shape).pieces])), shape)
    group = sub._route(c.words, c.anchor, [], shape.prefix)
    part = sub.mix(sub._route(c.words, c.anchor, [np.unique(c.words)], shape.prefix)) % np.uint64(64)
    assert np.bincount(part.astype(int), minlength=64).max() < 4 * len(part) / 64 < np.unique(group, return_counts=True)[1].max() * 4
