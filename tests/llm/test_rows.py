"""Rows are told apart by themselves: null and repeated doc_ids lose and join nothing."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from tests.llm.test_corpus import brute_components, sets_of  # noqa: E402
from tidelane.llm.near_dups import grouped, near_duplicates  # noqa: E402


def rows():
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    out = []
    for k in range(40):
        text = list(base) if k % 2 else [f"t{k}_{i}" for i in range(60)]
        if k % 4 == 1:
            text[rng.randrange(100)] = f"n{k}"
        out.append((None if k % 3 == 0 else k % 10, " ".join(text)))
    return out + [(7, None), (None, ""), (7, "   "), (1, " ".join(base)), (1, " ".join(base))]


def test_components_over_null_and_repeated_ids(spark):
    data = rows()
    want = brute_components(sets_of(enumerate(t for _, t in data)))
    named = {}
    for n, root in want.items():
        ids = [data[m][0] for m, r in want.items() if r == root and data[m][0] is not None]
        named[n] = min(ids, default=None)
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d).collect()), key=str)
    sets = sets_of(enumerate(t for _, t in data))
    assert got == sorted(((i, len(sets[n]), named[n], None if named[n] is None else None if i is None else i == named[n]) for n, (i, _) in enumerate(data)), key=str)


def test_one_row_of_each_group_is_first_and_no_text_is_lost(spark):
    data = rows()
    d = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS rid", "2 AS first").repartition(3)
    out = grouped(d, shingle=2, keep=("text", "key")).collect()
    assert len(out) == len(data) and all(r.key == "x" for r in out)
    kept = [(r.doc_id, r.text) for r in out if r.first]
    want = brute_components(sets_of(enumerate(t for _, t in data)))
    assert len(kept) == len(set(want.values()))
    heads = {}
    for n, root in want.items():
        if data[n][0] is not None:
            heads[root] = min(heads.get(root, 99), data[n][0])
    assert sorted((i for i, t in kept if i is not None and t and t.strip())) == sorted(i for root, i in heads.items() if (data[root][1] or "").strip())


def test_many_null_ids_are_no_cross_join(spark):
    data = [(None, " ".join(f"w{n // 2}_{i}" for i in range(30))) for n in range(1400)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 1400 and all(r.component_id is None and r.kept is None for r in got)
