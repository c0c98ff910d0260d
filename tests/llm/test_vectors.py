"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import ann, grid_join


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    out = []
    for i in range(900):
        v = centres[i % 40] + (0.05 if i % 3 else 0.6) * rng.standard_normal(16)
        out.append((i, (v * rng.uniform(0.5, 2)).tolist(), int(i % 40 % 4)))
    out += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, out[0][1], None), (2005, out[1][1], out[1][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] * 16, 0)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("x")).withColumn("rid", F.lit(0)).repartition(3)


def test_grid_join_equals_brute_force(rows, table):
    ok = [(i, np.array(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for n, (i, v, g) in enumerate(ok):
        for j, w, h in ok[n + 1 :]:
            if g == h and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                for j in links[todo.pop()] - root.keys():
                    root[j] = i
                    todo.append(j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in grid_join.near_duplicates(table).collect()}
    assert got == {i: (len(x), root[i], root[i] == i) for i, x in links.items()}
    assert sum(map(len, links.values())) > 1000


def test_search_recall_and_exact_scores(rows, table):
    ok = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, v in ok:
        if i % 20:
            continue
        s = (m * v).sum(1)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        assert [k for k, *_ in got[i]] == list(range(1, len(got[i]) + 1))
        score = dict(zip(ids.tolist(), s.tolist(), strict=True))
        assert all(score[j] == x for _, j, x in got[i]) and i not in [j for _, j, _ in got[i]]
        hits += len({j for _, j, _ in got[i]} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_search_finds_all_rows_of_a_small_table(spark):
    rng = np.random.default_rng(1)
    small = spark.createDataFrame([(i, rng.standard_normal(64).tolist(), 0) for i in range(15)], "vec_id long, embedding array<float>, label int")
    got = ann.search(small, F.col("vec_id") % 7 == 0, k=20).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in got) == [(0, 14), (7, 14), (14, 14)]


def test_empty_tables(spark):
    t = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert grid_join.near_duplicates(t).count() == 0
    assert ann.search(t, F.col("vec_id") % 20 == 0).count() == 0


def test_grid_join_keeps_links_beside_rows_without_id(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(None, v, 0), (5, v, 0), (None, v, 0), (3, v, 0), (None, w, 0), (8, w, 0), (9, [0.0, 0.0, 1.0], 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in grid_join.near_duplicates(t).collect()]
    assert sorted(x for x in got if x[0]) == [(3, 3, 3, True), (5, 3, 3, False), (8, 1, 8, True), (9, 0, 9, True)]
    assert sorted(x[1] for x in got if x[0] is None) == [1, 3, 3] and all(x[2:] == (None, None) for x in got if x[0] is None)


def test_grid_join_reaches_through_rows_without_id_and_counts_copies(spark):
    turn = lambda t: [float(np.cos(t)), float(np.sin(t)), 0.0]
    # 1 - null - 2: neighbours at 0.15 rad have cosine 0.989, ends at 0.3 rad have 0.955
    rows = [(1, turn(0.0), 0), (None, turn(0.15), 0), (2, turn(0.3), 0), *((100 + i, [0.0, 0.0, 2.0], 1) for i in range(3000)), (4000, [0.0, 0.01, 2.0], 1), (7, turn(1.5), 2), (7, turn(3.0), 2)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(map(tuple, grid_join.near_duplicates(t).where("vec_id < 100 or vec_id = 4000 or vec_id is null").collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 2, None, None), (4000, 3000, 100, False), (7, 0, 7, True), (7, 0, 7, True)], key=str)
    big = grid_join.near_duplicates(t).where("vec_id between 100 and 3099").groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in big] == [(3000, 100, 3000)]


def clustered(n=50_000, dim=32, clusters=500, noise=0.3):
    rng = np.random.default_rng(5)
    return rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dim))


@pytest.mark.parametrize("kind", ["plain", "one long vector", "lognormal lengths"])
def test_index_visits_few_rows_of_clustered_vectors(kind):
    m = clustered()
    if kind == "one long vector":
        m[7] *= 20
    elif kind == "lognormal lengths":
        m *= np.random.default_rng(6).lognormal(0, 0.5, len(m))[:, None]
    n, k = len(m), 20
    sample = m[np.random.default_rng(1).choice(n, ann.SAMPLE, replace=False)]
    index, _ = ann.choose(sample, np.sqrt((m * m).sum(1)).max(), ann.like_rank(k, n, len(sample)))
    at = np.arange(0, n, n // 64)[:64]
    q, (shell, bucket) = m[at], index.buckets(m)
    product, seen, work = index.products(m[at]), np.zeros((len(at), n), bool), 0
    for s in np.unique(shell).tolist():
        able, chance, last = index.chances(q, product, s, ann.SUCCESS[0])
        mine = np.flatnonzero(shell == s)
        for t in range(index.tables):
            codes, where = np.unique(bucket[mine, t] % ann.CELLS**index.projections, return_inverse=True)
            hit = index.visited(chance[:, t], np.where(able, last[:, t], np.inf), codes)[:, where]
            seen[:, mine] |= hit
            work += hit.sum()
    score = q @ m.T
    score[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-score, axis=1)[:, :k]
    assert np.take_along_axis(seen, best, 1).mean() >= 0.9 and work / seen.size < 0.15 and seen.mean() < 0.1


def test_probes_are_the_buckets_visited():
    m = clustered(3000)
    index = ann.Index(2, 8, 1.0, np.sqrt((m * m).sum(1)).max(), m[:500], 3)
    q, (shell, bucket) = m[:20], index.buckets(m)
    s = int(np.bincount(shell).argmax())
    _, chance, last = index.chances(q, index.products(q), s, 0.9)
    codes = np.unique(bucket[shell == s, 0] % ann.CELLS**8)
    for i in range(len(q)):
        told = index.probe(chance[i, 0], last[i, 0], 10**7)
        assert set(codes[index.visited(chance[i : i + 1, 0], last[i : i + 1, 0], codes)[0]]) == set(codes) & set(told.tolist())


def test_search_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, float(i % 3)], 0) for i in range(30)] + [(5, [9.0, 9.0], 0), (None, [50.0, 50.0], 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, k=29).orderBy("rank").collect()
    assert len(got) == 29 and [(r["rank"], r.vec_id, r.score) for r in got[:4]] == [(1, 5, 9.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_search_in_blocks_of_queries(spark, rows, table, monkeypatch):
    plain = sorted(map(tuple, ann.search(table, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(map(tuple, ann.search(table, F.col("vec_id") % 20 == 0).collect())) == plain
    rare = ann.search(spark.createDataFrame([r for r in rows if r[0] < 15], "vec_id long, embedding array<double>, label int"), F.col("vec_id") >= 0, k=20)
    assert {r["count"] for r in rare.groupBy("query_id").count().collect()} == {14} and rare.count() == 15 * 14


def test_what_queries_are_sent_to_grows_slowly():
    # 615,000 rows of 64 components, 30,750 queries: under 20 groups instead of 151; a group meets a bounded number of queries and rows
    unit, groups, blocks = ann.grid(615_000, 30_750, 64)
    assert groups < 20 and blocks == 1 and unit * 64 * 8 <= 16 << 20
    unit, groups, blocks = ann.grid(15_000_000, 750_000, 64)
    assert 750_000 / blocks <= ann.BLOCK and 15_000_000 / groups <= unit


def test_queries_that_found_too_few_rows_are_compared_with_all(spark, rows, table, monkeypatch):
    ok = {i: np.array(v) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids, m = np.array(list(ok)), np.stack(list(ok.values()))
    monkeypatch.setattr(ann, "SUCCESS", (1e-9, 1e-9))
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=900).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == sum(i % 20 == 0 for i in ok)
    for i, found in got.items():
        s = (m * ok[i]).sum(1)
        assert found == [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != i][:900]
