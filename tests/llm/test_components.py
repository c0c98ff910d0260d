"""Connected components against union by hand."""

import random

from tidelane.llm.shared import components


def _roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(x, find(x)) for x in root if find(x) != x}


def test_components_of_chains_hubs_and_random_edges(spark):
    rng = random.Random(5)
    cases = [
        [],
        [(None, 1), (2, None), (3, 3)],
        [(4, 9), (9, 4), (4, 9), (4, 12)],
        [(9, 4), (9, 5)],
        [(i + 1, i) for i in range(70)],
        [(7, i) for i in range(40)],
        [(-5, 3), (3, -9223372036854775808), (9223372036854775807, 3)],
        [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
    ]
    for edges in cases:
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert {(r.node, r.root) for r in got.collect()} == _roots(edges)
        assert got.count() == len(_roots(edges))
