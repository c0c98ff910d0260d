"""Near copies on shingles of five words against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from tests.llm.test_corpus import WORD, brute_components  # noqa: E402
from tidelane.llm.near_dups import near_duplicates  # noqa: E402


def five_words(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_near_duplicates_on_five_words_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(900, "a b c"), (901, "A B C"), (902, "a b"), (903, ""), (904, None)]
    for family in range(6):
        text = [f"f{family}_{i}" for i in range(200)]
        for step in range(6):
            rows.append((family * 10 + step, " ".join(text)))
            for k in rng.sample(range(200), 1 + 2 * (step % 4)):
                text[k] = f"n{family}_{step}_{k}"
    sets = five_words(rows)
    want = brute_components(sets)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d, shingle=5).collect()}
    assert got == {i: (len(sets[i]), c, i == c) for i, c in want.items()}
    two = {r.component_id for r in near_duplicates(d).collect()}
    assert len(two) < len(set(want.values()))
