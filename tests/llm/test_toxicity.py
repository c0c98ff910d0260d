"""The pattern grammar against its definition, and what its clauses do to a score."""

import random
import re

import numpy as np
import pytest

from tidelane.llm import toxicity as tox


def brute(text, lexicon):
    """(pattern, weight) of each match by the definition, clause by clause."""
    out = []
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)
        kinds = [lexicon.of(w.encode()) for w in words]
        for i, (kind, weight) in enumerate(kinds):
            if kind not in (tox.INSULT, tox.THREAT):
                continue
            before = [k for k, _ in kinds[:i]]
            after = [k for k, _ in kinds[i + 1 : i + 1 + tox.REACH_TARGET]]
            stop = next((j for j, k in enumerate(after) if k in (tox.INSULT, tox.THREAT)), len(after))
            if tox.REPORT in before:
                p = tox.REPORTED
            elif tox.NEGATION in before[-tox.REACH_NEGATION :]:
                p = tox.NEGATED
            elif tox.TARGET in before[-tox.REACH_TARGET :] or tox.TARGET in after[:stop]:
                p = tox.AIMED
            else:
                p = tox.BARE
            out.append((p, weight))
    return out


def test_automaton_equals_definition():
    rng = random.Random(4)
    lexicon = tox.Lexicon({"idiot": 3.0, "scum": 2.0}, {"moro": 1.5})
    words = ["idiot", "scum", "morons", "kill", "you", "they", "not", "isn't", "said", "x", "y", "z", "été", ".", "\n", ";"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 40]))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    owner, pattern, weight, _ = tox.matches(np.frombuffer(b"".join(raw), np.uint8), bounds, lexicon)
    got = [[] for _ in texts]
    for o, p, w in zip(owner.tolist(), pattern.tolist(), weight.tolist(), strict=True):
        got[o].append((p, w))
    assert got == [brute(t, lexicon) for t in texts]
    assert {p for g in got for p, _ in g} == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    clauses = {"aimed": "you are an idiot", "bare": "what an idiot", "negated": "that is not an idiot", "reported": "someone said an idiot", "contracted": "that isn't an idiot", "none": "what a day"}
    texts = {name: f"the day was long and the road was wide. {c}. the rest was quiet and still" for name, c in clauses.items()}
    rows = [(10**7 + i, t) for i, t in enumerate(texts.values())]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/labels.parquet"), learn_from=docs).collect()
    return dict(zip(texts, (r.score for r in sorted(got, key=lambda r: r.doc_id)), strict=True))


def test_negation_and_report_lower_a_score_and_a_target_raises_it(scored):
    assert scored["aimed"] > scored["bare"] > scored["negated"] > scored["none"]
    assert scored["bare"] > scored["reported"] > scored["none"] and scored["contracted"] == pytest.approx(scored["negated"], rel=0.2)
