"""Words whose polynomial hashes modulo 2**64 agree whatever the base: nothing may take them for one."""

import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_corpus import tokenizer  # noqa: E402
from tidelane.llm import bpe, packing, token_files  # noqa: E402
from tidelane.llm.near_dups import near_duplicates  # noqa: E402
from tidelane.llm.shared import new_path  # noqa: E402
from tidelane.llm.substrings import dedup_substrings  # noqa: E402


def thue_morse(a: str, b: str, n: int = 1024) -> str:
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


ONE, OTHER = thue_morse("a", "b"), thue_morse("b", "a")


@pytest.fixture(scope="module")
def docs(spark):
    rest = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join([ONE, *rest])), (2, " ".join([OTHER, *rest[::-1]])), (3, f"{ONE} {ONE}"), (4, f"{OTHER} {OTHER}"), (5, ONE), (6, OTHER)]
    # windows of words: runs of two words in the Thue-Morse order and its complement
    rows += [(7, " ".join(thue_morse("x ", "y ").split())), (8, " ".join(thue_morse("y ", "x ").split()))]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_substrings_keep_them_apart(docs):
    seen, want = set(), {}
    for i, text in sorted(map(tuple, docs.collect())):
        w = text.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = sum(gone)
    assert {r.doc_id: r.n_removed for r in dedup_substrings(docs).collect()} == want and want[1] == want[2] == 0


def test_near_duplicates_keep_them_apart(docs):
    got = {r.doc_id: r.component_id for r in near_duplicates(docs.where("doc_id < 7")).collect()}
    assert got == {i: i for i in range(1, 7)}


def test_encoders_keep_them_apart(spark, docs):
    rows = dict(map(tuple, docs.collect()))
    t, path = tokenizer("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows.items()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(docs, path).collect()} == {i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in packing.best_fit_pack(docs, path).collect()} == {i: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for i, x in want.items()}
    t, path, at = tokenizer("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark)
    token_files.write(docs, at, path)
    assert {r.doc_id: r.ids for r in token_files.contents(token_files.read(spark, at)).collect()} == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows.items()}
