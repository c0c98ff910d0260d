"""Where best fit stops above the lower bound, the local search goes below it, through the operator; token files with null and repeated ids; words of all scripts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_corpus import tokenizer  # noqa: E402
from tidelane.llm import bpe, packing, token_files  # noqa: E402
from tidelane.llm.shared import new_path  # noqa: E402

LENGTHS = [1940, 1636, 1513, 1159, 1628, 883, 1093, 1384, 1857, 1641, 1140, 1967, 1760, 1401, 1993, 1324, 871, 1600, 1904, 1643]


def test_search_needs_fewer_sequences_than_best_fit(spark):
    docs = spark.createDataFrame([(i, "a " * (n - 1)) for i, n in enumerate(LENGTHS)], "doc_id long, text string")
    got = packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert got.sort_values("doc_id").length.tolist() == LENGTHS
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() < len(packing.best_fit(LENGTHS, 4096))


def test_search_never_worsens_and_keeps_every_piece():
    rng = random.Random(1)
    better = 0
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 50))]
        bins = packing.best_fit(lengths, 100)
        out = packing.local_search([list(b) for b in bins], lengths, 100)
        assert sorted(p for b in out for p in b) == list(range(len(lengths))) and all(sum(lengths[p] for p in b) <= 100 for b in out)
        assert len(out) <= len(bins)
        better += len(out) < len(bins)
    assert packing.local_search([], [], 10) == []


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "a b"), (None, None)], "doc_id long, text string")
    got = packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert sorted(got.length) == [1, 3, 3, 3, 3] and got.sequence_id.nunique() == 1 and sorted(got.offset.tolist())[0] == 0


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(3, "b"), (3, "a"), (None, "z"), (None, None), (1, "x y z"), (2, "")] + [(7, f"t{i}") for i in range(50)]
    t, path, at = tokenizer("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark)
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), at, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.documents(token_files.read(spark, at)).collect()))
    ids = [i for _, i, _ in got]
    assert ids == [1, 2, 3, 3, *[7] * 50, None, None]
    assert [s for s, *_ in got] == np.cumsum([0, *(n for *_, n in got)])[:-1].tolist()
    assert sum(n for *_, n in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)


def test_all_scripts_go_through_the_words(spark):
    texts = ["“Curly” quotes — and it’s 日本語のテキスト 한국어", "ΑΣΑΣ Σίσυφος İstanbul ǅ ﬁ é Å", "सत्यमेव जयते ١٢٣ ४५", "a b c\u0085d\x1ce\x7f", "<|endoftext|>x<|startoftext|> <|endoftext|>", "😀😀 👩‍👩‍👧 'S 'LL don't", "", None, "plain words", "Ünïcödé²³¼"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    t, path = tokenizer("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()} == want
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, ids in want.items():
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    t, path, at = tokenizer("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark)
    token_files.write(docs, at, path)
    assert {r.doc_id: r.ids_crc32 for r in token_files.documents(token_files.read(spark, at)).collect()} == {i: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(texts)}
