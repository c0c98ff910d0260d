"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidelane.llm import bpe, licenses, packing, quality, token_files, toxicity  # noqa: E402
from tidelane.llm.near_dups import near_duplicates  # noqa: E402
from tidelane.llm.shared import components, new_path  # noqa: E402
from tidelane.llm.substrings import dedup_substrings  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["été", "Straße", "it's", "3²", "日本", "<|endoftext|>", "x!!", "Σς"]
    shared = [rng.choices(words, k=60) for _ in range(3)]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 21, 80, 200]))
        if i % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = shared[i % 3]
        if i % 7 == 0:
            body += body[:45]
        docs.append((i * 3, rng.choice([" ", "\n", "\t\t", "  "]).join(body)))
    base = docs[30][1].split() or ["a"]
    for k in range(12):
        copy = (docs[4][1] + " " + docs[8][1]).split()
        for _ in range(k):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append((1000 + k, " ".join(copy)))
    docs += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, " ".join(base)), (2004, "A b"), (2005, "a B"), (2006, "One"), (2007, "one"), (2008, " ".join(rng.choices(words, k=30_000)))]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, text string")
    return d.withColumn("bucket", F.lit("clash")).withColumn("key", F.lit(1.5)).withColumn("score", F.lit(None).cast("int")).withColumn("n_words", F.lit("x")).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substrings_equal_brute_force(docs):
    seen, want = set(), {}
    for i, text in sorted(corpus()):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 500


def test_substrings_spans_cover_the_removed_words_and_rows_of_one_id_are_kept_apart(spark):
    text = " ".join(f"t{i}" for i in range(50))
    d = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed, [tuple(s) for s in r.spans]) for r in dedup_substrings(d).collect())
    assert got == [(False, 50, 0, []), (False, 50, 50, [(0, 50)]), (True, 0, 0, []), (True, 50, 50, [(0, 50)])]


def sets_of(rows, n=2):
    out = {}
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    sets = sets_of(corpus())
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), c, i == c) for i, c in want.items()}


def test_near_duplicates_find_chains_that_a_star_misses(spark):
    rng = random.Random(2)
    rows = []
    for family in range(12):
        text = [f"f{family}_{i}" for i in range(120)]
        for step in range(8):
            rows.append((family * 100 + rng.randrange(90) + step * 1000, " ".join(text)))
            for k in rng.sample(range(120), 5):
                text[k] = f"n{family}_{step}_{k}"
    want = brute_components(sets_of(rows))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 60


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}}


def test_bpe_equals_the_library(docs):
    t, path = tokenizer("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, text in corpus():
        want = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == decoded
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and got[i].n_tokens == len(want)


def test_trie_words_equal_the_library_on_odd_words():
    from tidelane.llm.tokens import encoder

    e, t = encoder(public_tokenizers.path("word_bpe_49k.json"), False, True), tokenizer("word_bpe_49k.json")
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinorstlhéßd", k=rng.randint(1, 25))) for _ in range(3000)] + ["a" * 300]
    assert e.words([w.encode() for w in words]) == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_token_files_round_trip(spark, docs):
    t, path = tokenizer("byte_bpe_50k.json"), new_path(spark)
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    records = token_files.read(spark, path)
    got, held = {r.doc_id: r for r in token_files.documents(records).collect()}, {r.doc_id: r.ids for r in token_files.contents(records).collect()}
    start = 0
    for i, text in sorted(corpus()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert held[i] == ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("values", [[], [0] * 2500, [2**64 - 1, 0, 2**60, 2**59, 1] * 500, list(range(3000)), [1] * 1023 + [2**40]])
def test_simple8b_any_values(values):
    v = np.array(values, np.uint64)
    p = token_files.pack(v)
    assert (token_files.unpack(p) == v).all()
    for b in range(-(-len(v) // token_files.BLOCK)):
        assert (token_files.unpack_block(p, b) == v[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]).all()


def test_packing_is_gapless_whole_and_tight(docs):
    t, path = tokenizer("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    got = packing.best_fit_pack(docs, path).toPandas()
    want = {}
    for i, text in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_local_search_gives_up_a_bin():
    for lengths, bins in (([5, 3, 5, 3, 2, 2], [[0, 1], [2, 3], [4, 5]]), ([6, 2, 6, 2, 4], [[0, 1], [2, 3], [4]])):
        out = packing.local_search([list(b) for b in bins], lengths, 10)
        assert sorted(p for b in out for p in b) == list(range(len(lengths))) and len(out) == 2 and all(sum(lengths[p] for p in b) <= 10 for b in out)


def test_license_phrases_and_fuzzy_spans(spark):
    rows = [(1, "x Released UNDER the\nMIT-License. y"), (2, "released undr the mit licence"), (3, None), (4, ""), (5, "under the mit license under the mit license"), (6, "cc-by-nc 4.0 Apache License, Version 2.0"), (7, "no notice here at all")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 1, 2, 2, "mit")
    assert (got[2].n_base, got[2].base_labels, got[2].labels) == (0, "", "mit") and 0 < got[2].score < 1 and got[2].first_word is None
    assert [tuple(s)[:3] for s in got[2].spans] == [(0, 4, 2), (1, 4, 2)]
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 0, 4)
    assert (got[6].n_base, got[6].base_labels) == (2, "apache-2,cc-by-nc")
    assert all((got[i].n_base, got[i].labels, got[i].score) == (0, "", 0.0) for i in (3, 4, 7))


def test_license_base_equals_brute_force(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(s, label) for phrase, label in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        places = [s for s, _ in hits]
        assert got[i] == (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))


@pytest.mark.parametrize(("module", "label"), [(toxicity.score, "toxic"), (quality.classify, "quality")])
def test_classifiers_on_held_out_rows(spark, module, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = module(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks = got.score.rank()
    pos = got[label] == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and got.score.between(0, 1).all()


@pytest.mark.parametrize("module", [toxicity.score, quality.classify])
def test_classifiers_without_usable_labels(spark, docs, module):
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = module(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (dedup_substrings(empty), near_duplicates(empty), bpe.digests(empty, path), licenses.scan(empty), packing.best_fit_pack(empty, path), toxicity.score(empty, labels), quality.classify(empty, labels)):
        assert out.count() == 0
    at = new_path(spark)
    token_files.write(empty, at, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.documents(token_files.read(spark, at)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        kept = f"file://{tmp_path}/{k}"
        out.write.parquet(kept)
        before, docs = docs, spark.read.parquet(kept)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = brute_components(sets_of(rows, 5))
            assert {r.doc_id for r in docs.collect()} == set(want.values())
        elif name in ("toxicity", "quality"):
            assert 0.5 * before.count() < docs.count() < before.count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
