"""Byte-pair encoding and decoding by prefix-sharing trie traversal (see tokens.TrieWords)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.tokens import encoder


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each text; null texts give no ids. One row for each input row, other columns dropped."""

    def run(batches):
        coder = encoder(path, joined=False, trie=True)
        for batch in batches:
            for a, b, ids, bounds in coder.ids(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids: their tokens joined by a space, as a vocabulary without a decoder has it. Null ids give empty texts."""

    def run(batches):
        coder = encoder(path, joined=False, trie=True)
        for batch in batches:
            texts = [coder.tokenizer.decode(x or [], skip_special_tokens=False) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded text, without building either column: a word's digits and tokens are kept with its encoding."""

    def run(batches):
        coder = encoder(path, joined=False, trie=True)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for a, b, places, bounds in coder.slices(batch.column("text")):
                parts = list(map(coder.extras.__getitem__, places.tolist()))
                for i in range(b - a):
                    own = parts[bounds[i] : bounds[i + 1]]
                    counts.append(sum(p[2] for p in own))
                    ids_sha.append(hashlib.sha256(b" ".join([p[0] for p in own])).hexdigest())
                    text_sha.append(hashlib.sha256(b" ".join([p[1] for p in own])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
