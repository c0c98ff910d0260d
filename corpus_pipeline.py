"""The corpus pipeline: toxic and poor documents go, one of near copies stays, shared passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``documents``. Rows with a null doc_id are judged like others and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import packing, quality, toxicity
from tidelane.llm.near_dups import grouped
from tidelane.llm.registry import vocabulary
from tidelane.llm.shared import materialise
from tidelane.llm.substrings import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5. The lexicon and weights come from labelled rows of all documents."""
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, labels, threshold=0.5, keep=REST, learn_from=every).where(F.col("predicted") == 0).select(COLUMNS)


def remove_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, threshold=0.3, keep=REST, learn_from=every).where(F.col("predicted") == 1).select(COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity 0.8 on shingles of five words), that of the smallest doc_id; rows are told apart by
    themselves, so repeated and null doc_ids lose nothing. Rows without words all stay."""
    return grouped(docs, numerator=80, shingle=5, keep=REST).where("first").select(COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that occur earlier."""
    out = dedup_substrings(docs, window=20, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.best_fit_pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", remove_poor),
    ("near_dedup", remove_near_copies),
    ("substring_dedup", remove_passages),
    ("packing", pack),
]

#: Learned scores and vocabularies are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
