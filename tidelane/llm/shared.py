"""Tables kept in the folder that all executors share, sizes read from the session, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set to a temporary folder only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors cost nothing, and the next join deals rows afresh."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars already: no u has two edges, and none is another's v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected edges; nodes without edges are absent.

    Alternating large and small stars, until all edges are stars; each round is two partially aggregated minima
    and joins that Spark can split, so a hub with very many neighbours is not one task. Rounds grow with the
    logarithm of the longest chain. Null endpoints and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e)
    while not _stars(e):
        both = e.union(e.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialise(e.groupBy("u").agg(F.min("v").alias("m")))
        joined = e.join(least, "u")
        e = materialise(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
