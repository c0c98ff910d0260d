"""Seeded bootstrap of metrics over time series.

A resample is a set of circular blocks; which rows it takes follows from a hash of (symbol, resample, block),
so that no index table goes through the driver and a lost executor recomputes the same draw.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _drawn(table: DataFrame, blocks: int, resamples: int, seed: int) -> DataFrame:
    """Rows of each symbol and resample, drawn in circular blocks of ``blocks`` rows."""
    w = Window.partitionBy("symbol").orderBy("h")
    rows = table.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    slots = rows.select("symbol", "i", "n").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    start = F.pmod(F.xxhash64("symbol", "resample", F.floor(F.col("i") / blocks), F.lit(seed)), F.col("n"))
    picks = slots.select("symbol", "resample", ((start + F.col("i") % blocks) % F.col("n")).alias("i"))
    return picks.join(rows.drop("n"), ["symbol", "i"])


def _auc(score: str, by: list[str]):
    """Mann-Whitney sums of one score with average ranks."""
    w, ties = Window.partitionBy(*by).orderBy(score), Window.partitionBy(*by, score)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def paired_block_auc(table: DataFrame, a: str, b: str, blocks: int = 24, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """symbol, mean, lo, hi (95 %) of AUC(a) - AUC(b) over paired resamples, share where a is better, and the verdict. Reads label."""
    by = ["symbol", "resample"]
    drawn = _drawn(table.select("symbol", "h", "label", a, b), blocks, resamples, seed)
    ranked = drawn.withColumn("ra", _auc(a, by)).withColumn("rb", _auc(b, by))
    pos = F.sum("label")
    delta = (F.sum(F.col("label") * F.col("ra")) - F.sum(F.col("label") * F.col("rb"))) / (pos * (F.count("*") - pos))
    each = ranked.groupBy(*by).agg(F.when((pos > 0) & (pos < F.count("*")), delta).alias("delta"))
    out = each.groupBy("symbol").agg(F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"), F.avg((F.col("delta") > 0).cast("double")).alias("share_better"))
    return out.withColumn("verdict", F.when(F.col("lo") > 0, "better").when(F.col("hi") < 0, "worse").otherwise("indistinguishable"))


def stationary_sharpe(table: DataFrame, resamples: int = 1000, seed: int = 2, bars_a_year: float = 8760.0) -> DataFrame:
    """symbol, lo and hi (95 %) of the annualised Sharpe ratio of ``net``, over resamples whose blocks end at each row with probability n ** (-1/3)."""
    w = Window.partitionBy("symbol").orderBy("h")
    rows = table.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    slots = rows.select("symbol", "i", "n").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64("symbol", "resample", "i", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    s = Window.partitionBy("symbol", "resample").orderBy("i")
    slots = slots.withColumn("block", F.sum((u < F.pow("n", F.lit(-1 / 3))).cast("int")).over(s))
    first = Window.partitionBy("symbol", "resample", "block")
    start = F.pmod(F.xxhash64("symbol", "resample", "block", F.lit(seed + 1)), F.col("n"))
    picks = slots.select("symbol", "resample", ((start + F.col("i") - F.min("i").over(first)) % F.col("n")).alias("i"))
    each = picks.join(rows.select("symbol", "i", "net"), ["symbol", "i"]).groupBy("symbol", "resample").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * math.sqrt(bars_a_year)).alias("sharpe"))
    return each.groupBy("symbol").agg(F.avg("sharpe").alias("mean"), F.percentile("sharpe", F.lit(0.025)).alias("lo"), F.percentile("sharpe", F.lit(0.975)).alias("hi"))
