"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, available: str, values: list[str], max_age: int | None = None, slice_width: int | None = None) -> DataFrame:
    """Each left row with the newest right row whose ``available`` is not after ``time``.

    The right row counts as a whole: a null in it stays null. Of right rows with one availability the one
    whose values sort last stays. Rows older than ``max_age`` give nulls. Adds ``values`` and
    ``source_time``. Both sides are united and read in time order, so nothing is compared pairwise: one
    shuffle and one sort. ``slice_width`` splits long series in time slices of that width, with the
    last right row of each slice carried into the next, so that one symbol is not one task.
    """
    r = right.groupBy(*by, available).agg(F.max(F.struct(*values)).alias("v"))
    row = F.struct(F.col(available).alias("t"), "v")
    a = left.select(*by, F.col(time).alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(r.select(row.alias("x")).schema["x"].dataType).alias("x"))
    b = r.select(*by, F.col(available).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), row.alias("x"))
    both = a.unionByName(b)
    keys = list(by)
    if slice_width:
        both = both.withColumn("part", F.floor(F.col("at") / slice_width))
        lasts = b.withColumn("part", F.floor(F.col("at") / slice_width)).groupBy(*by, "part").agg(F.max("x").alias("x"))
        # only one row a slice: the newest before each slice, found among the slices
        slices = both.select(*by, "part").distinct().join(lasts, [*by, "part"], "left")
        carried = slices.withColumn("x", F.last("x", ignorenulls=True).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("x is not null")
        both = both.unionByName(carried.select(*by, (F.col("part") * slice_width).cast(both.schema["at"].dataType).alias("at"), F.lit(-1).alias("side"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), "x", "part"))
        keys.append("part")
    w = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("x", F.last("x", ignorenulls=True).over(w)).where(F.col("side") == 1)
    fresh = F.lit(True) if max_age is None else F.col("at") - F.col("x.t") <= max_age
    return out.select("l.*", *(F.when(fresh, F.col(f"x.v.{c}")).alias(c) for c in values), F.col("x.t").alias("source_time"))


def audit(joined: DataFrame, time: str, values: list[str], max_age: int | None = None) -> DataFrame:
    """One row: counts of cells filled without a source, from the future, or from too old a source; all are 0 in a sound join."""
    filled = F.greatest(*(F.col(c).isNotNull() for c in values)) if len(values) > 1 else F.col(values[0]).isNotNull()
    old = F.lit(False) if max_age is None else (F.col(time) - F.col("source_time") > max_age)
    return joined.agg(F.count_if(filled & F.col("source_time").isNull()).alias("n_unsourced"), F.count_if(F.col("source_time") > F.col(time)).alias("n_ahead"), F.count_if(filled & old).alias("n_stale"))
