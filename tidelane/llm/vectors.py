"""Vector columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length among the usable vectors: not null, not zero, without null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    out = []
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        m = values[begin[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            ok = np.isfinite(m).all(1) & (m != 0).any(1) & np.isfinite((m * m).sum(1)) & ((m * m).sum(1) > 0)
        if ok.any():
            out.append((rows[ok], m[ok]))
    return out


def usable(table: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, dim, and vec (little-endian doubles) of rows with a usable vector."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}

    def run(batches):
        for batch in batches:
            for rows, m in matrices(batch.column("embedding")):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(np.full(len(rows), m.shape[1], np.int32)), pa.array([x.tobytes() for x in m], pa.binary())], names=[*keep, "dim", "vec"])

    return table.select(*keep, "embedding").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "dim int", "vec binary"]))


def sampled(table: DataFrame, dim: int, rows: int) -> np.ndarray:
    """About ``rows`` of the vectors of one length (2 * ``rows`` at most, one at least), chosen by hash of rid."""
    those = table.where(F.col("dim") == dim)
    cut = int(min(1.0, rows / max(1, those.count())) * (1 << 30)) + 1
    picked = those.where(F.pmod(F.xxhash64("rid", F.lit(13)), F.lit(1 << 30)) < cut).select("vec").limit(2 * rows).collect() or those.select("vec").limit(1).collect()
    return np.frombuffer(b"".join(bytes(r.vec) for r in picked)).reshape(-1, dim)


def common_dim(table: DataFrame) -> int:
    """The commonest vector length (0 without vectors); the smaller of two equally common ones."""
    row = table.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    return int(row.dim) if row else 0
