"""Near-duplicate vectors: epsilon grid order join.

Unit vectors are projected on leading principal directions (which shortens no distance below
the truth) and sorted by their grid cells of side epsilon. The sequence is cut into blocks, each with
the bounds of its projections; blocks of one label meet only where first cells are neighbours and
bounds are within epsilon. Equal vectors of a label are one row of the sequence, with their number, so groups of copies don't grow the join. Two blocks are joined by halving the longer interval again and again, skipping pairs
of intervals whose bounds are provably further apart, down to short ones that are compared
exactly. A pair of blocks gives a link count for each row and a spanning forest, never all pairs. Rows are told apart by a number of
their own, never by vec_id. Directions are fitted on ``SAMPLE`` vectors at most: they steer only what is skipped, and nothing is skipped that could be linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.shared import components, materialise, shuffle_partitions
from tidelane.llm.vectors import common_dim, sampled, usable

DIRECTIONS, BLOCK, LEAF, SAMPLE = 8, 512, 32, 8000


def directions(m: np.ndarray) -> np.ndarray:
    """Leading principal directions of the rows scaled to norm 1, as columns."""
    unit = m / np.sqrt((m * m).sum(1, keepdims=True))
    _, v = np.linalg.eigh(np.cov(unit, rowvar=False).reshape(m.shape[1], m.shape[1]) if len(m) > 1 else np.eye(m.shape[1]))
    return v[:, ::-1][:, :DIRECTIONS]


def _packed(m: np.ndarray) -> bytes:
    """Rows in single precision where that loses nothing (told apart by length), else in double."""
    small = m.astype(np.float32)
    return small.tobytes() if (small == m).all() else m.tobytes()


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * dim else np.float64
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)


def _blocks(basis: np.ndarray):
    """Cut sorted rows into blocks of one label and length."""

    def run(batches):
        held, key = [], None

        def block():
            rows = pa.Table.from_batches(held)
            dim = key[1]
            m = np.frombuffer(b"".join(rows.column("vec").to_pylist())).reshape(-1, dim)
            y = _project(m, basis)
            pad = np.zeros(DIRECTIONS - y.shape[1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(x, t)
                    for x, t in (
                        ([int(rows.column("rid")[0].as_py())], pa.int64()),
                        ([key[0]], pa.int64()),
                        ([dim], pa.int32()),
                        ([[*y.min(0).tolist(), *pad]], pa.list_(pa.float64())),
                        ([[*y.max(0).tolist(), *pad]], pa.list_(pa.float64())),
                        ([rows.column("rid").to_numpy().tobytes()], pa.binary()),
                        ([rows.column("copies").to_numpy().tobytes()], pa.binary()),
                        ([_packed(m)], pa.binary()),
                    )
                ],
                names=["block", "label", "dim", "low", "high", "rids", "copies", "vecs"],
            )

        n = 0
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            at = 0
            while at < batch.num_rows:
                here = (int(labels[at]), int(dims[at]))
                if key is not None and (here != key or n >= BLOCK):
                    yield block()
                    held, n = [], 0
                key = here
                stop = at
                while stop < batch.num_rows and stop - at < BLOCK - n and (labels[stop], dims[stop]) == here:
                    stop += 1
                held.append(batch.slice(at, stop - at))
                n += stop - at
                at = stop
        if held:
            yield block()

    return run


def _project(m: np.ndarray, basis: np.ndarray) -> np.ndarray:
    unit = m / np.sqrt((m * m).sum(1, keepdims=True))
    return unit @ basis if m.shape[1] == len(basis) else unit[:, :DIRECTIONS]


def _intervals(x: np.ndarray, y: np.ndarray, eps: float, same: bool):
    """Pairs of short intervals (a0, a1, b0, b1) that can hold pairs within eps; of equal sequences, those with a0 <= b0."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(x[a0:a1].min(0) - y[b0:b1].max(0), y[b0:b1].min(0) - x[a0:a1].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            yield a0, a1, b0, b1
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            todo += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            todo += [(a0, a1, b0, mid), (a0, a1, mid, b1)]


def cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have cosine >= threshold; pairs close to it are summed in a fixed order."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    c = (a @ b.T) / (na[:, None] * nb)
    for i, j in zip(*np.nonzero(np.abs(c - threshold) < 1e-12), strict=True):
        c[i, j] = (a[i] * b[j]).sum() / (na[i] * nb[j])
    return c >= threshold


def _joined(basis: np.ndarray, threshold: float):
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def run(batches):
        for batch in batches:
            for dim, same, ra, ca, va, rb, cb, vb in zip(*(batch.column(c).to_pylist() for c in ("dim", "same", "ra", "ca", "va", "rb", "cb", "vb")), strict=True):
                rids, copies = [np.frombuffer(r, np.int64) for r in (ra, rb)], [np.frombuffer(r, np.int64) for r in (ca, cb)]
                a, b = _unpacked(va, len(rids[0]), dim), _unpacked(vb, len(rids[1]), dim)
                link = np.zeros((len(a), len(b)), bool)
                for a0, a1, b0, b1 in _intervals(_project(a, basis), _project(b, basis), eps, same):
                    link[a0:a1, b0:b1] = cosines(a[a0:a1], b[b0:b1], threshold)
                if same:
                    link |= link.T
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                node, root = _forest(link, same)
                rid, count = np.concatenate(rids[: 2 - same]), link @ copies[1]
                if not same:
                    count = np.concatenate([count, copies[0] @ link])
                hit = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(count[hit].astype(np.int64)), pa.array(rid[node[hit]]), pa.array(rid[root[hit]])], names=["rid", "n", "a", "b"])

    return run


def _forest(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each node's smallest number reachable, over both sides (the second after the first)."""
    if not same:
        n, m = link.shape
        full = np.zeros((n + m, n + m), bool)
        full[:n, n:], full[n:, :n] = link, link.T
        link = full
    n = len(link)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            reach = np.zeros(n, bool)
            reach[i] = True
            front = reach
            while front.any():
                front = link[front].any(0) & ~reach
                reach |= front
            root[reach] = i
    return np.arange(n), root


def near_duplicates(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links between vectors of one label with cosine >= ``threshold``, and their components.

    Takes vec_id, embedding and label. Returns vec_id, n_links (other rows linked), component_id
    (smallest vec_id reachable, own included) and kept (vec_id = component_id), one row for each input row. Null labels and
    vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. Rows that repeat a vec_id are vectors of their own, each with its links and component. A row with a null vec_id
    links others, and they reach each other by it; it has null component_id and kept itself.
    """
    spark = table.sparkSession
    eps = float(np.sqrt(max(1e-12, 2 - 2 * threshold))) + 1e-9
    own = materialise(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").withColumn("rid", F.monotonically_increasing_id()))
    every = materialise(usable(own.where(F.col("label").isNotNull()), "rid", "vec_id", "label").withColumn("mark", F.unhex(F.sha2("vec", 256))))
    same = ["label", "dim", "mark"]
    classes = materialise(every.groupBy(*same).agg(F.min("rid").alias("class"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    rows = materialise(every.join(classes.select(F.col("class").alias("rid"), "copies"), "rid").select("rid", "copies", "label", "dim", "vec"))
    dim = common_dim(rows)
    basis = directions(sampled(rows, dim, SAMPLE)) if dim else np.eye(1)

    def cells(batches):
        for batch in batches:
            grid = np.zeros((batch.num_rows, DIRECTIONS), np.int32)
            dims = batch.column("dim").to_numpy()
            vecs = batch.column("vec").to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                y = _project(np.frombuffer(b"".join(vecs[i] for i in at)).reshape(-1, d), basis)
                grid[at, : y.shape[1]] = np.floor(y / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, i].copy()) for i in range(DIRECTIONS))], names=[*batch.schema.names, *(f"c{i}" for i in range(DIRECTIONS))])

    order = ["label", "dim", *(f"c{i}" for i in range(DIRECTIONS)), "rid"]
    placed = materialise(rows.mapInArrow(cells, "rid long, copies long, label long, dim int, vec binary, " + ", ".join(f"c{i} int" for i in range(DIRECTIONS))))
    ordered = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    blocks = materialise(ordered.select("rid", "copies", "label", "dim", "vec").mapInArrow(_blocks(basis), "block long, label long, dim int, low array<double>, high array<double>, rids binary, copies binary, vecs binary"))
    cell = lambda side, i: F.floor(F.col(side)[i] / eps)
    bounds = blocks.select("block", "label", "dim", "low", "high")
    first = bounds.withColumn("x", F.explode(F.sequence(cell("low", 0), cell("high", 0))))
    first = first.withColumn("y", F.explode(F.sequence(cell("low", 1), cell("high", 1))))
    second = bounds.withColumn("x", F.explode(F.sequence(cell("low", 0) - 1, cell("high", 0) + 1)))
    second = second.withColumn("y", F.explode(F.sequence(cell("low", 1) - 1, cell("high", 1) + 1)))
    second = second.toDF("other", "label", "dim", "low2", "high2", "x", "y")
    gap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1)), lambda i: F.greatest(F.lit(0.0), F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i])), F.lit(0.0), lambda s, g: s + g * g)
    pairs = materialise(first.join(second, ["label", "dim", "x", "y"]).where((F.col("block") <= F.col("other")) & (gap <= eps * eps)).select("block", "other").distinct())
    right = blocks.select(F.col("block").alias("other"), F.col("rids").alias("rb"), F.col("copies").alias("cb"), F.col("vecs").alias("vb"))
    left = blocks.select("block", "dim", F.col("rids").alias("ra"), F.col("copies").alias("ca"), F.col("vecs").alias("va"))
    met = pairs.join(right, "other").join(left, "block").withColumn("same", F.col("block") == F.col("other"))
    links = materialise(met.select("dim", "same", "ra", "ca", "va", "rb", "cb", "vb").mapInArrow(_joined(basis, threshold), "rid long, n long, a long, b long"))
    counts = links.groupBy("rid").agg(F.sum("n").alias("n"))
    rooted = classes.join(counts.withColumnRenamed("rid", "class"), "class", "left").join(components(links).withColumnRenamed("node", "class"), "class", "left")
    rooted = materialise(rooted.select(*same, "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(*same, "n_links", "component_id")
    found = every.select("rid", *same).join(named, same).select("rid", "n_links", "component_id")
    out = own.select("rid", "vec_id").join(found, "rid", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component).withColumn("kept", F.col("vec_id") == F.col("component_id"))
