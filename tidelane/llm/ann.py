"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Rows lie in shells of norm, ``STEPS`` to each halving. Within a shell vectors are scaled by its outer norm and lengthened
by one component to norm 1, so that the nearest point of a query is the one with the largest inner product, and one very
long vector doesn't crowd the others together. Each table hashes to Gaussian (2-stable) projections cut in cells of equal width.

For a query, a sample of rows tells which inner product its k-th neighbour about has. That gives the chance that a neighbour
of a shell falls in a bucket, from how the query's projections lie in the cells; buckets are visited in that order until a
neighbour is among them with the table's share of ``SUCCESS`` (where that ends is told by ``DRAWS`` neighbours drawn at random, not by listing
all buckets). A shell that cannot hold such a product is left out. The
tables' candidates are merged and ranked exactly, on the original vectors.

How many tables, projections and which width to use is chosen on the sample, by the fewest rows compared (``choose``). Rows are dealt
out by table and bucket, and queries go where a bucket they visit may be; a bucket of more than a unit of rows is split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.shared import materialise, shuffle_partitions
from tidelane.llm.textcore import U64, mix
from tidelane.llm.vectors import common_dim, usable

#: Chance to aim at that a neighbour is among the candidates; the later ones for queries that found fewer than k rows.
SUCCESS = (0.94, 0.999)
CELLS, SHELLS, STEPS, DRAWS = 8, 64, 4, 256
#: Components of the rows that stay together (16 MB), of ``LEAST`` rows or more. Queries are sent to each group of rows they visit, so what is
#: shuffled grows with rows * queries / this. Beyond ``HOT`` such units in a table it is one row in ``HOT``, so that the list of split buckets is bounded.
UNIT, LEAST, HOT = 1 << 21, 4096, 65_536
#: Queries that a group of rows meets at a time: with more, rows are dealt once for each block of queries.
BLOCK = 65_536
#: Rows that neighbours' products and the plan are estimated on at most, and queries tried for the plan.
SAMPLE, TRIED = 8000, 48
#: Tables, projections and width tried.
PLANS = [(tables, projections, width) for tables in (1, 2, 4) for projections, width in ((8, 2.0), (12, 2.0), (8, 1.0), (12, 1.0), (8, 0.5))]


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (the rational approximation of Abramowitz and Stegun, 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = 0.3989422804014327 * np.exp(-x * x / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)



@dataclass
class Index:
    """All that a task needs: bounded by ``SAMPLE`` rows."""

    tables: int
    projections: int
    width: float
    norm: float
    sample: np.ndarray
    rank: int

    def __post_init__(self):
        rng = np.random.default_rng(17)
        dim = self.sample.shape[1]
        self.a = rng.standard_normal((self.tables * self.projections, dim + 1))
        self.b = rng.uniform(0, self.width, (self.tables, self.projections))
        self.z = rng.standard_normal((DRAWS, self.projections))
        self.edges = (np.arange(1, CELLS) - CELLS // 2) * self.width - self.b[..., None]

    def shells(self, norms: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(-STEPS * np.log2(np.maximum(norms / self.norm, 1e-300))).astype(np.int64), 0, SHELLS - 1)

    def outer(self, shell):
        """Outer norm of a shell."""
        return self.norm * 2.0 ** (-shell / STEPS)

    def buckets(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shell of each row, and its bucket in each table (cells as digits, shell on top)."""
        norms = np.sqrt((m * m).sum(1))
        shell = self.shells(norms)
        unit = m / self.outer(shell)[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1, keepdims=True)))
        f = (np.hstack([unit, rest]) @ self.a.T).reshape(-1, self.tables, self.projections)
        cell = np.clip(np.floor((f + self.b) / self.width).astype(np.int64) + CELLS // 2, 0, CELLS - 1)
        return shell, (cell * CELLS ** np.arange(self.projections)).sum(2) + shell[:, None] * CELLS**self.projections

    def products(self, q: np.ndarray) -> np.ndarray:
        """About the inner product of each query's k-th neighbour: that of the sample's row of like rank (a query's own row left out)."""
        s = q @ self.sample.T
        s[np.isclose(s, (q * q).sum(1)[:, None], rtol=1e-9) & (np.abs(self.sample[None, :, 0] - q[:, None, 0]) < 1e-12)] = -np.inf
        at = min(self.rank, s.shape[1]) - 1
        return -np.partition(-s, at, axis=1)[:, at]

    def chances(self, q: np.ndarray, product: np.ndarray, shell: int, success: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of each query: whether the shell can hold a neighbour, the chance of each cell (queries, tables, projections, cells), and, for a
        ``success``, the chance of the last bucket to visit in each table, below which a drawn neighbour's bucket seldom falls."""
        norm = np.sqrt((q * q).sum(1))
        r = product / (norm * self.outer(shell))
        able = r <= 1 + 1e-9
        r = np.clip(r, 0.0, 0.995)[:, None, None, None]
        f = ((q / norm[:, None]) @ self.a[:, :-1].T).reshape(-1, self.tables, self.projections)
        spread = np.sqrt(1 - r * r)
        below = np.concatenate([np.zeros((*f.shape, 1)), _phi((self.edges[None] - r * f[..., None]) / spread), np.ones((*f.shape, 1))], 3)
        chance = np.maximum(np.diff(below, axis=3), 1e-9)
        if success is None:
            return able, chance, None
        drawn = (r * f[:, :, None, :] + spread * self.z)  # queries, tables, draws, projections
        cell = np.clip(np.floor((drawn + self.b[:, None, :]) / self.width).astype(np.int64) + CELLS // 2, 0, CELLS - 1)
        p = np.log(np.take_along_axis(chance, cell.swapaxes(2, 3), 3)).sum(2)
        at = int((1 - self.share(success)) * DRAWS)
        return able, chance, np.exp(np.partition(p, at, axis=2)[:, :, at]) * (1 - 1e-9)

    def probe(self, chance: np.ndarray, least: float, limit: int) -> np.ndarray | None:
        """Buckets (without shell) of one query and table whose chance is ``least`` or more; None if there are more than ``limit`` on the way."""
        best = np.append(np.cumprod(chance.max(1)[::-1])[::-1], 1.0)
        codes, p = np.zeros(1, np.int64), np.ones(1)
        for j in range(self.projections):
            p = (p[:, None] * chance[j]).ravel()
            codes = (codes[:, None] + np.arange(CELLS) * CELLS**j).ravel()
            keep = p * best[j + 1] >= least * (1 - 1e-9)
            codes, p = codes[keep], p[keep]
            if len(p) > limit:
                return None
        return codes

    def visited(self, chance: np.ndarray, least: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which of the buckets (codes without shell) each query visits: chance (queries, projections, cells), least (queries)."""
        p = np.ones((len(chance), len(codes)))
        for j in range(self.projections):
            p *= chance[:, j, (codes // CELLS**j) % CELLS]
        return p >= least[:, None]

    def share(self, success: float) -> float:
        """What a table must reach for all tables together to reach ``success``."""
        return 1 - (1 - success) ** (1 / self.tables)


def like_rank(k: int, n: int, sampled: int) -> int:
    """Rank in a sample whose row is seldom nearer than the k-th of all n rows."""
    mean = k * sampled / n
    return k if sampled >= n else max(1, round(mean + np.sqrt(mean)))


def choose(sample: np.ndarray, norm: float, rank: int) -> tuple[Index, float]:
    """The plan that compares the fewest rows of the sample among those that find enough of its neighbours (else the one that finds most), and the share of rows it compares (summed over tables)."""
    best = None
    tried = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    for plan in PLANS:
        index = Index(*plan, norm, sample, rank)
        product = index.products(tried)
        shell, bucket = index.buckets(sample)
        seen, work = np.zeros((len(tried), len(sample)), bool), 0
        for s in np.unique(shell).tolist():
            able, chance, last = index.chances(tried, product, s, SUCCESS[0])
            mine = np.flatnonzero(shell == s)
            for t in range(index.tables):
                codes, at = np.unique(bucket[mine, t] % CELLS**index.projections, return_inverse=True)
                least = np.where(able, last[:, t], np.inf)
                hit = index.visited(chance[:, t], least, codes)[:, at]
                seen[:, mine] |= hit
                work += hit.sum()
        wanted = (tried @ sample.T >= product[:, None] - 1e-12) & (tried @ sample.T < (tried * tried).sum(1)[:, None] - 1e-12)
        found = (seen & wanted).sum() / max(1, wanted.sum())
        key = (found < SUCCESS[0] - 0.03, work / seen.size if found >= SUCCESS[0] - 0.03 else -found)
        if best is None or key < best[0]:
            best = (key, index, work / seen.size)
    return best[1], float(best[2])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors (little-endian doubles, none null) as rows, without a copy of a single chunk."""
    parts = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    views = [np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] :][: len(c) * dim * 8] for c in parts]
    one = views[0] if len(views) == 1 else np.concatenate(views) if views else np.zeros(0, np.uint8)
    return np.frombuffer(one.tobytes() if one.ctypes.data % 8 else one.data).reshape(-1, dim)


def grid(n: int, asks: int, dim: int) -> tuple[int, int, int]:
    """Rows of a unit, groups of rows in a table, and blocks of queries."""
    unit = max(LEAST, UNIT // dim)
    return max(unit, n // HOT), max(16, -(-n // unit)), max(1, -(-asks // BLOCK))


def _group(table: int, bucket: np.ndarray, salt: np.ndarray, groups: int) -> np.ndarray:
    return (table * groups + (mix((bucket * 65_537 + salt).astype(U64)) % U64(groups)).astype(np.int64)).astype(np.int32)


def search(table: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row of (vec_id, embedding) where ``queries`` holds.

    A query's own vec_id is never its neighbour. Ranks go by inner product (double), ties by smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components, null vec_ids, and vectors
    of another length than the commonest take no part. Rows that repeat a vec_id count once, the one whose vector (as little-endian bytes) sorts first.
    """
    return search_with_share(table, queries, k)[0]


def search_with_share(table: DataFrame, queries: Column, k: int = 20) -> tuple[DataFrame, float]:
    """As ``search``, and the share of all rows that a query is compared with, as estimated on the sample."""
    spark = table.sparkSession
    names = table.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), queries.alias("asks"), "embedding")
    base = materialise(usable(names, "vec_id", "asks").groupBy("vec_id", "dim").agg(F.min(F.struct("vec", "asks")).alias("x")).select("vec_id", "dim", "x.vec", "x.asks"))
    out = "query_id long, rank int, vec_id long, score double"
    dim = common_dim(base)
    if not dim:
        return spark.createDataFrame([], out), 0.0
    base = base.where(F.col("dim") == dim)
    n, n_asks, norm, sample = _shape(base, dim)
    if n < 2:
        return spark.createDataFrame([], out), 0.0
    index, share = choose(sample, norm, like_rank(k, n, len(sample)))
    unit, groups, blocks = grid(n, n_asks, dim)
    digits = CELLS**index.projections
    span = digits * SHELLS

    def count(batches):
        for batch in batches:
            b = index.buckets(_matrix(batch.column("vec"), dim))[1] + np.arange(index.tables) * span
            values, counts = np.unique(b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["bucket", "n"])

    counted = materialise(base.select("vec").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    shells = sorted(r[0] for r in counted.select((F.pmod("bucket", F.lit(span)) / digits).cast("int")).distinct().collect())
    big = counted.where(F.col("n") > unit).collect()
    salts = {r.bucket: -(-r.n // unit) for r in big}  # at most HOT of a table
    hot = np.array(sorted(salts), np.int64)
    parts = np.array([salts[h] for h in hot.tolist()], np.int64)

    def split(t, bucket):
        if not len(hot):
            return np.ones(len(bucket), np.int64)
        key = bucket + t * span
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        return np.where(hot[at] == key, parts[at], 1)

    def dealt(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            b = index.buckets(_matrix(batch.column("vec"), dim))[1]
            for t in range(index.tables):
                salt = (mix(ids.astype(U64)) % split(t, b[:, t]).astype(U64)).astype(np.int64)
                part = _group(t, b[:, t], salt, groups).astype(np.int64) * blocks
                for block in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(part + block), batch.column("vec_id"), batch.column("vec"), pa.array(b[:, t].copy())], names=["part", "vec_id", "vec", "bucket"])

    def asked(success: float):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    ids, vecs = part.column("query_id").to_pylist(), part.column("vec").to_pylist()
                    q = _matrix(part.column("vec"), dim)
                    product = index.products(q)
                    least = np.full((len(q), len(shells), index.tables), np.inf)
                    where = [[] for _ in ids]
                    for j, s in enumerate(shells):
                        able, chance, last = index.chances(q, product, s, success)
                        least[able, j] = last[able]
                        for i in np.flatnonzero(able).tolist():
                            for t in range(index.tables):
                                codes = index.probe(chance[i, t], least[i, j, t], 4 * groups + 4096)
                                if codes is None:
                                    where[i].append(np.arange(t * groups, (t + 1) * groups, dtype=np.int32))
                                    continue
                                visit = codes + s * digits
                                times = split(t, visit)
                                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                                where[i].append(np.unique(_group(t, np.repeat(visit, times), salt, groups)))
                    for i, found in enumerate(where):
                        to = (np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)).astype(np.int64) * blocks + int(mix(np.array([ids[i]]).astype(U64))[0] % U64(blocks))
                        m = len(to)
                        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array([ids[i]] * m, pa.int64()), pa.array([vecs[i]] * m, pa.binary()), pa.array([least[i].tobytes()] * m, pa.binary()), pa.array(np.full(m, product[i]))], names=["part", "query_id", "vec", "least", "product"])

        return run

    def ranked(key, rows: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asks.num_rows:
            t = key[0].as_py() // blocks // groups
            m, ids = _matrix(rows.column("vec"), dim), rows.column("vec_id").to_numpy()
            buckets, at = np.unique(rows.column("bucket").to_numpy(), return_inverse=True)
            shell, codes = buckets // digits, buckets % digits
            for lo in range(0, asks.num_rows, 64):
                part = asks.slice(lo, 64)
                q, product = _matrix(part.column("vec"), dim), part.column("product").to_numpy()
                visit = np.ones((len(q), len(buckets)), bool)
                if part.column("least").null_count == 0:
                    least = np.frombuffer(b"".join(part.column("least").to_pylist())).reshape(len(q), len(shells), index.tables)
                    for s in np.unique(shell).tolist():
                        mine = shell == s
                        _, chance, _ = index.chances(q, product, s)
                        visit[:, mine] = index.visited(chance[:, t], least[:, shells.index(s), t], codes[mine])
                rough = q @ m.T if visit.mean() > 0.02 else None
                for i, ask in enumerate(part.column("query_id").to_pylist()):
                    mine = np.flatnonzero(visit[i][at] & (ids != ask))
                    if len(mine):
                        best, score = top(m, ids, q[i], k, mine, None if rough is None else rough[i, mine])
                        found.append((ask, best.tobytes(), score.tobytes()))
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["query_id", "ids", "scores"])

    def merged(batches):
        asks, ids, scores = [], [], []
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            ids += own
            scores += [np.frombuffer(x) for x in batch.column("scores").to_pylist()]
            asks.append(np.repeat(batch.column("query_id").to_numpy(), [len(x) for x in own]))
        if not ids:
            return
        asks, ids, scores = np.concatenate(asks), np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((ids, -scores, asks))
        asks, ids, scores = asks[order], ids[order], scores[order]
        keep = np.ones(len(asks), bool)
        keep[1:] = (asks[1:] != asks[:-1]) | (ids[1:] != ids[:-1])
        asks, ids, scores = asks[keep], ids[keep], scores[keep]
        first = np.flatnonzero(np.diff(asks, prepend=asks[0] - 1))
        rank = np.arange(len(asks)) - np.repeat(first, np.diff(np.append(first, len(asks)))) + 1
        ok = rank <= k
        yield pa.RecordBatch.from_arrays([pa.array(asks[ok]), pa.array(rank[ok].astype(np.int32)), pa.array(ids[ok]), pa.array(scores[ok])], names=["query_id", "rank", "vec_id", "score"])

    rows = base.select("vec_id", "vec").mapInArrow(dealt, "part long, vec_id long, vec binary, bucket long")
    todo = base.where("asks").select(F.col("vec_id").alias("query_id"), "vec")
    ask = "part long, query_id long, vec binary, least binary, product double"
    done = None
    # a query whose buckets hold fewer rows than there are to find visits more, at last all of one table
    for success in (*SUCCESS, None):
        if success is None:
            asks = todo.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).select((F.col("group").cast("long") * blocks + F.pmod(F.xxhash64("query_id"), F.lit(blocks))).alias("part"), "query_id", "vec", F.lit(None).cast("binary").alias("least"), F.lit(0.0).alias("product"))
        else:
            asks = todo.mapInArrow(asked(success), ask)
        near = rows.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(ranked, "query_id long, ids binary, scores binary")
        found = materialise(near.repartition(shuffle_partitions(spark), "query_id").mapInArrow(merged, out))
        full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
        part = found if success is None else found.join(full, "query_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = materialise(todo.join(full, "query_id", "left_anti"))
        if todo.isEmpty():
            break
    return done, share


def top(m: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, mine: np.ndarray, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k nearest of the rows ``mine``, ties to the smaller id. Products that count are summed row by row, so that equal rows get equal scores."""
    if rough is None:
        rough = m[mine] @ q
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        slack = 1e-12 * np.sqrt((q * q).sum()) * np.sqrt((m * m).sum(1).max())
        mine = mine[rough >= edge - slack]
    score = (m[mine] * q).sum(1)
    order = np.lexsort((ids[mine], -score))[:k]
    return ids[mine][order], score[order]


def _shape(base: DataFrame, dim: int) -> tuple[int, int, float, np.ndarray]:
    """Row count, number of queries, largest norm, and a sample of at most 2 * ``SAMPLE`` rows."""

    def norms(batches):
        for batch in batches:
            m = _matrix(batch.column("vec"), dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.sqrt((m * m).sum(1)))], names=["norm"])

    row = base.select("vec").mapInArrow(norms, "norm double").agg(F.count("*"), F.max("norm")).first()
    n, norm = int(row[0]), float(row[1])
    asks = base.where("asks").count()
    rate = min(1.0, SAMPLE / n)
    picked = base.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("vec").orderBy("vec").limit(2 * SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r.vec) for r in picked)).reshape(-1, dim)
    if not len(sample):
        sample = np.frombuffer(bytes(base.select("vec").first().vec)).reshape(1, dim)
    return n, asks, norm, sample
