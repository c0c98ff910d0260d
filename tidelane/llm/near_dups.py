"""MinHash near-duplicate detection: one-permutation hashing with optimal densification.

A document's set is hashed once; the top seven bits of a shingle's hash are its bin and a bin's
smallest hash its value. Empty bins borrow from a bin that a universal hash of (bin, attempt)
names, until one that isn't empty is found. ``BANDS`` bands of ``ROWS`` bins are the buckets: a
pair at similarity 0.8 shares none with probability 5e-8.

Equal sets are one *class* throughout, so copies meet once. Within a bucket candidate edges form
a star: each slice of documents links its members to its smallest class, and only that one goes
on to the bucket's global star; a bucket gives fewer edges than it has members. Edges are
confirmed on whole sets. A star can miss a link between two members that are both unlike its
centre. So in buckets that still hold several components, members of different ones whose bins agree
often enough are suspects; suspects of all buckets form families, and a family's members meet
once with their whole sets, in tiles of bounded size. No pairs are emitted, but a family of n members that stay apart is copied n / ``TILE`` times
and compared pair by pair: rows dealt grow with n * n / ``TILE``. Rows are told apart by a number of their own, never by doc_id. Joins are
hinted as sort-merge, so that plans are the same at every size: no side is broadcast while it is small
and shuffled, with whole texts, later.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.shared import components, materialise, shuffle_partitions
from tidelane.llm.textcore import LOWER, SPACES, U64, as_int64, buffers, chunks, cut, gram_hashes, mix, runs, span_hashes, word_spans

BINS, BANDS, ROWS = 128, 32, 4
#: Bins that agree at least, of 128, for a pair to go on to whole sets: at similarity 0.8 about 102 are expected and fewer than 79 have probability below 1e-6.
AGREE = 79
#: Bytes of text taken apart at a time.
SLICE = 1 << 20
#: Members of a family that one task holds of each side.
TILE = 8192
_SOURCES = np.stack([(mix(np.arange(BINS, dtype=U64) * U64(1_000_003) + U64(k + 1)) % U64(BINS)).astype(np.int64) for k in range(64)])


def document_sets(text: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word n-grams; with fewer words, of the whole sequence."""
    lowered = LOWER[text]
    starts, ends, offsets = word_spans(lowered, bounds, SPACES)
    words = span_hashes(lowered, starts, ends)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            out.append(g[keep])
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a sorted set of hashes that isn't empty."""
    where = (hashes >> U64(57)).astype(np.int64)
    first = np.ones(len(where), bool)
    first[1:] = where[1:] != where[:-1]
    bins, full = np.zeros(BINS, U64), np.zeros(BINS, bool)
    bins[where[first]], full[where[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        if attempt < len(_SOURCES):
            source = _SOURCES[attempt][empty]
        else:
            source = (mix(empty.astype(U64) * U64(1_000_003) + U64(attempt + 1)) % U64(BINS)).astype(np.int64)
        ok = full[source]
        bins[empty[ok]] = bins[source[ok]]
        empty = empty[~ok]
        attempt += 1
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """Bucket keys, one row for each document and one column for each band."""
    x = mix(bins.reshape(len(bins), BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=U64))
    return mix((x * (U64(2) * np.arange(1, ROWS + 1, dtype=U64) + U64(1))).sum(2, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0xA24BAED4963EE407))


def class_key(s: np.ndarray) -> int:
    """Strong hash of a sorted set, the same for equal sets."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(shingle: int, carried: list[str]):
    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            size, key, bands, sketch = [], [], [], []
            for a, b in chunks(offsets, SLICE):
                sets = document_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                size += [len(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                own = [None] * len(sets)
                bins = np.stack([one_permutation(sets[i]) for i in full]) if full else np.zeros((0, BINS), U64)
                keys, small = band_keys(bins), (mix(bins) >> U64(56)).astype(np.uint8)
                kb, ks = [None] * len(sets), [None] * len(sets)
                for j, i in enumerate(full):
                    s = sets[i]
                    own[i] = class_key(s)
                    kb[i], ks[i] = keys[j].tobytes(), small[j].tobytes()
                key, bands, sketch = key + own, bands + kb, sketch + ks
            made = [pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made], names=[*carried, "n_shingles", "key", "bands", "sketch"])

    return run


def _star(bucket: np.ndarray, key: np.ndarray):
    """Of each bucket its smallest key, and edges from that to the others."""
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    first, group = runs(bucket)
    centre = key[first][group]
    return bucket[first], key[first], centre, key


def _local_stars(parts: int):
    """Rows (part, buckets, keys) of each slice's centres, and (-1, a, b) of its edges."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("key").is_valid()))
            if not batch.num_rows:
                continue
            keys, at = np.unique(batch.column("key").to_numpy(), return_index=True)
            bands = np.frombuffer(b"".join(batch.column("bands").take(pa.array(at)).to_pylist()), U64)
            bucket, key, a, b = _star(bands, np.repeat(keys, BANDS))
            edges = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            out = [(-1, edges[:, 0].tobytes(), edges[:, 1].tobytes())] + [(p, x.tobytes(), k.tobytes()) for p, x, k in cut(bucket, (bucket % U64(parts)).astype(np.int64), key)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "x", "y"])

    return run


def _global_stars(batches):
    """Edges (a, b) of this task's buckets, with those that slices had found."""
    bucket, key, edges = [], [], [np.zeros((0, 2), np.int64)]
    for batch in batches:
        for part, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "y")), strict=True):
            if part < 0:
                edges.append(np.stack([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)], 1))
            else:
                bucket.append(np.frombuffer(x, U64))
                key.append(np.frombuffer(y, np.int64))
    if bucket:
        _, _, a, b = _star(np.concatenate(bucket), np.concatenate(key))
        edges.append(np.stack([a, b], 1)[a != b])
    e = np.unique(np.concatenate(edges), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])


class Tiles:
    """Rows of one task in runs of one tile pair (group, i, j); a row stands in tile ``own``."""

    def __init__(self, batches):
        rows = pa.Table.from_batches(batches)
        self.rows = rows.sort_by([("group", "ascending"), ("i", "ascending"), ("j", "ascending")]) if rows.num_rows else rows
        column = lambda c: self.rows.column(c).to_numpy()
        group, self.i, self.j, self.own, self.key, self.component, self.n = map(column, ("group", "i", "j", "own", "key", "component", "n"))
        self.sketch = np.frombuffer(b"".join(self.rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.cuts = np.append(np.flatnonzero(new), len(group)).tolist()

    def __iter__(self):
        """(first row, end row, rows of the first tile, rows of the second)."""
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            own = self.own[lo:hi]
            yield lo, hi, np.flatnonzero(own == self.i[lo]) + lo, np.flatnonzero(own == self.j[lo]) + lo

    def alike(self, p: int, others: np.ndarray) -> np.ndarray:
        """Those of other components whose size and bins allow a link with row p."""
        q = others[(self.component[others] != self.component[p]) & (self.n[others] * 5 >= self.n[p] * 4) & (self.n[p] * 5 >= self.n[others] * 4)]
        return q[(self.sketch[q] == self.sketch[p]).sum(1) >= AGREE] if len(q) else q


def _edges(pairs: list[tuple[int, int]]):
    e = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])


def _suspects(batches):
    """A spanning forest of the graph of members of different components that may be linked, for each tile pair of a bucket."""
    batches = list(batches)
    if not batches:
        return
    tiles, edges = Tiles(batches), []
    for lo, hi, left, right in tiles:
        tree = np.arange(hi - lo)
        for p in left.tolist():
            q = tiles.alike(p, right)
            if len(q):
                trees = np.unique(tree[np.append(q, p) - lo])
                if len(trees) > 1:
                    tree[np.isin(tree, trees)] = trees[0]
                    edges += [(int(tiles.key[lo + trees[0]]), int(tiles.key[lo + t])) for t in trees[1:].tolist()]
    yield _edges(edges)


def _confirmed(numerator: int):
    """Links between components in each tile pair of a family, on whole sets; two components that are linked already are not compared again."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        tiles, edges = Tiles(batches), []
        items = tiles.rows.column("items").combine_chunks() if tiles.rows.num_rows else None
        for lo, hi, left, right in tiles:
            tree = tiles.component[lo:hi].copy()
            for p in left.tolist():
                own = None
                for q in tiles.alike(p, right).tolist():
                    if tree[p - lo] == tree[q - lo]:
                        continue
                    own = items[p].values.to_numpy() if own is None else own
                    other = items[q].values.to_numpy()
                    common = common_count(own, other)
                    if common * 100 >= numerator * (len(own) + len(other) - common):
                        edges.append((int(tiles.key[p]), int(tiles.key[q])))
                        tree[tree == tree[q - lo]] = tree[p - lo]
        yield _edges(edges)

    return run


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of unsigned hashes held as signed."""
    a, b = a.view(U64), b.view(U64)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _agreeing(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
        yield batch.filter(pa.array((a == b).sum(1) >= AGREE)).select(["a", "b"])


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets, SLICE):
                sets = document_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                where = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.ListArray.from_arrays(pa.array(where), pa.array(as_int64(np.concatenate(sets)), pa.int64()))], names=["key", "items"])

    return run


_LAST = (1 << 63) - 1


def near_duplicates(docs: DataFrame, numerator: int = 80, shingle: int = 2) -> DataFrame:
    """Connected components of documents with 100 * intersection >= ``numerator`` * union of their sets of ``shingle`` words in a row (ASCII lower case).

    Takes doc_id and text, ignores other columns. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable) and kept (doc_id = component_id), one row for each input row. Texts that are
    null or without words have no shingles and are linked with nothing; fewer than ``shingle`` words are one shingle. Rows that repeat a doc_id are
    documents of their own, each returned. Null doc_ids take part; a component of only such has a null id and kept null.
    """
    out = grouped(docs, numerator, shingle)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, numerator: int = 80, shingle: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``near_duplicates``, with the ``keep`` columns of each row and first, which holds for one row of each component: the one of the
    smallest doc_id (any one of several such, or of a component without doc_ids). Rows without shingles are all first."""
    spark = docs.sparkSession
    carried = {f"c{i}": c for i, c in enumerate(keep)}
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(n) for n, c in carried.items()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    table = materialise(named.mapInArrow(_signatures(shingle, named.columns), f"{kinds}, n_shingles long, key long, bands binary, sketch binary"))
    filled = table.where("key is not null")
    parts = shuffle_partitions(spark)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "rid", "bands", "sketch"))
    classes = materialise(filled.groupBy("key").agg(first.alias("s"), F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")).select("key", "rep", "n", "s.rid", "s.rank", "s.bands", "s.sketch"))
    stars = classes.select("key", "bands").mapInArrow(_local_stars(8 * parts), "part int, x binary, y binary").repartition(parts, F.col("part"), F.when(F.col("part") < 0, F.hash("x")))
    edges = stars.mapInArrow(_global_stars, "a long, b long").distinct()
    sketches = classes.select("key", "sketch")
    edges = materialise(edges)
    met = materialise(classes.select("key", "rid").join(edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct().hint("merge"), "key", "left_semi"))
    sets = materialise(filled.select("rid", "text").join(met.hint("merge"), "rid").select("key", "text").mapInArrow(_sets(shingle), "key long, items array<long>"))
    pairs = edges.hint("merge").join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb").hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long")
    links = confirm(sets, pairs, numerator)
    found = components(links)
    # only classes that share a bucket with another can have further links
    members = classes.select("key", "n", "bands", "sketch").join(sets.select("key").hint("merge"), "key", "left_semi").join(found.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("key", "n", "bands", "sketch", F.coalesce("root", "key").alias("component"))
    rest = _across(materialise(members), sets, parts, numerator)
    if rest is not None:
        found = components(found.toDF("a", "b").union(rest))
    roots = found.withColumnRenamed("node", "key")
    rooted = materialise(classes.select("key", "rep", "rank", "rid").join(roots.hint("merge"), "key", "left").select("key", "rep", "rank", "rid", F.coalesce("root", "key").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.min(F.struct("rank", "rid")).alias("s")).select("root", "component_id", F.col("s.rid").alias("head"))
    ids = materialise(rooted.select("key", "root").join(least.hint("merge"), "root").select("key", "component_id", "head"))
    show = ["doc_id", "n_shingles", *(F.col(n).alias(c) for n, c in carried.items())]
    joined = filled.drop("bands", "sketch").join(ids.hint("merge"), "key").select(*show, "component_id", (F.col("rid") == F.col("head")).alias("first"))
    return joined.unionByName(table.where("key is null").select(*show, F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def _spread(batches):
    """Bucket rows (bucket, component) of each slice, once."""
    for batch in batches:
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        e = np.unique(np.stack([bands, np.repeat(batch.column("component").to_numpy(), BANDS)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["bucket", "component"])


def _bucket_rows(batches):
    for batch in batches:
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(bands), *(batch.column(c).take(at) for c in ("key", "component", "n"))], names=["group", "key", "component", "n"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (group, key, component, n) once for each tile pair (i, j) of their group that holds them; tiles have about ``TILE`` rows."""
    tiles = rows.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = rows.join(materialise(tiles).hint("merge"), "group").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("group", "key", "component", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _across(members: DataFrame, sets: DataFrame, parts: int, numerator: int) -> DataFrame | None:
    """Links between members of different components that share a bucket.

    Suspects (bins agree often enough) of all buckets form families; each family's members meet
    once, with their whole sets. A family of up to ``TILE`` members is dealt once, a larger one once for each of its tiles.
    """
    mixed = members.select("component", "bands").mapInArrow(_spread, "bucket long, component long").groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select(F.col("bucket").alias("group"))
    rows = members.select("key", "component", "n", "bands").mapInArrow(_bucket_rows, "group long, key long, component long, n long")
    rows = materialise(rows.join(materialise(mixed).hint("merge"), "group", "left_semi"))
    sketches = members.select("key", "sketch")
    suspects = _dealt(rows).join(sketches.hint("merge"), "key").repartition(parts, "group", "i", "j").mapInArrow(_suspects, "a long, b long")
    families = components(suspects)
    if families.isEmpty():
        return None
    rows = materialise(families.select(F.col("node").alias("key"), F.col("root").alias("group")).union(families.select("root", "root").distinct()).distinct().join(members.select("key", "component", "n"), "key").select("group", "key", "component", "n"))
    met = _dealt(rows).join(sketches.hint("merge"), "key").join(sets.hint("merge"), "key").repartition(parts, "group", "i", "j")
    return materialise(met.mapInArrow(_confirmed(numerator), "a long, b long"))


def confirm(sets: DataFrame, pairs: DataFrame, numerator: int) -> DataFrame:
    """Those (a, b) whose whole sets are similar enough."""
    met = materialise(pairs).hint("merge").join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x").hint("merge"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return materialise(met.where(common * 100 >= F.lit(numerator) * (F.size("x") + F.size("y") - common)).select("a", "b"))
