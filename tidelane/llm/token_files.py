"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word is a selector in its top four bits and 60 bits of equally wide values. Selectors
1 to 14 are the (count, width) of ``LAYOUT``. Selector 0 is an escape: the word after it is one raw
64-bit value (for values of 2**60 and more). Values are coded in blocks of ``BLOCK``; a word never
crosses a block, and each block's first word is listed, so any block decodes alone. Escapes are
listed too: raw words are never taken for selectors, and all words of one selector decode with
one shift and mask.

A payload is, little-endian: ``S8B1``, uint32 block size, uint64 number of values, uint32 numbers of
blocks and of escapes, uint64 number of words, uint32 first words of blocks, uint32 places of escapes,
the words. Files are tables of records (shard, seq, ids of the shard before it, doc_ids, lengths, payload); records of ascending
(shard, seq) hold documents in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.shared import shuffle_partitions, text_bytes
from tidelane.llm.textcore import U64
from tidelane.llm.tokens import encoder

BLOCK = 1024
RECORD = 1 << 20
LAYOUT = [(0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in LAYOUT], np.int64)
_HEAD = struct.Struct("<4sIQIIQ")


def pack(values: np.ndarray) -> bytes:
    """Values (any unsigned integers) as a payload."""
    values = values.astype(U64)
    n = len(values)
    blocks = -(-n // BLOCK)
    edges = np.array([1 << b for _, b in LAYOUT[1:]], U64)
    level = np.searchsorted(edges, values, "right").astype(np.int8)  # LAYOUT[level + 1] is the narrowest that fits; 14: none does
    # the best selector at each place: the narrowest whose whole run fits and stays in the block
    left = BLOCK - np.arange(n) % BLOCK
    left = np.minimum(left, n - np.arange(n))
    choice = np.zeros(n, np.int8)
    highest = {1: level}
    size = 1
    while size < 64:
        have = highest[size]
        wide = have.copy()
        if n > size:
            wide[:-size] = np.maximum(have[:-size], have[size:])
        highest[size * 2] = wide
        size *= 2

    def run_level(count: int) -> np.ndarray:
        half = 1 << (count.bit_length() - 1)
        top = highest[half]
        out = top.copy()
        shift = count - half
        if shift and n > shift:
            out[:-shift] = np.maximum(top[:-shift], top[shift:])
        return out

    for selector in range(len(LAYOUT) - 1, 0, -1):
        count = LAYOUT[selector][0]
        ok = (left >= count) & (run_level(count) <= selector - 1)
        choice[ok] = selector
    # all blocks walk together, one word each a step
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(at + BLOCK, n)
    where = []
    while len(at):
        where.append(at)
        at = at + np.maximum(_COUNT[choice[at]], 1)
        live = at < end
        at, end = at[live], end[live]
    where = np.sort(np.concatenate(where)) if where else np.zeros(0, np.int64)
    selectors = choice[where].astype(np.int64)
    extra = (selectors == 0).astype(np.int64)
    place = np.arange(len(where)) + np.cumsum(extra) - extra
    words = np.zeros(len(where) + int(extra.sum()), U64)
    for selector in range(1, len(LAYOUT)):
        count, bits = LAYOUT[selector]
        mine = np.flatnonzero(selectors == selector)
        if not len(mine):
            continue
        word = np.full(len(mine), selector << 60, U64)
        for k in range(count):
            word |= values[where[mine] + k] << U64(k * bits)
        words[place[mine]] = word
    escapes = place[selectors == 0]
    words[escapes + 1] = values[where[selectors == 0]]
    first = place[np.searchsorted(where, np.arange(blocks) * BLOCK)] if blocks else np.zeros(0, np.int64)
    return _HEAD.pack(b"S8B1", BLOCK, n, blocks, len(escapes), len(words)) + first.astype("<u4").tobytes() + escapes.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _parts(payload: bytes):
    magic, block, n, blocks, escapes, words = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    at = _HEAD.size
    first = np.frombuffer(payload, "<u4", blocks, at)
    raw = np.frombuffer(payload, "<u4", escapes, at + 4 * blocks)
    return block, n, first, raw, np.frombuffer(payload, "<u8", words, at + 4 * (blocks + escapes))


def _decode(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> U64(60)).astype(np.int64)
    selectors[raw + 1] = 0  # a raw value, whatever its top bits
    counts = _COUNT[selectors]
    counts[raw] = 1
    begin = np.cumsum(counts) - counts
    out = np.zeros(n, U64)
    for selector in range(1, len(LAYOUT)):
        count, bits = LAYOUT[selector]
        mine = np.flatnonzero(selectors == selector)
        mask = U64((1 << bits) - 1)
        for k in range(count if len(mine) else 0):
            out[begin[mine] + k] = (words[mine] >> U64(k * bits)) & mask
    out[begin[raw]] = words[raw + 1]
    return out


def unpack(payload: bytes) -> np.ndarray:
    _, n, _, raw, words = _parts(payload)
    return _decode(words, raw.astype(np.int64), n)


def unpack_block(payload: bytes, block: int) -> np.ndarray:
    """One block, without decoding the others."""
    size, n, first, raw, words = _parts(payload)
    lo = int(first[block])
    hi = int(first[block + 1]) if block + 1 < len(first) else len(words)
    own = raw[(raw >= lo) & (raw < hi)].astype(np.int64) - lo
    return _decode(words[lo:hi], own, min(size, n - block * size))


_RECORD = "shard int, seq int, inside long, n_values long, doc_ids binary, lengths binary, payload binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode doc_id and text, append ``end_id`` to each document and write files in ascending doc_id order.

    Null texts give the end id alone. Null doc_ids come last; rows of one doc_id are ordered by a hash of their text, then by
    text. Shards are Spark's range partitions of (doc_id, hash), so equal or null doc_ids are spread over several. Spark commits the files, so a
    lost executor leaves none half written.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    shards = max(2 * shuffle_partitions(spark), -(-text_bytes(docs) // (32 << 20)))

    def encoded(batches):
        coder = encoder(vocabulary, joined=True)
        shard, seq, inside, held, ids, lengths, documents = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def record():
            payload = pack(np.concatenate(ids))
            row = ((shard, pa.int32()), (seq, pa.int32()), (inside, pa.int64()), (held, pa.int64()), (np.concatenate(documents).tobytes(), pa.binary()), (np.concatenate(lengths).astype("<u4").tobytes(), pa.binary()), (payload, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["shard", "seq", "inside", "n_values", "doc_ids", "lengths", "payload"])

        for batch in batches:
            names = batch.column("doc_id").to_numpy()
            for a, b, found, bounds in coder.ids(batch.column("text")):
                out = np.full(len(found) + b - a, end_id, np.int64)
                keep = np.ones(len(out), bool)
                keep[bounds[1:] + np.arange(b - a)] = False
                out[keep] = found
                ids.append(out)
                lengths.append(np.diff(bounds) + 1)
                documents.append(names[a:b].astype("<i8"))
                held += len(out)
                if held >= RECORD:
                    yield record()
                    seq, inside, held, ids, lengths, documents = seq + 1, inside + held, 0, [], [], []
        if held:
            yield record()

    dealt = docs.repartitionByRange(shards, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    dealt.mapInArrow(encoded, _RECORD).write.option("compression", "zstd").parquet(path)


#: Shards (of some 32 MB of text) whose starts are small enough to be broadcast: 16 MB.
FEW = 1_000_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of token files, with the number of ids before each. Payloads aren't shuffled while there are up to ``FEW`` shards."""
    records = spark.read.schema(_RECORD).parquet(path)
    shards = records.groupBy("shard").agg(F.sum("n_values").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # one row a shard
    before = F.broadcast(before) if shards.count() <= FEW else before.hint("merge")
    return records.join(before, "shard").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def documents(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of each document's ids as little-endian uint32, decoded from the records. A null doc_id is null again."""

    def run(batches):
        for batch in batches:
            for doc_ids, lengths, payload, start in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "payload", "start")), strict=True):
                ids = unpack(payload).astype("<u4")
                size = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(size)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(doc_ids, "<i8")), pa.array(start + ends - size), pa.array(size), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = records.select("doc_ids", "lengths", "payload", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")))


def contents(records: DataFrame) -> DataFrame:
    """doc_id and ids (array<long>) of each document, decoded from the records."""

    def run(batches):
        for batch in batches:
            for doc_ids, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "payload")), strict=True):
                ends = np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))
                ids = unpack(payload).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(doc_ids, "<i8")), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return records.select("doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, ids array<long>").withColumn("doc_id", F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")))
