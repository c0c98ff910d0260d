"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents are cut only where they exceed the capacity. Pieces are dealt at random into groups of
about ``GROUP``; each group is packed by best fit, longest first, then local search moves one or two pieces, or exchanges one or two for
one, between underfull bins whenever the sum of squared fills grows, so that fill
leaves the emptiest bins until they can be given up. It ends when no exchange is left or the number of bins cannot be less. Bins filled to ``CLOSED`` are final; the pieces
of the others of all groups are dealt out and packed again, until one group is left or nothing is gained.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.shared import materialise
from tidelane.llm.tokens import encoder

GROUP, CLOSED = 8192, 0.99


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; each piece, longest first, goes to the fullest bin that takes it."""
    open_bins: dict[int, list[int]] = defaultdict(list)  # by room
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[piece]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            which = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[which].append(piece)
        else:
            room, which = capacity, len(bins)
            bins.append([piece])
        room -= size
        if room:
            open_bins[room].append(which)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move or exchange pieces between underfull bins while that raises the sum of squared fills and a bin can still be given up.

    The emptiest bin gives first; each time it makes the exchange, with any fuller bin, that it loses most by. All that a bin could give back (nothing,
    or one piece) stand in one array, so that an exchange is found by a search in the sums of one or two of the giver's pieces.
    """
    fill = np.array([sum(lengths[p] for p in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    if len(bins) <= least:
        return bins
    taker, paid = _returns(bins, lengths, np.flatnonzero(fill < capacity))
    changed = True
    while changed and (fill > 0).sum() > least:
        changed = False
        for donor in sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda i: (fill[i], i)):
            while 0 < fill[donor] < capacity:
                sums = _sums([lengths[p] for p in bins[donor]])
                room = np.where((taker != donor) & (fill[taker] >= fill[donor]), capacity - fill[taker], -1)
                at = np.searchsorted(sums, paid + room, "right") - 1
                gain = np.where((room > 0) & (at >= 0), sums[at] - paid, 0)
                best = int(gain.argmax()) if len(gain) else 0
                if not len(gain) or gain[best] <= 0:
                    break
                to, back = int(taker[best]), int(paid[best])
                _exchange(bins, lengths, donor, to, int(gain[best]) + back, back)
                fill[donor] -= gain[best]
                fill[to] += gain[best]
                keep = (taker != donor) & (taker != to)
                new = _returns(bins, lengths, [i for i in (donor, to) if 0 < fill[i] < capacity])
                taker, paid = np.concatenate([taker[keep], new[0]]), np.concatenate([paid[keep], new[1]])
                changed = True
            if (fill > 0).sum() <= least:
                break
    return [b for b in bins if b]


def _returns(bins: list[list[int]], lengths: list[int], which) -> tuple[np.ndarray, np.ndarray]:
    """What each bin can give back: nothing, or one piece of each of its lengths."""
    rows = [(i, s) for i in map(int, which) for s in (0, *sorted({lengths[p] for p in bins[i]}))]
    x = np.array(rows, np.int64).reshape(-1, 2)
    return x[:, 0].copy(), x[:, 1].copy()


def _sums(sizes: list[int]) -> np.ndarray:
    """Ascending sums of one or two of the sizes."""
    seen = both = 0
    for s in sizes:
        both |= seen << s
        seen |= 1 << s
    bits = seen | both
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))


def _exchange(bins, lengths, donor: int, taker: int, given: int, back: int) -> None:
    """Move one or two pieces that sum to ``given`` from donor to taker, and one of length ``back`` (none if 0) the other way."""
    where: dict[int, int] = {}
    for p in bins[donor]:
        if lengths[p] == given:
            pieces = [p]
            break
        other = where.get(given - lengths[p])
        if other is not None:
            pieces = [p, other]
            break
        where[lengths[p]] = p
    if back:
        p = next(p for p in bins[taker] if lengths[p] == back)
        bins[taker].remove(p)
        bins[donor].append(p)
    for p in pieces:
        bins[donor].remove(p)
        bins[taker].append(p)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into pieces of ``capacity``. Null texts give the end id alone."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        coder = encoder(vocabulary, joined=False)
        end = np.array([end_id], np.int32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, ids, bounds in coder.ids(batch.column("text")):
                rows = []
                cuts = bounds.tolist()
                for i in range(b - a):
                    own = np.concatenate([ids[cuts[i] : cuts[i + 1]], end]).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((names[a + i], k, at, len(part), zlib.crc32(part), *([part.tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def pack(table: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to ``capacity``; rows of a sequence_id are gapless from offset 0.

    Other columns stay. Ties are broken by the order of rows in their group; repeated rows are packed each.
    """
    spark = table.sparkSession
    names = table.columns
    schema = T.StructType([*table.schema.fields, *(T.StructField(c, t) for c, t in (("level", T.IntegerType()), ("number", T.IntegerType()), ("bin", T.IntegerType()), ("at", T.LongType()), ("fill", T.DoubleType())))])

    def packed(level: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            lengths = group["length"].tolist()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            which, at, fill = (np.zeros(len(group), t) for t in (np.int32, np.int64, float))
            for k, b in enumerate(bins):
                ends = np.cumsum([lengths[p] for p in b])
                which[b], fill[b] = k, ends[-1] / capacity
                at[b] = ends - [lengths[p] for p in b]
            return group.drop(columns="group").assign(level=level, number=int(key[0]), bin=which, at=at, fill=fill)

        return run

    done, level, rest = None, 0, table
    n = rest.count()
    while True:
        groups = max(1, -(-n // GROUP))
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "start") if c in names], F.lit(level)), F.lit(groups)))
        out = materialise(dealt.groupBy("group").applyInPandas(packed(level), schema))
        full, rest = out.where(F.col("fill") >= CLOSED), out.where(F.col("fill") < CLOSED)
        before, n = n, rest.count()
        if groups == 1 or n > 0.9 * before or not n:
            part = out
        else:
            part, rest = full, rest.select(*names)
        done = part if done is None else done.union(part)
        if part is out:
            break
        level += 1
    sequence = (F.col("level").cast("long") * (1 << 52)) + F.col("number").cast("long") * (1 << 20) + F.col("bin")
    return done.select(*names, sequence.alias("sequence_id"), F.col("at").alias("offset"))


def best_fit_pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack doc_id and text into sequences of at most ``capacity`` ids; other columns are dropped. One row for each piece, as in ``pieces``, with sequence_id and offset."""
    return pack(materialise(pieces(docs, vocabulary, capacity, end_id)), capacity)
