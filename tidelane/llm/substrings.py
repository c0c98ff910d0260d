"""Exact substring deduplication with prefix-partitioned suffix trees.

A window of ``window`` words is found again by way of one of its suffixes: the one that starts at its smallest
``prefix``-word hash, its *anchor*. Equal windows have equal anchors at equal places, so a sparse suffix tree of the anchors'
suffixes (about one word in seven) holds all repeats. Words are compared by strong 64-bit hashes, never by hashes of runs.

1. *Short prefixes.* Anchors are grouped by their first ``prefix`` words; one that occurs once in all documents is a leaf
   at depth ``prefix``: no window through it can repeat, and it is finished.
2. *Longer prefixes.* The remaining suffixes are dealt out, with the words around them, by a prefix of variable length: the
   shortest run of words that is not frequent in a bounded sample, up to ``prefix`` words; where all these are frequent, the
   longest, the whole window. A group holds one row of a bucket for each distinct window at most, so a task's share fits its memory.
3. *Subtrees.* A task sorts its suffixes and takes the common prefix lengths of neighbours (``Tree``): the nodes of the group's suffix tree. Suffixes
   below a node at depth d agree in d words; the words to the left of an anchor are ordered in the same way. A window with its anchor at
   place o repeats where its suffix shares a node at depth ``window`` - o and its left context a node at depth o. Neighbouring
   repeats of a document join into maximal removed spans.

Each bucket of documents keeps only its first of equal windows before dealing, so that a passage
shared by a third of all rows costs one row a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.shared import materialise, shuffle_partitions, text_bytes
from tidelane.llm.textcore import SPACES, U64, buffers, chunks, cut, gram_hashes, ids_or_last, mix, runs, span_hashes, word_spans

#: Of each length, so many prefixes at most are taken to be frequent; and so many suffixes are sampled.
FREQUENT, SAMPLE = 1024, 100_000
#: Text of a bucket of documents, and buckets at most (from 8 TB on they grow): a prefix has one row, of some 200 bytes, in each at most.
BUCKET_BYTES, BUCKETS = 4 << 20, 1 << 21
_MANY = np.uint32(1 << 31)


@dataclass(frozen=True)
class Shape:
    window: int = 20
    prefix: int = 8


class Suffixes:
    """Windows and chosen prefixes of one slice of documents."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, shape: Shape):
        self.starts, self.ends, self.offsets = word_spans(text, bounds, SPACES)
        self.words = span_hashes(text, self.starts, self.ends)
        n, k = shape.window, shape.prefix
        self.path = gram_hashes(self.words, n)
        limit = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.at = np.flatnonzero(np.arange(len(self.path)) + n <= limit[: len(self.path)])
        if not len(self.at):
            self.fps, self.run = np.zeros(0, U64), np.zeros(0, np.int64)
            return
        grams = gram_hashes(self.words, k)
        chosen = sliding_argmin(grams, n - k + 1)[self.at]
        first, self.run = runs(chosen)
        self.fps = grams[chosen[first]]
        self.first = first
        self.anchor = chosen

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of x[i : i + width] for each i that has a whole run."""
    best, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best, have = np.where(x[a] <= x[b], a, b), have + step
    return best


def _slices(batch: pa.RecordBatch | pa.Table, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = buffers(batch.column("text"))
    for a, b in chunks(offsets, size):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _u(blob: bytes, kind=U64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _joined(column, kind=U64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


_SHORT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("fps", pa.binary()), ("buckets", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("fps", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])
_LONG = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("shapes", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])


def _short_prefixes(parts: int, shape: Shape):
    """Of each slice: the chosen prefixes once for each bucket. What repeats within the slice is known to repeat: one row says so to the others, and the buckets learn it directly."""

    def run(batches):
        for batch in batches:
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False).astype(np.uint32)
            out = [[], [], [], []]
            for a, b, text, bounds in _slices(batch, 4 << 20):
                s = Suffixes(text, bounds, shape)
                if not len(s.fps):
                    continue
                where = buckets[a:b][s.doc_of(s.at[s.first])]
                order = np.lexsort((where, s.fps))
                fps, where = s.fps[order], where[order]
                first, group = runs(fps)
                many = np.diff(np.append(first, len(fps))) > 1
                lone = first[~many]
                ask_fps = np.concatenate([fps[lone], fps[first[many]]])
                ask_where = np.concatenate([where[lone], np.full(int(many.sum()), _MANY, np.uint32)])
                for part, f, w in cut(ask_fps, (ask_fps % U64(parts)).astype(np.int64), ask_where):
                    for column, x in zip(out, (part, -1, f.tobytes(), w.tobytes()), strict=True):
                        column.append(x)
                tell = many[group]
                for bucket, f in cut(fps[tell], where[tell]):
                    for column, x in zip(out, (bucket % parts, bucket, np.unique(f).tobytes(), b""), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _SHORT.types, strict=True)], schema=_SHORT)

    return run


def _repeated_prefixes(batches):
    """Of the groups of short prefixes in this task, those with two suffixes or more, told to the buckets that asked."""
    fps, where = [], []
    for batch in batches:
        direct = np.array(batch.column("bucket").to_numpy(zero_copy_only=False)) >= 0
        if direct.any():
            d = batch.filter(pa.array(direct))
            n = d.num_rows
            yield pa.RecordBatch.from_arrays([d.column("bucket"), pa.array([0] * n, pa.int32()), d.column("fps"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_REPLY)
        fps.append(_joined(batch.column("fps").filter(pa.array(~direct))))
        where.append(_joined(batch.column("buckets").filter(pa.array(~direct)), np.uint32))
    if not fps:
        return
    fps, where = np.concatenate(fps), np.concatenate(where)
    order = np.argsort(fps, kind="stable")
    fps, where = fps[order], where[order]
    first, group = runs(fps)
    size = np.diff(np.append(first, len(fps)))
    many = np.zeros(len(first), bool)
    np.logical_or.at(many, group, where == _MANY)
    keep = ((size > 1) | many)[group] & (where != _MANY) if len(fps) else np.zeros(0, bool)
    rows = [(bucket, 0, f.tobytes(), None, None) for bucket, f in cut(fps[keep], where[keep])]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _REPLY.types, strict=True)], schema=_REPLY)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    return table[np.minimum(at, len(table) - 1)] == x


def _bucket(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return docs, ids_or_last(docs.column("doc_id"))


class Candidates:
    """Of a bucket: the windows whose anchor's prefix repeats, in order, and which of them are the bucket's first of their kind."""

    def __init__(self, docs: pa.Table, known: np.ndarray, shape: Shape):
        self.pieces, base, total = [], [], 0
        for a, _, text, bounds in _slices(docs, 4 << 20):
            s = Suffixes(text, bounds, shape)
            self.pieces.append((a, s))
            base.append(total)
            total += len(s.words)
        none = np.zeros(0, U64)
        self.words = np.concatenate([s.words for _, s in self.pieces]) if self.pieces else none
        values, counts = np.unique(np.concatenate([s.fps for _, s in self.pieces]) if self.pieces else none, return_counts=True)
        local = values[counts > 1]
        found = []
        for (a, s), start in zip(self.pieces, base, strict=True):
            if len(s.at):
                far = _member(s.fps, known)
                take = (far | _member(s.fps, local))[s.run]
                at = s.at[take]
                doc = s.doc_of(at)
                found.append((doc + a, at - s.offsets[doc], at + start, s.anchor[take] + start, s.path[at], far[s.run][take], s.fps[s.run][take]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [none, np.zeros(0, bool), none]
        self.doc, self.at, self.word, self.anchor, path, self.far, self.fps = columns
        order = np.argsort(path, kind="stable")  # rows are in (doc, place) order
        new = np.ones(len(path), bool)
        new[1:] = path[order[1:]] != path[order[:-1]]
        if not self._same(order[1:][~new[1:]], order[:-1][~new[1:]], shape.window):
            _, path = np.unique(self.words[self.word[:, None] + np.arange(shape.window)], axis=0, return_inverse=True)
            order = np.argsort(path, kind="stable")
            new[1:] = path[order[1:]] != path[order[:-1]]
        self.first = np.zeros(len(path), bool)
        self.first[order[new]] = True

    def _same(self, a: np.ndarray, b: np.ndarray, window: int) -> bool:
        """Windows that share a hash share their words."""
        return all((self.words[self.word[a] + k] == self.words[self.word[b] + k]).all() for k in range(window))


def _route(words: np.ndarray, start: np.ndarray, frequent: list[np.ndarray], prefix: int) -> np.ndarray:
    """Hash of each suffix's shortest prefix that isn't frequent (its first ``prefix`` words, if all are)."""
    group = np.zeros(len(start), U64)
    todo = np.arange(len(start))
    for k in range(1, prefix + 1):
        label = gram_hashes(words, k)[start[todo]]
        group[todo] = label
        if k > len(frequent):
            break
        todo = todo[_member(label, frequent[k - 1])]
        if not len(todo):
            break
    return group


def frequent_prefixes(docs: DataFrame, shape: Shape) -> list[np.ndarray]:
    """Sorted hashes of the frequent prefixes by length. From ``SAMPLE`` suffixes at most, chosen by the hash of document and place, so that the table is bounded and the same for all tasks; it steers only how suffixes are dealt, never which are compared."""
    spark = docs.sparkSession
    total = max(1, docs.count())
    rate = min(1.0, SAMPLE / 8 / total)
    window = shape.prefix

    def run(batches):
        for batch in batches:
            blobs = []
            for _, _, text, bounds in _slices(batch, 4 << 20):
                starts, ends, offsets = word_spans(text, bounds, SPACES)
                words = span_hashes(text, starts, ends)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if b - a >= window:
                        picks = np.argsort(mix(np.arange(a, b - window + 1).astype(U64) ^ words[a]))[:8]
                        blobs += [words[p + a : p + a + window].tobytes() for p in picks.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["path"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("text")
    rows = [r[0] for r in chosen.mapInArrow(run, "path binary").limit(SAMPLE).collect()]
    paths = np.frombuffer(b"".join(rows), U64).reshape(-1, window)
    found = []
    for k in range(1, window + 1):
        label = np.array([gram_hashes(p[:k], k)[0] for p in paths], U64) if len(paths) else np.zeros(0, U64)
        values, counts = np.unique(label, return_counts=True)
        values = values[counts > max(2, len(rows) // FREQUENT)]
        if not len(values):
            break
        found.append(values)
        paths = paths[_member(label, values)]
    return found


def _suffixes_out(parts: int, shape: Shape, frequent: list[np.ndarray]):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, ids = _bucket(docs)
        known = np.unique(_joined(replies.column("fps")))
        c = Candidates(docs, known, shape)
        take = np.flatnonzero(c.first & c.far)
        word, anchor = c.word[take], c.anchor[take]
        alone = _member(c.fps[take], frequent[shape.prefix - 1]) if len(frequent) >= shape.prefix else np.zeros(len(take), bool)
        new = np.ones(len(take), bool)
        new[1:] = (word[1:] != word[:-1] + 1) | (anchor[1:] != anchor[:-1]) | alone[1:]
        at = np.flatnonzero(new)  # of each run of windows with one anchor
        count = np.diff(np.append(at, len(take)))
        begin, anchor = word[at], anchor[at]
        group = _route(c.words, anchor, frequent, shape.prefix)
        whole = alone[at]
        group[whole] = gram_hashes(c.words, shape.window)[begin[whole]] if whole.any() else group[whole]
        part = (mix(group) % U64(parts)).astype(np.int64)
        bucket, rows = key[0].as_py(), []
        for p, s, n, o, d, w in cut(begin, part, count, anchor - begin, ids[c.doc[take[at]]], c.at[take[at]]):
            size = n + shape.window - 1
            where = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((p, bucket, c.words[where].tobytes(), np.stack([o, n], 1).astype(np.uint8).tobytes(), d.tobytes(), w.astype(np.uint32).tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _LONG.types, strict=True)], schema=_LONG)

    return run


class Tree:
    """Sorted sequences of words (one a column of ``words``) with the common prefix lengths of neighbours."""

    def __init__(self, words: np.ndarray):
        depth, n = words.shape
        order = np.lexsort(words[::-1]) if depth else np.arange(n)
        self.common = np.zeros(n, np.int64)
        same = np.ones(max(0, n - 1), bool)
        for row in words:
            same &= row[order[1:]] == row[order[:-1]]
            self.common[1:] += same
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)

    def nodes(self, depth: int) -> np.ndarray:
        """Of each sequence, the number of its node at a depth: shared by those that agree in so many words."""
        return np.cumsum(self.common < depth)[self.place]


def repeats(words: np.ndarray, offset: np.ndarray, count: np.ndarray, doc: np.ndarray, at: np.ndarray, bucket: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Record and number of each window that isn't the first of its kind. A record is ``count`` windows in a row with one anchor, ``offset`` words after the
    first's start; ``words`` holds the records' words one after another. Windows go in the order of doc, bucket and place."""
    n, most = shape.window, shape.window - shape.prefix
    size = count + n - 1
    begin = np.cumsum(size) - size
    right, left = np.zeros((n, len(size)), U64), np.zeros((most, len(size)), U64)
    for k in range(n):
        ok = offset + k < size
        right[k, ok] = words[begin[ok] + offset[ok] + k]
    for k in range(most):
        ok = offset > k
        left[k, ok] = words[begin[ok] + offset[ok] - 1 - k]
    suffixes, contexts = Tree(right), Tree(left)
    found, which = [], []
    for o in range(most + 1):
        mine = np.flatnonzero((offset >= o) & (offset - o < count))
        if len(mine) < 2:
            continue
        key = suffixes.nodes(n - o)[mine] * (len(size) + 1) + contexts.nodes(o)[mine]
        number = offset[mine] - o
        order = np.lexsort((at[mine] + number, bucket[mine], doc[mine], key))
        again = order[1:][key[order[1:]] == key[order[:-1]]]
        found.append(mine[again])
        which.append(number[again])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(which)) if found else (none, none)


def _subtrees(shape: Shape):
    def run(batches):
        """The repeats among this task's windows, sent back to their buckets."""
        got = [[], [], [], [], []]
        for batch in batches:
            docs = batch.column("docs").to_pylist()
            got[0] += [_u(x) for x in batch.column("words").to_pylist()]
            got[1] += [_u(x, np.uint8) for x in batch.column("shapes").to_pylist()]
            got[2] += [_u(x, np.int64) for x in docs]
            got[3] += [_u(x, np.uint32) for x in batch.column("at").to_pylist()]
            got[4] += [np.full(len(d) // 8, b, np.int32) for d, b in zip(docs, batch.column("bucket").to_pylist(), strict=True)]
        if not got[0]:
            return
        words, shapes, doc, at, bucket = map(np.concatenate, got)
        offset, count = shapes.reshape(-1, 2).astype(np.int64).T
        record, number = repeats(words, offset, count, doc, at.astype(np.int64), bucket, shape)
        rows = [(b, 1, None, d.tobytes(), a.astype(np.uint32).tobytes()) for b, d, a in cut(doc[record], bucket[record], at[record] + number)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _REPLY.types, strict=True)], schema=_REPLY)

    return run


_OUT = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>"


def _removed(shape: Shape, keep: tuple[str, ...]):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, ids = _bucket(docs)
        kinds = replies.column("kind").to_numpy()
        known = np.unique(_joined(replies.column("fps").filter(pa.array(kinds == 0))))
        far = replies.filter(pa.array(kinds == 1))
        far_doc, far_at = _joined(far.column("docs"), np.int64), _joined(far.column("at"), np.uint32).astype(np.int64)
        c = Candidates(docs, known, shape)
        pieces, doc, at, first = c.pieces, c.doc, c.at, c.first
        number = np.searchsorted(ids, far_doc)
        # rows of one doc_id share a bucket, and only the first of equal windows went out: find its row among them
        if len(number) and (np.diff(ids) == 0).any():
            place = {(int(ids[d]), int(a), int(d)) for d, a in zip(doc[first], at[first], strict=True)}
            number = np.array([next((m for m in range(n, len(ids)) if ids[m] == i and (int(i), int(a), m) in place), n) for n, i, a in zip(number.tolist(), far_doc, far_at, strict=True)], np.int64)
        gone_doc, gone_at = np.concatenate([doc[~first], number]), np.concatenate([at[~first], far_at])
        texts, n_words, n_removed, spans = [], [], [], []
        for a, s in pieces:
            n = len(s.offsets) - 1
            mine = (gone_doc >= a) & (gone_doc < a + n)
            begin = s.offsets[gone_doc[mine] - a] + gone_at[mine]
            cover = np.zeros(len(s.starts) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + shape.window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            texts.append((a, s, ~gone))
            count = np.add.reduceat(np.append(gone, False), s.offsets[:-1]) * (np.diff(s.offsets) > 0)
            n_words.append(np.diff(s.offsets))
            n_removed.append(count)
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            inner = s.offsets[1:-1][(s.offsets[1:-1] > 0) & (s.offsets[1:-1] < len(gone))]
            split = inner[gone[inner] & gone[inner - 1]]
            begins, ends = np.sort(np.append(np.flatnonzero(edge == 1), split)), np.sort(np.append(np.flatnonzero(edge == -1), split))
            owner = s.doc_of(begins)
            spans.append((np.bincount(owner, minlength=n), begins - s.offsets[owner], ends - s.offsets[owner]))
        kept = pa.concat_arrays([x for (a, s, stay), part in zip(texts, _slices(docs, 4 << 20), strict=True) for x in [kept_text(part[2], s, stay)]]) if texts else pa.array([], pa.large_string())
        counts, begins, ends = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begins.astype(np.int64)), pa.array(ends.astype(np.int64))], names=["start", "end"]))
        return pa.Table.from_arrays([docs.column("doc_id").cast(pa.int64()), kept.cast(pa.string()), pa.array(np.concatenate(n_words).astype(np.int64) if n_words else [], pa.int64()), pa.array(np.concatenate(n_removed).astype(np.int64) if n_removed else [], pa.int64()), listed, *(docs.column(c) for c in keep)], names=["doc_id", "text", "n_words", "n_removed", "spans", *keep])

    return run


def kept_text(text: np.ndarray, s: Suffixes, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    n = len(s.offsets) - 1
    edge = np.zeros(len(text) + 1, np.int8)
    edge[s.starts[keep]] += 1
    edge[s.ends[keep]] -= 1
    mask = np.cumsum(edge[:-1]) > 0
    where = np.flatnonzero(keep)
    owner = s.doc_of(where)
    follow = np.zeros(len(where), bool)
    follow[:-1] = owner[1:] == owner[:-1]
    gap = s.ends[where[follow]]
    mask[gap] = True
    out = text.copy()
    out[gap] = 0x20
    length = np.bincount(owner, (s.ends - s.starts)[where] + follow, minlength=n).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out[mask]))


def dedup_substrings(docs: DataFrame, window: int = 20, prefix: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start earlier
    (smaller doc_id, or the same document further left).

    Takes doc_id and text; other columns than those of ``keep`` are ignored. Returns doc_id, text (kept words joined by one
    space), n_words, n_removed, spans (removed word ranges, end exclusive) and ``keep``, one row for each input
    row. Null texts count as empty and give empty text. Null doc_ids come last. Rows of one
    doc_id (or without) go in the order of a hash of their text, then of the text; of equal rows one is the first. Empty tables give empty results.
    """
    spark = docs.sparkSession
    shape = Shape(window, prefix)
    size = text_bytes(docs)
    n_buckets = max(64, min(BUCKETS, -(-size // BUCKET_BYTES)))
    n_parts = max(shuffle_partitions(spark), -(-size // (32 << 20)))
    docs = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = "part int, bucket int, fps binary, buckets binary"
    reply = "bucket int, kind int, fps binary, docs binary, at binary"
    asked = docs.select("bucket", "text").mapInArrow(_short_prefixes(8 * n_parts, shape), ddl)
    short = materialise(asked.repartition(n_parts, "part").mapInArrow(_repeated_prefixes, reply))
    frequent = frequent_prefixes(docs, shape)
    dealt = docs.select("bucket", "doc_id", "text", *keep).groupBy("bucket").cogroup(short.groupBy("bucket")).applyInArrow(_suffixes_out(8 * n_parts, shape, frequent), "part int, bucket int, words binary, shapes binary, docs binary, at binary")
    repeats = dealt.repartition(n_parts, "part").mapInArrow(_subtrees(shape), reply)
    schema = ", ".join([_OUT, *(f"`{c}` {kinds[c]}" for c in keep)])
    return docs.select("bucket", "doc_id", "text", *keep).groupBy("bucket").cogroup(short.union(repeats).groupBy("bucket")).applyInArrow(_removed(shape, keep), schema)
