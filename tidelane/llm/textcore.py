"""Vectorised text kernels over Arrow buffers: word spans, span hashes, shingles.

Everything works on slices of whole documents of a few MB, so memory stays bounded
whatever the batch; a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 4 << 20

#: Bytes between words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes between words made of ASCII letters, digits and everything outside ASCII.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[0:0x30] = NON_ALNUM[0x3A:0x61] = NON_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if where is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(text: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run without separators that lies in one document, and the n + 1 word offsets of the documents."""
    word = ~separators[text]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    at = inner[inner < len(text)]
    first[at] = word[at]
    at = inner[inner > 0] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def word_codes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of each byte span (ascending, apart) in the list of distinct spans, which are told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    length = ends - starts
    if (starts[1:] == ends[:-1]).all():
        data = text[starts[0] : ends[-1]]
    else:
        edge = np.zeros(len(text) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        data = text[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    where = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    _, where, data = coded.dictionary.buffers()
    cuts, raw = np.frombuffer(where, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    return coded.indices.to_numpy().astype(np.int64), [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def strong_hashes(items: list[bytes]) -> np.ndarray:
    """64 bits of BLAKE2b of each item. Unlike a polynomial of the letters, it has no pairs of texts that anyone knows to collide."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in items]), U64)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strong 64-bit hashes of byte spans (ascending, apart); each distinct span is hashed once."""
    codes, items = word_codes(text, starts, ends)
    return strong_hashes(items)[codes] if items else np.zeros(0, U64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs in order: a mixed tree, not a polynomial."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) ^ (b * U64(0xD1B54A32D192ED03)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive words (empty if there are fewer), joined in a tree of runs of 1, 2, 4, ... words."""
    m = len(words) - n + 1
    if m <= 0 or n <= 0:
        return np.zeros(0, U64)
    out, at, size, run = np.full(m, U64(n)), 0, 1, words
    while True:
        if n & size:
            out = _pair(out, run[at : at + m])
            at += size
        if size * 2 > n:
            return out
        run = _pair(run[:-size], run[size:])
        size *= 2


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ids_or_last(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; null sorts after every id."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ids_or_last(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.int64()))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys, and each row's run number."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def cut(values: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """(key, values, more...) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at, _ = runs(keys)
    ends = np.append(at[1:], len(keys))
    cols = [values[order], *(m[order] for m in more)]
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        yield (int(keys[a]), *(c[a:b] for c in cols))
