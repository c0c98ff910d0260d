"""License scans: exact phrases, and fuzzy search for short notices.

Exact phrases are found as runs of words. For the notices of ``NOTICES`` each pattern is split into one piece
more than the errors it may have; by the pigeonhole principle one piece stands unchanged in any match,
so texts that hold no piece are skipped. Around each place of a piece the regex library's bounded-error
matching verifies the edits and gives the span. Every piece's place has a window of its own, so no match hides another; of
matches of one notice that share words, the one with the fewest edits (then the first, then the shortest) is told.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.textcore import LOWER, NON_ALNUM, buffers, chunks, word_spans

#: Fixed phrases and labels of the exact scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices (words) of the fuzzy scan, their labels, and the edits a match may have.
NOTICES = {
    "under the mit license": ("mit", 2),
    "apache license version 2": ("apache-2", 3),
    "cc by nc": ("cc-by-nc", 1),
    "released under the mit license": ("mit", 3),
    "licensed under the apache license version 2 0": ("apache-2", 4),
    "licensed under cc by nc 4 0": ("cc-by-nc", 2),
    "this work is licensed under the gnu general public license version 3": ("gpl-3", 6),
    "creative commons attribution noncommercial": ("cc-by-nc", 4),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 8),
    "mozilla public license version 2 0": ("mpl-2", 3),
}


def pieces(phrase: str, errors: int) -> list[str]:
    """Split in errors + 1 parts of nearly equal length."""
    cuts = [round(i * len(phrase) / (errors + 1)) for i in range(errors + 2)]
    return [phrase[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def _patterns():
    import ahocorasick
    import regex

    machine = ahocorasick.Automaton()
    found: dict[str, list[tuple[int, int]]] = {}
    compiled = []
    for k, (phrase, (_, errors)) in enumerate(NOTICES.items()):
        at = 0
        for piece in pieces(phrase, errors):
            found.setdefault(piece, []).append((k, at))
            at += len(piece)
        compiled.append(regex.compile(f"(?b)(?:{regex.escape(phrase)}){{e<={errors}}}"))
    for piece, where in found.items():
        machine.add_word(piece, (piece, where))
    machine.make_automaton()
    return machine, compiled


def fuzzy(words: str, begins: list[int] | None = None) -> list[tuple[int, int, int, str, int]]:
    """Matches of NOTICES in space-joined lower-case words: (first word, last word, edits, label, notice)."""
    machine, compiled = _patterns()
    names = list(NOTICES)
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (piece, where) in machine.iter(words):
        begin = end + 1 - len(piece)
        for k, at in where:
            errors = NOTICES[names[k]][1]
            windows.setdefault(k, set()).add((max(0, begin - at - errors), min(len(words), begin - at + len(names[k]) + errors)))
    if not windows:
        return []
    begins = word_begins(words) if begins is None else begins
    out = []
    for k, spans in windows.items():
        met = {}
        for lo, hi in spans:
            m = compiled[k].search(words, lo, hi)
            if m:
                a, b = m.span()
                a, b = a + (words[a] == " "), b - (words[b - 1] == " ")
                edits = sum(m.fuzzy_counts)
                if b > a and edits < met.get((a, b), (99,))[0]:
                    met[a, b] = (edits, bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1)
        found = sorted((first, edits, last) for edits, first, last in met.values())
        out += [(first, last, edits, NOTICES[names[k]][0], k) for first, edits, last in apart(found)]
    return sorted(out)


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches (first word, edits, last word) that share words, in runs, the best; then the best of those it leaves free."""
    out, run, end = [], [], -1
    for m in [*found, None]:
        if m is None or m[0] > end:
            for best in sorted(run, key=lambda x: (x[1], x[0], x[2])):
                if all(best[2] < x[0] or best[0] > x[2] for x in out[-len(run) :]):
                    out.append(best)
            run, end = [], -1
        if m is not None:
            run.append(m)
            end = max(end, m[2])
    return out


def word_begins(words: str) -> list[int]:
    """Places of the first letters of space-joined words."""
    out, at = [0], words.find(" ")
    while at >= 0:
        out.append(at + 1)
        at = words.find(" ", at + 1)
    return out


def scan_text(words: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, str, int]]]:
    """Exact places (first word, label) and fuzzy matches of one text, in time that grows with its length."""
    base, begins = [], None
    padded = f" {words} "
    for phrase, label in PHRASES.items():
        needle = f" {phrase} "
        at = padded.find(needle)
        while at >= 0:
            begins = word_begins(words) if begins is None else begins
            base.append((bisect_right(begins, at) - 1, label))
            at = padded.find(needle, at + 1)
    return sorted(base), fuzzy(words, begins)


def _normal(text: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of each document joined by a space: bytes, offsets and word counts."""
    lowered = LOWER[text]
    starts, ends, offsets = word_spans(lowered, bounds, NON_ALNUM)
    keep = ~NON_ALNUM[lowered]
    owner = np.searchsorted(offsets, np.arange(len(starts)), "right") - 1
    follow = np.zeros(len(starts), bool)
    follow[:-1] = owner[1:] == owner[:-1]
    gap = ends[follow]
    keep[gap] = True
    out = lowered.copy()
    out[gap] = 0x20
    size = np.concatenate([[0], np.cumsum(keep)])
    return out[keep].tobytes(), size[bounds], np.diff(offsets)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,edits:int,label:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """License notices in each whole text (doc_id, text; null texts count as empty).

    Returns doc_id, n_words, n_base (exact places), first_word and last_word (smallest and largest
    start of one; else null), base_labels, labels (with those of fuzzy matches; sorted, comma-joined), score
    (1 with an exact place, else 1 - edits / length of the best fuzzy match, else 0) and spans of
    fuzzy matches in words. Notices may stand in one another ("under the mit license" in "released under the mit license"); each is told. One row for each input row; repeated rows are each scanned.
    """
    names = list(NOTICES)

    def run(batches):
        machine, _ = _patterns()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            counts, rows = [], []
            for a, b in chunks(offsets):
                data, bounds, n_words = _normal(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts.append(n_words)
                cuts = bounds.tolist()
                for i in range(b - a):
                    words = data[cuts[i] : cuts[i + 1]].decode("utf-8", "surrogateescape")
                    base, near = scan_text(words)
                    exact = {x for _, x in base}
                    best = 1.0 if base else max((1 - m[2] / len(names[m[4]]) for m in near), default=0.0)
                    rows.append((len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(exact)), ",".join(sorted(exact | {m[3] for m in near})), best, [{"first": m[0], "last": m[1], "edits": m[2], "label": m[3]} for m in near]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("label", pa.string())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64) if counts else [], pa.int64()), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
