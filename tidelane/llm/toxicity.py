"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, or plain. Small transducers read
the symbols of a clause side by side; their product is one deterministic automaton whose output
says of each insult or threat in which pattern it stands: reported (a verb of saying before it in the clause), negated
(a negation in the ``REACH_NEGATION`` words before it), aimed (a target in the ``REACH_TARGET`` words before it, or
after it with no other match between), or bare. Weights of insults come from labelled texts: words, and word beginnings for inflected
or compounded forms, that occur in toxic texts far more often than in others. Nothing but matched clauses is
scored: logistic regression with weights of 0 or more over three nested tiers (all matches, asserted ones, aimed ones),
so the same clause scores highest when aimed, less when bare, least when negated or reported.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.labelled import FIT_ROWS, held_out, lasso_logistic, sample, sigmoid
from tidelane.llm.shared import materialise
from tidelane.llm.textcore import LOWER, NON_ALNUM, buffers, chunks, word_codes, word_spans

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Contractions stand here by the part before their apostrophe, as words are cut there.
WORDS = {
    THREAT: "kill hurt destroy beat stab shoot burn töten vernichten schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar",
    TARGET: "you your yours ya he she they him them her his their du dich dir euch ihr sie er tu te toi vous il elle ils elles usted ustedes ti tú él ella ellos",
    NEGATION: "not no never nobody cannot without isn aren wasn weren don doesn didn won wouldn shouldn ain nicht kein keine keinen nie niemals ohne pas jamais aucun sans nunca jamás ningún sin",
    REPORT: "said says say called calls claimed wrote quoted reported sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
}
PATTERNS = ["bare", "aimed", "negated", "reported"]
BARE, AIMED, NEGATED, REPORTED = range(4)
#: Words before an insult or threat that a target and a negation reach; words after it that a target may follow in.
REACH_TARGET, REACH_NEGATION = 5, 4
#: Bytes of the word beginnings whose share in toxic texts is learned.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
LEXICON = 4000
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?;:\n"]] = True


# Transducers: step(state, symbol) -> state. A window of k words is k states.
def _seen(symbol: int):
    return lambda state, s: 1 if s == symbol else state


def _window(symbols: tuple[int, ...], width: int):
    return lambda state, s: width if s in symbols else max(state - 1, 0)


_TARGET, _NEGATED, _REPORTED = _window((TARGET,), REACH_TARGET), _window((NEGATION,), REACH_NEGATION), _seen(REPORT)
_HIT = _window((INSULT, THREAT), REACH_TARGET)
#: Output of the product automaton for a target that follows a bare match and so aims it.
AIM_LAST = 4


@cache
def step(state: tuple[int, int, int, int], symbol: int) -> tuple[tuple[int, int, int, int], int]:
    """The product automaton: next state and output. An insult or threat gives its pattern; a target soon after a bare one gives AIM_LAST; else -1."""
    target, negated, reported, hit = state
    after = [_TARGET(target, symbol), _NEGATED(negated, symbol), _REPORTED(reported, symbol), _HIT(hit, symbol)]
    if symbol in (INSULT, THREAT):
        out = REPORTED if reported else NEGATED if negated else AIMED if target else BARE
        if out != BARE:
            after[3] = 0
        return tuple(after), out
    if symbol == TARGET and hit:
        after[3] = 0
        return tuple(after), AIM_LAST
    return tuple(after), -1


def match(symbols: list[int], gaps: list[int]) -> list[int]:
    """Pattern of each insult or threat of one clause: ``symbols`` other than plain, each after ``gaps`` plain words."""
    found: list[int] = []
    state = (0, 0, 0, 0)
    for symbol, gap in zip(symbols, gaps, strict=True):
        for _ in range(min(gap, REACH_TARGET)):
            state, _ = step(state, PLAIN)
        state, out = step(state, symbol)
        if out == AIM_LAST:
            found[-1] = AIMED
        elif out >= 0:
            found.append(out)
    return found


class Lexicon:
    """Symbols and weights of words, and weights of word beginnings."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.word = {w.encode(): (symbol, 1.0) for symbol, text in WORDS.items() for w in text.split()} | {k.encode(): (INSULT, w) for k, w in words.items()}
        self.begin = {k.encode(): w for k, w in beginnings.items()}
        self.heads = {k[: BEGINNINGS[0]] for k in self.begin}

    def of(self, word: bytes) -> tuple[int, float]:
        symbol, weight = self.word.get(word, (PLAIN, 0.0))
        if word[: BEGINNINGS[0]] in self.heads:
            for n in BEGINNINGS:
                found = self.begin.get(word[:n], 0.0) if len(word) >= n else 0.0
                if found > weight:
                    symbol, weight = INSULT, found
        return symbol, weight

    def look_up(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, words = word_codes(text, starts, ends)
        found = list(map(self.of, words))
        return np.array([s for s, _ in found], np.int8)[codes], np.array([w for _, w in found], float)[codes]


#: Tiers of matches: all; those asserted (bare or aimed); those aimed. What is told of each tier: its weightiest match, sums, and sums in 100 words.
TIERS = [(BARE, AIMED, NEGATED, REPORTED), (BARE, AIMED), (AIMED,)]
TOLD = ["most", "sum", "strong", "rate", "strong_rate"]
FEATURES = [f"{told}_{tier}" for tier in ("any", "asserted", "aimed") for told in TOLD]
#: Matches above this weight count as strong.
STRONG = 2.5


def lower(text: np.ndarray) -> np.ndarray:
    """ASCII and two-byte Latin-1 letters in lower case."""
    out = LOWER[text]
    if len(out) > 1:
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97))
        out[at + 1] += 0x20
    return out


def matches(text: np.ndarray, bounds: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, pattern and weight of each match of a slice, and the documents' word counts."""
    lowered = lower(text)
    starts, ends, offsets = word_spans(lowered, bounds, NON_ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.diff(offsets)
    symbol, weight = lexicon.look_up(lowered, starts, ends)
    event = np.flatnonzero(symbol)
    owner = np.searchsorted(offsets, event, "right") - 1
    clause = np.cumsum(_STOPS[lowered])[starts[event]] if len(event) else np.zeros(0, np.int64)
    new = np.ones(len(event), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (clause[1:] != clause[:-1])
    number = np.cumsum(new) - 1
    hit = (symbol[event] == INSULT) | (symbol[event] == THREAT)
    # only clauses with an insult or a threat go through the automaton
    live = np.zeros(int(new.sum()), bool)
    live[number[hit]] = True
    keep = live[number]
    event, owner, new, hit = event[keep], owner[keep], new[keep], hit[keep]
    gap = np.diff(event, prepend=0) - 1
    gap[new] = 0
    cuts = np.append(np.flatnonzero(new), len(event)).tolist()
    symbols, gaps = symbol[event].tolist(), gap.tolist()
    pattern = [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in match(symbols[a:b], gaps[a:b])]
    return owner[hit], np.array(pattern, np.int64), weight[event[hit]], np.diff(offsets)


def features(text: np.ndarray, bounds: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each document of a slice. All come from matched clauses; later tiers stand in the earlier ones with a share, so that
    with weights of 0 or more a negated or reported match never counts as much as a bare one, nor that as much as an aimed one."""
    owner, pattern, weight, n_words = matches(text, bounds, lexicon)
    n, scale = len(bounds) - 1, 100 / np.maximum(n_words, 1)
    told = []
    for tier in TIERS:
        mine = np.isin(pattern, tier)
        who, w = owner[mine], weight[mine]
        most = np.zeros(n)
        np.maximum.at(most, who, w)
        total, strong = np.bincount(who, w, n), np.bincount(who, np.maximum(w - STRONG, 0), n)
        told.append(np.stack([most, np.log1p(total), np.log1p(strong), np.minimum(total * scale, 50) / 10, np.minimum(strong * scale, 50) / 10], 1))
    every, asserted, aimed = told
    return np.hstack([every + SHARE * (asserted + aimed), asserted + SHARE * aimed, aimed])


#: Bytes of text matched at a time.
SLICE = 1 << 20
#: Share of a tier's value that the tiers that hold it take on.
SHARE = 0.25


def learn_lexicons(table: DataFrame) -> list[Lexicon]:
    """From a labelled sample (text, y, half): the lexicon of half 0, of half 1, and of both. A text counts once for each item; 4 * ``LEXICON`` at most are kept."""

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                raw = lower(np.frombuffer(text.encode(), np.uint8))
                starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), NON_ALNUM)
                data, side = raw.tobytes(), 2 * half + y
                words = {data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
                count.update((w, 0, side) for w in words if len(w) <= 40)
                for n in BEGINNINGS:
                    count.update((w, n, side) for w in {w[:n] for w in words if len(w) >= n})
                count[b"", -1, side] += 1
            keys = list(count)
            sides = [pa.array([count[k] * (k[2] == s) for k in keys], pa.int64()) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), *sides], names=["item", "kind", "n0", "p0", "n1", "p1"])

    sums = [F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")]
    totals = table.select("text", "y", "half").mapInArrow(run, "item binary, kind int, n0 long, p0 long, n1 long, p1 long").groupBy("item", "kind").agg(*sums)
    pos, neg = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
    totals = materialise(totals)
    every = next(((r.p0, r.n0, r.p1, r.n1) for r in totals.where("kind < 0").collect()), (0, 0, 0, 0))
    rate = (every[0] + every[2] + 1) / (sum(every) + 2)
    # four times as often in toxic texts as in others, by chance seldom
    odds = rate / (1 - rate)
    best = totals.where((F.col("kind") >= 0) & (pos >= 3) & (pos >= 4 * odds * neg)).orderBy((pos - 4 * odds * neg).desc(), "kind", "item").limit(4 * LEXICON).collect()
    return [_lexicon(best, every, halves) for halves in ((0,), (1,), (0, 1))]


def _lexicon(best: list, every: tuple, halves: tuple[int, ...]) -> Lexicon:
    all_pos, all_neg = (sum(every[2 * h + k] for h in halves) for k in (0, 1))
    found: tuple[dict[str, float], dict[str, float]] = ({}, {})
    for r in best:
        pos, neg = sum((r.p0, r.p1)[h] for h in halves), sum((r.n0, r.n1)[h] for h in halves)
        if pos < 2 or not all_neg:
            continue
        try:
            item = bytes(r.item).decode()
        except UnicodeDecodeError:
            continue
        base = (all_pos + 0.5) / (all_neg + 0.5)
        weight = float(np.log((pos + 2 * base) / (neg + 2)) - np.log(base))
        mine = found[1 if r.kind else 0]
        if weight > 1 and len(mine) < 2 * LEXICON:
            mine[item] = weight
    return Lexicon(*found)


def _features(lexicon: Lexicon, keep: list[str]):
    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            got = [features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lexicon) for a, b in chunks(offsets, SLICE)]
            x = np.concatenate(got) if got else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, i].copy()) for i in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, rows: int = FIT_ROWS, keep: tuple[str, ...] = (), learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) and the ``keep`` columns of each row of docs.

    Learns from ``rows`` labelled rows at most outside fold 0, and from texts alone (of
    ``learn_from`` if given, else of docs); each half of
    them is weighted with the lexicon of the other. Null texts count as empty and are scored; a null
    doc_id is held out. With one class or no rows the score is the class's share (0 without rows).
    """
    table = sample(docs if learn_from is None else learn_from, labels, label, rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)).cast("int"))
    first, second, lexicon = learn_lexicons(table)
    ddl = ", ".join(f"{c} double" for c in FEATURES)
    # patterns are weighted on texts that their lexicon has not seen
    parts = [table.where(F.col("half") == h).select("y", "text").mapInArrow(_features(other, ["y"]), f"y int, {ddl}") for h, other in ((0, second), (1, first))]
    fit = parts[0].union(parts[1]).toPandas()
    x, y = fit[FEATURES].to_numpy(float), fit["y"].to_numpy(float)
    if len(y) and y.min() < y.max():
        order = np.lexsort([*x.T, y])
        scale = x.std(0) + 1e-9
        w, b0 = lasso_logistic(x[order] / scale, y[order], 1e-4, ridge=1e-4, positive=True)
        w = w / scale
    else:
        p = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        w, b0 = np.zeros(len(FEATURES)), float(np.log(p / (1 - p)))

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            p = [sigmoid(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lexicon) @ w + b0) for a, b in chunks(offsets, SLICE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(np.concatenate(p) if p else [], pa.float64())], names=["doc_id", *keep, "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)), "score double"]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
