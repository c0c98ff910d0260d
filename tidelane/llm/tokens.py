"""Byte-pair encoding of whole text columns, one distinct word at a time.

Words (pre-tokens) are found on bytes with vector operations where a text holds only Latin-1
characters; in other texts, and those that may hold special tokens, by the tokenizers library's normaliser and pre-tokeniser.
Either way each distinct word is encoded once for a Python worker and looked up by its bytes after
that. The look-up table is emptied when it has ``CACHE_WORDS`` words, so memory stays bounded.

``TrieWords`` encodes words by prefix-sharing trie traversal, ``LibraryWords`` by the
tokenizers library.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tidelane.llm.textcore import buffers, chunks, word_codes

CACHE_WORDS = 400_000

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _class_of(char: str) -> int:
    kind = unicodedata.category(char)[0]
    return SPACE if char.isspace() else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


_CLASS = np.array([_class_of(chr(c)) for c in range(256)], np.uint8)
#: Bytes that send a text to the library's pre-tokeniser: controls whose class differs between regex engines, and all but two-byte Latin-1.
_SLOW = np.zeros(256, bool)
_SLOW[:9] = _SLOW[0x0E:0x20] = _SLOW[0x7F] = True
_SLOW[0xC4:] = True


def byte_alphabet() -> str:
    """Character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    spare = iter(range(0x100, 0x200))
    return "".join(chars.get(b) or chr(next(spare)) for b in range(256))


_ALPHABET = {i: c for i, c in enumerate(byte_alphabet())}


_BYTES = {ord(c): i for i, c in _ALPHABET.items()}
#: Before a special token in the table of words; no UTF-8 word begins with it.
_SPECIAL = b"\xff"


def to_alphabet(word: bytes) -> str:
    return word.decode("latin-1").translate(_ALPHABET)


def from_alphabet(word: str) -> bytes:
    return word.translate(_BYTES).encode("latin-1")


class Pretokens:
    """Word spans of a slice of Latin-1 documents.

    ``joined``: a word takes one space before it, white space is kept (byte-level vocabularies). Else
    text is lower-cased, white space goes and digits stand alone (vocabularies with word ends).
    """

    def __init__(self, text: np.ndarray, bounds: np.ndarray, joined: bool):
        n = len(text)
        head = text & 0xC0
        cont = head == 0x80
        lead = np.flatnonzero(text >= 0xC2)
        kind = _CLASS[text]
        code = ((text[lead].astype(np.int64) & 3) << 6) | (text[lead + 1] & 0x3F)
        kind[lead] = _CLASS[code]
        kind[lead + 1] = kind[lead]
        if not joined:
            text = text.copy()
            text[(text >= 0x41) & (text <= 0x5A)] += 0x20
            upper = lead[(text[lead] == 0xC3) & (text[lead + 1] >= 0x80) & (text[lead + 1] <= 0x9E) & (text[lead + 1] != 0x97)]
            text[upper + 1] += 0x20
        white = kind == SPACE
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        start = np.zeros(n, bool)
        same, before = np.zeros(n, bool), np.zeros(n, bool)
        same[1:] = kind[1:] == kind[:-1]
        before[1:] = white[:-1]
        same[fresh[:n]] = before[fresh[:n]] = False
        if joined:
            blank = np.zeros(n, bool)
            blank[1:] = text[:-1] == 0x20
            last = np.zeros(n, bool)
            last[:-1] = ~white[1:] & ~fresh[1:n]
            start = (~white & ~before & ~same) | (~white & before & ~blank) | (white & ~before) | (white & before & last)
        else:
            start = ~white & ~cont & (~same | (kind == NUMBER))
        start |= fresh[:n] & (joined | ~white)
        for a in np.flatnonzero((text == 0x27) & start).tolist():
            m = 2 if text[a + 1 : a + 3].tobytes() in (b"re", b"ve", b"ll") else 1 if a + 1 < n and text[a + 1] in b"stmd" else 0
            if m and not fresh[a + 1 : a + 1 + m].any():
                start[a + 1] = False
                if a + 1 + m < n and not white[a + 1 + m] and kind[a + 1 + m] == LETTER:
                    start[a + 1 + m] = True
        self.text = text
        self.starts = np.flatnonzero(start)
        if joined:
            self.ends = np.append(self.starts[1:], n)
        else:
            stop = start | fresh[:n] | (white & ~before)
            places = np.append(np.flatnonzero(stop), n)
            self.ends = places[np.searchsorted(places, self.starts, "right")]
        self.offsets = np.searchsorted(self.starts, bounds)


class LibraryWords:
    """Encodes single words with the tokenizers library."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(to_alphabet(w))] for w in words]


class TrieWords:
    """Encodes distinct words by depth-first traversal of their trie.

    The state of a trie node is the last token of its prefix's encoding; the tokens before it are
    those of the node where that token begins. A node's last token is the vocabulary token that
    ends there, encodes as itself, and that no merge joins with the last token before it. Words that share
    a prefix share its states; sorted words visit the trie depth first. A word's last symbol
    carries the word-end mark, so it is a leaf beside the inner node of the same letters.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in self.rank:
            self.parts.setdefault(a + b, (a, b))
        self.longest = max(map(len, vocab)) if vocab else 1
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """Pieces that stand at the token's edge (0 left, 1 right) while it is built, smallest first, each with the rank of the merge that takes it up."""
        found = self.spines.get((token, side))
        if found is None:
            chain = [(token, float("inf"))]
            while (at := chain[-1][0]) in self.parts:
                pair = self.parts[at]
                chain.append((pair[side], self.rank[pair]))
            found = self.spines[(token, side)] = chain[::-1]
        return found

    def apart(self, a: str, b: str) -> bool:
        """No merge joins the neighbours a and b while they are built."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < until_x and rank <= until_y:
                ok = False
                break
            if until_x == until_y == float("inf"):
                ok = True
                break
            if until_x <= until_y:
                i += 1
            else:
                j += 1
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[(a, b)] = ok
        return ok

    def itself(self, token: str) -> bool:
        """The token's symbols encode as the token."""
        known = self.whole.get(token)
        if known is None:
            body = token.removesuffix(self.end) if token != self.end else token
            symbols = list(body)
            if body != token and symbols:
                symbols[-1] += self.end
            while len(symbols) > 1:
                best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), float("inf")))
                if (symbols[best], symbols[best + 1]) not in self.rank:
                    break
                symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
            known = self.whole[token] = symbols == [token]
        return known

    def last_token(self, word: str, i: int, mark: str, tokens: list[str], begins: list[int]) -> tuple[str, int]:
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + mark
            if token in self.vocab and self.itself(token) and (j == 0 or self.apart(tokens[j], token)):
                return token, j
        raise ValueError(f"no encoding of {word!r}: a symbol is not in the vocabulary")

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        texts = [to_alphabet(w) for w in words]
        out: list[list[int]] = [[] for _ in texts]
        tokens, begins, path = [""], [0], ""  # states of the inner nodes on the path to the word before
        for k in sorted(range(len(texts)), key=texts.__getitem__):
            word = texts[k]
            depth, most = 0, min(len(word) - 1, len(tokens) - 1)
            while depth < most and word[depth] == path[depth]:
                depth += 1
            del tokens[depth + 1 :], begins[depth + 1 :]
            for i in range(depth + 1, len(word)):
                token, j = self.last_token(word, i, "", tokens, begins)
                tokens.append(token)
                begins.append(j)
            path = word
            token, j = self.last_token(word, len(word), self.end, tokens, begins)
            ids = [self.vocab[token]]
            while j:
                ids.append(self.vocab[tokens[j]])
                j = begins[j]
            out[k] = ids[::-1]
        return out


class Encoder:
    """Encodes text columns with one vocabulary file. ``joined``: see Pretokens."""

    def __init__(self, tokenizer, joined: bool, words: Callable[[list[bytes]], list[list[int]]], extra: Callable[[list[int]], tuple] | None = None):
        self.tokenizer, self.joined, self.words, self.extra = tokenizer, joined, words, extra
        self.specials = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(re.escape(x.decode()) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.extras: list[tuple] = []

    def _pretokenised(self, text: str) -> list[bytes]:
        """Words of a text by the library's rules; special tokens, marked, stand for themselves."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part.encode() in self.specials:
                out.append(_SPECIAL + part.encode())
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [from_alphabet(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        plain = iter(self.words([w for w in words if w[:1] != _SPECIAL]))
        return [[self.specials[w[1:]]] if w[:1] == _SPECIAL else next(plain) for w in words]

    def _known(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words in the table, which is keyed by their bytes."""
        if len(self.index) + len(words) > CACHE_WORDS:
            self.reset()
        get = self.index.get
        found = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            encoded = self._encoded(fresh)
            sizes = np.array([len(x) for x in encoded], np.int32)
            at = len(self.index)
            while at + len(new) > len(self.begin):
                self.begin, self.length = np.concatenate([self.begin, self.begin]), np.concatenate([self.length, self.length])
            total = int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in encoded for i in x), np.int32, total)
            self.begin[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.length[at : at + len(new)] = sizes
            self.used += total
            self.index.update(zip(fresh, range(at, at + len(new)), strict=True))
            found[new] = np.arange(at, at + len(new))
            if self.extra:
                self.extras += map(self.extra, encoded)
        return found

    def slices(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, words' places in the table, word offsets) of each slice of documents."""
        raw, offsets = buffers(column)
        for a, b in chunks(offsets):
            text, bounds = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            odd = _SLOW[text]
            odd[1:] |= (text[:-1] == 0xC2) & (text[1:] <= 0xA0)
            slow = set(np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1).tolist())
            whole = text.tobytes()
            for special in self.specials:
                at = whole.find(special)
                while at >= 0:
                    slow.add(int(np.searchsorted(bounds, at, "right")) - 1)
                    at = whole.find(special, at + 1)
            lists = {i: self._pretokenised(whole[bounds[i] : bounds[i + 1]].decode()) for i in sorted(slow)}
            if slow:
                keep = np.ones(b - a, bool)
                keep[list(slow)] = False
                sizes = np.diff(bounds)
                text = text[np.repeat(keep, sizes)]
                bounds = np.concatenate([[0], np.cumsum(sizes * keep)])
            pre = Pretokens(text, bounds, self.joined)
            codes, words = word_codes(pre.text, pre.starts, pre.ends)
            if lists:
                number = {w: n for n, w in enumerate(words)}
                extra = {i: np.array([number.setdefault(w, len(number)) for w in found], np.int64) for i, found in lists.items()}
                words, parts, at = list(number), [], 0
                for i, found in extra.items():
                    parts += [codes[at : pre.offsets[i]], found]
                    at = pre.offsets[i]
                codes = np.concatenate([*parts, codes[at:]])
                size = np.diff(pre.offsets)
                for i, found in extra.items():
                    size[i] = len(found)
                pre.offsets = np.concatenate([[0], np.cumsum(size)])
            places = self._known(words)[codes] if words else np.zeros(0, np.int64)
            yield a, b, places, pre.offsets

    def ids(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, ids, the documents' offsets in them) of each slice."""
        for a, b, places, words in self.slices(column):
            size = self.length[places].astype(np.int64)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out = self.flat[np.repeat(self.begin[places] - (ends - size), size) + np.arange(total)]
            yield a, b, out, np.concatenate([[0], ends])[words]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, joined: bool, trie: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    found = _encoders.get((path, joined, trie))
    if found is None:
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        if trie:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            names = {i: t for t, i in tokenizer.get_vocab().items()}
            words = TrieWords(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
            found = Encoder(tokenizer, joined, words, lambda ids: (" ".join(map(str, ids)).encode(), " ".join(names[i] for i in ids).encode(), len(ids)))
        else:
            found = Encoder(tokenizer, joined, LibraryWords(tokenizer))
        _encoders[path, joined, trie] = found
    return found
