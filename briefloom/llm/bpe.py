"""Byte-pair encoding with forced boundaries, and decoding.

A merge joins two neighbours only if the result is a vocabulary token. Two neighbouring symbols that stand side by side
inside no vocabulary token can therefore never be joined: the place between them is a certain cut. Every word is cut at
all such places, the fragments are encoded on their own, and their tokens are put together again. Fragments are short
and recur, so that most of them are looked up, and a "word" of any length costs no more than its fragments.

The vocabulary file names the merges, the word-end mark and the special tokens. Only files of this layout are read:
normalisation NFC, one space for white space, lower case; words by a fixed pattern; byte-level symbols; no decoder.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

from pyspark.sql import DataFrame

from briefloom.llm.common import map_batches

CACHE_ENTRIES = 200_000  # per worker; a full cache is emptied, results do not depend on it
_NONE = 1 << 60
_SHORT = 48  # symbols up to which a scan finds the next merge faster than a heap
# Up to here the Unicode tables of the library and of Python agree; beyond, the library's own normaliser is used.
_COMMON = "԰"
# The vocabulary's word pattern, for ASCII and for texts up to _COMMON. White space only separates.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_NUMERALS = "²³¹¼½¾"
_SPACES = r"\t-\r \x85\xa0"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_NUMERALS}]+|[\d{_NUMERALS}]|(?:[^\w{_SPACES}]|_)+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = {chr(b): s for b, s in byte_symbols().items()}
        self.linked = {pair for t in self.vocab for s in [self.symbols(t.removesuffix(self.suffix), t.endswith(self.suffix))] for pair in zip(s, s[1:])}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def symbols(self, word: str, ends: bool = True) -> list[str]:
        """One symbol per byte; the last one of a word carries the word-end mark."""
        parts = list(word)
        if ends and parts:
            parts[-1] += self.suffix
        return parts

    def split(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Cut between neighbours that no vocabulary token holds side by side."""
        linked, out, start = self.linked, [], 0
        for i, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in linked:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """Join the neighbours of lowest rank, leftmost first, until no pair has a rank."""
        parts, ranks = list(fragment), self.ranks
        if len(parts) > _SHORT:
            parts = self._merge_long(parts)
        order = [ranks.get(p, _NONE) for p in zip(parts, parts[1:])]
        while order and (rank := min(order)) < _NONE:
            at = order.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = ranks.get((parts[at - 1], parts[at]), _NONE)
            if at < len(order):
                order[at] = ranks.get((parts[at], parts[at + 1]), _NONE)
        return tuple(self.vocab[p] for p in parts)

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs over a doubly linked list."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two was joined with another since
            parts[i], parts[j] = a + b, ""
            after[i] = k = after[j]
            after[j] = -2
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (pair := (parts[left], parts[right])) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, *pair))
        return [p for p in parts if p]

    def word(self, mapped: str) -> tuple[int, ...]:
        """Tokens of one byte-level word, by fragments."""
        out: list[int] = []
        for fragment in self.split(self.symbols(mapped)):
            known = self.fragments.get(fragment)
            if known is None:
                if len(self.fragments) >= CACHE_ENTRIES // 4:
                    self.fragments.clear()
                known = self.merge(fragment)
                if len(fragment) <= 64:
                    self.fragments[fragment] = known
            out += known
        return tuple(out)

    def plain(self, text: str) -> list[int]:
        """Tokens of a text without special tokens."""
        out: list[int] = []
        simple = text.isascii()
        if simple or max(text) < _COMMON:
            # Lower case is taken letter by letter: no special form for a sigma at the end of a word.
            found = _ASCII_WORDS.findall(text.lower()) if simple else _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
            words, table = self.words, self.bytes
            for w in found:
                known = words.get(w)
                if known is None:
                    known = self.word(w if w.isascii() and w.isalnum() else "".join([table[c] for c in w.encode().decode("latin-1")]))
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    if len(w) <= 64:
                        words[w] = known
                out += known
        else:
            for mapped, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
                out += self.word(mapped)
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.cuts is None:
            return self.plain(text)
        out: list[int] = []
        for part in self.cuts.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces, as without a decoder; unknown ids are left out."""
        try:
            return " ".join([self.token[i] for i in ids])
        except KeyError:
            return " ".join([self.token[i] for i in ids if i in self.token])


_LOADED: dict[str, ForcedBoundaryBpe] = {}


def encoder(path: str) -> ForcedBoundaryBpe:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text and the text decoded from them: ``id_col, n_tokens, ids array<int>, decoded``.

    Null texts count as empty: no tokens, decoded to an empty text. Special tokens inside texts are recognised. One row
    per input row, repeated rows included, null identifiers pass through; other columns are not read. The work is a
    projection without a shuffle. ``vocabulary`` is a path that every executor can open.
    """

    def rows(texts: list[str]) -> dict[str, list]:
        bpe = encoder(vocabulary)
        ids = [bpe.encode(x) for x in texts]
        return {"n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    return map_batches(docs, id_col, text_col, "n_tokens long, ids array<int>, decoded string", rows)
