"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a byte string there is one token that byte-pair encoding
puts last. An automaton over the vocabulary (a trie with suffix links) yields
all tokens that end at a position; the one that is last is the one compatible
with the last token of the prefix before it. Following these back gives the
ids, without simulating merges.

Two tokens are compatible if byte-pair encoding of their concatenation keeps
the boundary. Only the right spine of the left token's merge tree and the left
spine of the right one touch the boundary, so the test walks these two spines
in merge order and looks for a merge across.
"""

from __future__ import annotations

import json
import os
from functools import cache

import ahocorasick
import regex

# The published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOP = 1 << 30  # the rank at which a whole token would be merged on: never


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files of this kind."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in printable}
    spare = 256
    for b in range(256):
        if b not in printable:
            out[chr(spare)] = b
            spare += 1
    return out


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """(bytes of each id, merges as (left, right, merged) ids in rank order) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = byte_alphabet(), model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        if all(c in alphabet for c in text):
            tokens[i] = bytes(alphabet[c] for c in text)
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return tokens, merges


class PrefixBpe:
    """Encoder of one vocabulary. ``cache_at`` bounds the memory of remembered words, nothing else."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], pattern: str = PATTERN, cache_at: int = 400_000) -> None:
        self.tokens, self.pattern, self.cache_at = tokens, regex.compile(pattern), cache_at
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b, c) in enumerate(merges):
            self.pair.setdefault((a, b), r)
            if c not in self.split:
                self.split[c], self.rank[c] = (a, b), r
        made = set(self.split)
        base = {i for i, t in enumerate(tokens) if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in base | made:
            self.automaton.add_word(tokens[i].decode("latin-1"), (len(tokens[i]), i))
        self.automaton.make_automaton()
        self.left_spine, self.right_spine = cache(lambda t: self._spine(t, 0)), cache(lambda t: self._spine(t, 1))
        self.known: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of a merge tree from the leaf up, each with the rank that ends it."""
        out, ends = [], TOP
        while True:
            out.append((token, ends))
            if token not in self.split:
                return out[::-1]
            ends, token = self.rank[token], self.split[token][side]

    def _crossing(self, u: int, v: int) -> tuple[int, int] | None:
        """The first pair across the boundary of u and v that would merge, or None."""
        left, right = self.right_spine(u), self.left_spine(v)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.pair.get((x, y))
            # at equal rank the leftmost pair merges first
            if r is not None and r < x_ends and r <= y_ends:
                return x, y
            if x_ends == TOP and y_ends == TOP:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def compatible(self, u: int, v: int) -> bool:
        key = (u, v)
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) >= self.cache_at * 4:
                self.known.clear()
            ok = self.known[key] = self._crossing(u, v) is None
        return ok

    def stands(self, t: int) -> bool:
        """Whether the bytes of ``t`` alone encode to ``t``."""
        ok = self.whole.get(t)
        if ok is None:
            if t not in self.split:
                ok = True
            else:
                a, b = self.split[t]
                ok = self.stands(a) and self.stands(b) and self._crossing(a, b) == (a, b)
            self.whole[t] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        last = [-1] * (len(word) + 1)
        begins = [0] * (len(word) + 1)
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            stop, begin = end + 1, end + 1 - length
            if last[stop] < 0 and self.stands(token) if begin == 0 else last[stop] < 0 and last[begin] >= 0 and self.compatible(last[begin], token):
                last[stop], begins[stop] = token, begin
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = begins[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; its pre-tokens are remembered within a memory bound."""
        words, out = self.words, []
        for w in self.pattern.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode())
                if len(w) <= 64:
                    if len(words) >= self.cache_at:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


_LOADED: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """The encoder of a vocabulary file, made once per process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(*read_vocabulary(path))
    return _LOADED[path]


def vocabulary_path(folder: str = "/opt/tokenizers", name: str = "byte_bpe_50k.json") -> str:
    return os.path.join(folder, name)
