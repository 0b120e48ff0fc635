"""Exact quotient hash tables over fixed-width identifiers.

An identifier is 128 bits, two unsigned 64-bit words. A bijection permutes it;
the high bits of the permuted word are the quotient, all other bits the
remainder. The quotient picks the shard (top bits) and the slot in it (next
bits). A slot stores both permuted words, of which the remainder is a part: the
quotient bits are kept too, since linear probing moves an identifier away from
its own slot. So a lookup compares whole identifiers and never matches falsely.
The table doubles before it is half full, inserting its identifiers again.
Every insert of a batch runs vectorised.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def permute(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of 128-bit identifiers that spreads them over the high word.

    Each step is invertible: adding a function of the other word, multiplying by an odd number, and folding
    high bits onto low ones.
    """
    with np.errstate(over="ignore"):
        hi = hi + lo * _ODD2
        hi = (hi ^ (hi >> _S32)) * _ODD
        hi = hi ^ (hi >> _S29)
        lo = lo + hi * _ODD
    return hi, lo


class QuotientTable:
    """Identifier to smallest value, exact; growing takes one more bit for the slot."""

    def __init__(self, bits: int = 10, skip: int = 0) -> None:
        self.skip = skip  # leading quotient bits already used up by the choice of shard
        self._allocate(bits)

    def _allocate(self, bits: int) -> None:
        self.bits = bits
        n = 1 << bits
        self.hi, self.lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.value = np.full(n, np.iinfo(np.int64).max, np.int64)
        self.used = np.zeros(n, bool)
        self.count = 0

    def _home(self, hi: np.ndarray) -> np.ndarray:
        shifted = (hi << np.uint64(self.skip)) if self.skip else hi
        return (shifted >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, hi: np.ndarray, lo: np.ndarray, value: np.ndarray) -> None:
        """Insert permuted identifiers; an identifier present already keeps the smaller value."""
        if not len(hi):
            return
        while (self.count + len(hi)) * 2 > len(self.used):
            self._grow()
        mask = len(self.used) - 1
        slot, todo = self._home(hi), np.arange(len(hi))
        while len(todo):
            s = slot[todo]
            free = ~self.used[s]
            # of the identifiers that meet at a free slot the first claims it, the rest look again
            claim, first = np.unique(s[free], return_index=True)
            owner = todo[free][first]
            self.used[claim] = True
            self.hi[claim], self.lo[claim] = hi[owner], lo[owner]
            self.count += len(claim)
            same = (self.hi[s] == hi[todo]) & (self.lo[s] == lo[todo]) & self.used[s]
            np.minimum.at(self.value, s[same], value[todo[same]])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & mask

    def _grow(self) -> None:
        hi, lo, value = self.items()
        self._allocate(self.bits + 1)
        self.insert(hi, lo, value)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.hi[self.used], self.lo[self.used], self.value[self.used]

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Values of identifiers, the largest int64 where absent."""
        out = np.full(len(hi), np.iinfo(np.int64).max, np.int64)
        mask, slot, todo = len(self.used) - 1, self._home(hi), np.arange(len(hi))
        while len(todo):
            s = slot[todo]
            same = self.used[s] & (self.hi[s] == hi[todo]) & (self.lo[s] == lo[todo])
            out[todo[same]] = self.value[s[same]]
            todo = todo[self.used[s] & ~same]
            slot[todo] = (slot[todo] + 1) & mask
        return out
