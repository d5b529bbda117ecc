"""Hashes of the words of many texts at a time, straight from their code points, without a Python step per word."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import numpy as np

GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Code points below this have their properties in a table; the few above are looked up as they come.
TABLE = 0x20000


def mixed(h: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number under a seed, or under one seed each."""
    y = (h ^ np.uint64(seed) if np.isscalar(seed) else h ^ seed) * MIX
    y ^= y >> np.uint64(31)
    y *= GOLD
    return y ^ (y >> np.uint64(29))


def seeds(k: np.ndarray) -> np.ndarray:
    """Seeds by number; any two differ in about half of their bits."""
    y = (k.astype(np.uint64) + np.uint64(1)) * GOLD
    y ^= y >> np.uint64(32)
    return y * MIX


def seed(k: int) -> int:
    return int(seeds(np.array([k]))[0])


@cache
def _table(of: Callable[[str], int]) -> np.ndarray:
    """A property of every code point below TABLE, made once in each worker."""
    return np.fromiter((of(chr(i)) for i in range(TABLE)), np.uint32, TABLE)


def property_of(cp: np.ndarray, of: Callable[[str], int]) -> np.ndarray:
    """A property of code points; ``of`` is a function of the module, so that its table is made once."""
    if not len(cp) or cp.max() < TABLE:
        return _table(of)[cp]
    out = _table(of)[np.minimum(cp, TABLE - 1)]
    high = np.flatnonzero(cp >= TABLE)
    points, back = np.unique(cp[high], return_inverse=True)
    out[high] = np.array([of(chr(p)) for p in points], np.uint32)[back]
    return out


@cache
def _values() -> np.ndarray:
    return mixed(np.arange(TABLE, dtype=np.uint64), 0)


class Lookup:
    """Numbers (not 0) by hash, 0 for any other: a table by the first bits, and the few that meet there."""

    def __init__(self, hashed: np.ndarray, number: np.ndarray) -> None:
        bits = int(np.clip(2 * len(hashed).bit_length(), 12, 22))
        self.shift = np.uint64(64 - bits)
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        place = (hashed >> self.shift).astype(np.int64)
        _, first = np.unique(place, return_index=True)
        self.key[place[first]], self.number[place[first]] = hashed[first], number[first]
        rest = np.setdiff1d(np.arange(len(hashed)), first)
        self.rest = list(zip(hashed[rest], number[rest]))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = (h >> self.shift).astype(np.int64)
        out = np.where(self.key[place] == h, self.number[place], 0)
        for x, n in self.rest:
            out[h == x] = n
        return out


def in_word(c: str) -> int:
    """Letters and digits."""
    return c.isalnum()


def lower(c: str) -> int:
    """The lower case of one character, as far as it is one character."""
    x = c.lower()
    return ord(x) if len(x) == 1 else ord(c)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, a line end behind each, and where each begins; one place more than texts."""
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.cumsum([0, *[len(t) + 1 for t in texts]])


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size, base = 1 << n.bit_length(), int(GOLD)
            for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))


_powers = Powers()


def hashes(cp: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each run of code points that are ``inside``; the last one never is."""
    _powers.reach(len(cp) + 1)
    # A word's hash is a polynomial in its code points, from the difference of two prefix sums.
    value = _values()[cp] if not len(cp) or cp.max() < TABLE else mixed(cp.astype(np.uint64), 0)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(value * _powers.up[: len(cp)])))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = (sums[ends] - sums[starts]) * _powers.down[starts]
    return (h ^ (h >> np.uint64(32))) * MIX, starts, ends
