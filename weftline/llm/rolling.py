"""Hashes of all byte strings and word sequences of a block of text, with numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64; a worker keeps the longest tables asked for."""
    if len(_held[0]) < n:
        size = ((n >> 17) + 1) << 17
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[:1] = 1
            _held[k] = np.multiply.accumulate(table)
    return _held[0][:n], _held[1][:n]


#: Random 64-bit values of the 256 bytes: bytes hashed as they are would make short strings collide.
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of h, in its place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = _VALUES[data]
    values *= powers(len(data))[0]
    np.cumsum(values, out=out[1:])
    return out


def of_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal values."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def of_grams(sums: np.ndarray, n: int) -> np.ndarray:
    """The hash of every data[i:i+n]."""
    if len(sums) <= n:
        return np.zeros(0, np.uint64)
    h = sums[n:] - sums[:-n]
    h *= powers(len(sums))[1][: len(h)]
    return mix(h)


def of_sequences(items: np.ndarray, n: int) -> np.ndarray:
    """The hash of every items[i:i+n] of 64-bit hashes."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(items) + 1, np.uint64)
    up, down = powers(len(items) + 1)
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(items) - n + 1])


def words(data: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r; none goes on across a border."""
    word = ~((data == 32) | (data - np.uint8(9) < 5))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if borders is not None:
        first[borders] = word[borders]
        last[borders - 1] = word[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned keys, the first one weighing most; equal rows stay in the order given.

    A part of a key and its row's place go into one integer: sorting integers is
    several times as fast as sorting places. The parts are taken from the last one on.
    """
    n = max(len(keys[0]) - 1, 0).bit_length()
    room, low = 64 - n, np.uint64((1 << n) - 1)
    found = None
    for key in reversed(keys):
        top = int(key.max()).bit_length() if len(key) else 0
        for shift in range(0, max(top, 1), room):
            part = key.astype(np.uint64) >> np.uint64(shift)
            if found is not None:
                part = part[found]
            part <<= np.uint64(n)  # what stands above the part's bits falls out
            part |= np.arange(len(key), dtype=np.uint64)
            part.sort()
            at = (part & low).astype(np.int64)
            found = at if found is None else found[at]
    return found


def grouping(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """An order of 128-bit keys (hi, lo)."""
    n = max(len(hi) - 1, 0).bit_length()
    packed = (hi >> np.uint64(n)) << np.uint64(n) | np.arange(len(hi), dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64((1 << n) - 1)).astype(np.int64)
    h, l_ = hi[at], lo[at]
    if (h[1:] < h[:-1]).any() or ((h[1:] == h[:-1]) & (l_[1:] < l_[:-1])).any():
        return order(hi, lo)  # different keys that agree in their leading bits: rare
    return at
