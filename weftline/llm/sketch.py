"""Count-min sketches of string hashes, merged over all partitions.

A sketch has ROWS rows of counters, each row indexed by another hash, and as many
counters in all partitions' sketches (about PER a row for each string of the
input). Counters saturate at 2, all that the question "repeated?" needs. A block
raises few of them, so its sketch is the sorted list of the counters it raised,
and a bit for those that it raised more than once. Ranges of counters meet in one
task each, which adds the blocks' counts into one merged array and tells every
block which of its counters reached 2. A string's estimate is the least of its
counters: never below its true count, so no repeated string is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from . import rolling
from .blocks import delta, undelta

ROWS, PER = 2, 8
#: Odd factors that give each row a hash of its own.
_FACTORS = (1, 0xD6E8FEB86659FD93)


def width_bits(strings: int) -> int:
    """Counters of a row, as a power of two."""
    return min(60, max(16, int(PER * max(1, strings)).bit_length()))


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(_FACTORS[row])) >> np.uint64(64 - bits)


def _bounds(bits: int, buckets: int) -> np.ndarray:
    return np.array([((1 << bits) * i) // buckets for i in range(buckets + 1)], np.uint64)


def _raised(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct ones of sorted counters begin, and whether each occurs more than once."""
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(sorted_))) > 1


def questions(hashes: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A block's sketch as a blob a bucket: for each row the counters of the bucket's range."""
    bounds = _bounds(bits, buckets)
    rows = []
    for row in range(ROWS):
        c = np.sort(counters(hashes, row, bits))
        at, more = _raised(c)
        rows.append((c[at], more, np.searchsorted(c[at], bounds).tolist()))
    for b in range(buckets):
        parts = []
        for c, more, cuts in rows:
            part = delta(c[cuts[b] : cuts[b + 1]] - bounds[b])
            parts += [struct.pack("<q", len(part)), part, np.packbits(more[cuts[b] : cuts[b + 1]]).tobytes()]
        if any(cuts[b] < cuts[b + 1] for _, _, cuts in rows):
            yield b, b"".join(parts)


def _read(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for _ in range(ROWS):
        size = struct.unpack_from("<q", blob, at)[0]
        c = undelta(blob[at + 8 : at + 8 + size])
        at += 8 + size
        more = np.unpackbits(np.frombuffer(blob, np.uint8, -(-len(c) // 8), at), count=len(c))
        at += -(-len(c) // 8)
        out.append((c, more))
    return out


def answers(bits: int, buckets: int):
    """A function that merges the sketches of a bucket, and gives each block a bit for each counter it raised: whether the merged count is 2 or more."""
    bounds = _bounds(bits, buckets)

    def merge(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        lists = [_read(blob) for _, blob in held]
        hits = []
        for row in range(ROWS):
            merged = np.zeros(int(bounds[bucket + 1] - bounds[bucket]), np.uint8)
            for own in lists:
                c, more = own[row]
                merged[c] = np.minimum(merged[c] + 1 + more, 2)
            hits.append([merged[own[row][0]] == 2 for own in lists])
        for (block, _), *own in zip(held, *hits, strict=True):
            bits_ = np.concatenate(own)
            if bits_.any():
                yield block, np.packbits(bits_).tobytes()

    return merge


def repeated(hashes: np.ndarray, bits: int, buckets: int, got: list | None) -> np.ndarray:
    """Of each hash whether its count is estimated as two or more."""
    out = np.ones(len(hashes), bool)
    bounds = _bounds(bits, buckets)
    rows = []
    for row in range(ROWS):
        c = counters(hashes, row, bits)
        order = rolling.order(c)
        c = c[order]
        at, _ = _raised(c)
        rows.append((order, np.diff(np.append(at, len(c))), np.searchsorted(c[at], bounds).tolist(), np.zeros(len(at), bool)))
    for a in got or ():
        b, k = a["bucket"], 0
        n = sum(cuts[b + 1] - cuts[b] for _, _, cuts, _ in rows)
        told = np.unpackbits(np.frombuffer(a["blob"], np.uint8), count=n).astype(bool)
        for _, _, cuts, flags in rows:
            x, y = cuts[b], cuts[b + 1]
            flags[x:y] = told[k : k + y - x]
            k += y - x
    for order, counts, _, flags in rows:
        own = np.empty(len(hashes), bool)
        own[order] = np.repeat(flags, counts)
        out &= own
    return out
