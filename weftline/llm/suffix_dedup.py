"""Substring dedup on bytes, with suffix arrays by the difference-cover algorithm.

A byte goes if a ``length``-byte string that covers it also starts in a document
with a smaller doc_id. Sorting all suffixes of a corpus in one array would move
every position several times, so the array is built in parts that can't share a
string: each ``length``-byte string belongs to the smallest hash of its grams
(its minimizer), and neighbouring strings of one minimizer travel as one piece.

1. A sketch over the minimizers of all blocks leaves out the pieces whose
   minimizer occurs in one document only (``sketch``; it loses none).
2. The other pieces meet by minimizer. Each task puts its distinct pieces into
   one text and sorts its suffixes by the difference cover {1, 2} modulo 3: sort
   the sampled triples, recurse on their names, merge the remaining suffixes,
   compare the prefixes of neighbours. Only ``length`` bytes matter, so the
   recursion ends when the names reach that far. Every string's smallest doc_id
   follows, and each block is told which strings of its pieces have a smaller one.

Results: strings are judged on the input and never cross documents; equal
doc_ids don't remove from each other, a null doc_id counts as larger than all
others, a null text is empty, repeated rows stay.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks, rolling, sketch
from .blocks import NO_ID
from .common import emit, input_bytes
from .window_dedup import pack_docs, unpack_docs

LENGTH = 50
#: Bytes of the grams whose smallest hash names a string.
GRAM = 20
BUCKET_BYTES = 8 << 20
#: Text bytes of a block that are hashed at once, which needs about 100 times as much memory.
BLOCK_BYTES = 1 << 20
#: Parts of a bucket of BUCKET_BYTES whose suffixes are sorted one after the other.
PARTS = 8
#: Every block asks every bucket, so beyond FEW of either they grow with the input,
#: blocks and buckets up to so many times; what is worked on at once stays as it is.
FEW, BLOCKS_GROW, BUCKETS_GROW = 256, 8, 4
#: Runs whose strings are marked at once.
RUNS = 1 << 15


# Suffix arrays


def _packed(*keys: np.ndarray) -> list[np.ndarray]:
    """The keys, neighbours joined in one 64-bit integer while they fit."""
    out: list[np.ndarray] = []
    used = 64
    for k in keys:
        bits = max(int(k.max()).bit_length(), 1) if len(k) else 1
        if used + bits <= 64:
            out[-1] = out[-1] << np.uint64(bits) | k.astype(np.uint64)
            used += bits
        else:
            out.append(k.astype(np.uint64))
            used = bits
    return out


def _names(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Names from 1 for rows of keys, in their order; equal rows have equal names."""
    keys = _packed(*keys)
    order = rolling.order(*keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names, int(np.count_nonzero(new))


def suffix_array(text: np.ndarray, need: int) -> np.ndarray:
    """Start positions of all suffixes of a text of integers >= 1, in the order of their first ``need`` items at least."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = text
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # where n % 3 is 1, a padding triple ends the first part
    sample = np.concatenate([ones, twos])
    names, m = _names(t[sample], t[sample + 1], t[sample + 2])
    if m < len(sample) and need > 3:
        deep = suffix_array(names, -(-need // 3))
        names = _ranks(names, deep, -(-need // 3))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    rest = np.arange(0, n, 3)
    rest = rest[rolling.order(*_packed(t[rest], rank[rest + 1]))]
    place = _below((t, rank), ones[ones < n], rest) + _below((t, t[1:], rank), twos, rest)
    # a remaining suffix stands before the sampled suffix whose place it has; among suffixes that agree so far any order will do
    place = np.maximum.accumulate(place) + np.arange(len(rest))
    ranked = sample[rolling.order(names)]
    out = np.empty(n, np.int64)
    sampled = np.ones(n, bool)
    sampled[place] = False
    out[place] = rest
    out[sampled] = ranked[ranked < n]
    return out


def _below(keys: tuple, part: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many suffixes of ``part`` are less than each of ``rest``, by items and the rank behind them."""
    k = len(part)
    both = np.concatenate([part, rest])
    key = _packed(*(x[both] for x in keys[:-1]), keys[-1][both + len(keys) - 1])
    one = key[0] if len(key) == 1 else _names(*key)[0]
    return np.searchsorted(np.sort(one[:k]), one[k:])


def _ranks(text: np.ndarray, order: np.ndarray, need: int) -> np.ndarray:
    """Ranks from 1 of the suffixes in ``order``; those that agree in their first ``need`` items share one."""
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], ~agree(text, order, need)]))
    return rank


def agree(text: np.ndarray, order: np.ndarray, need: int) -> np.ndarray:
    """Whether each suffix but the first agrees with its neighbour before it in their first ``need`` items."""
    bits = max(int(text.max()).bit_length(), 1) if len(text) else 1
    per = max(1, min(need, 64 // bits))
    t = np.zeros(len(text) + need + per, np.uint64)
    t[: len(text)] = text
    words = t[: len(text) + need].copy()  # ``per`` items from each place on
    for k in range(1, per):
        words <<= np.uint64(bits)
        words |= t[k : k + len(words)]
    live = None
    for k in [*range(0, need - per, per), need - per]:
        if live is None:
            w = words[order + k]
            same = w[1:] == w[:-1]
        else:
            same[live] = words[order[live] + k] == words[order[live + 1] + k]
        live = np.flatnonzero(same)
    return same


def least_docs(pieces: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece and each of its ``length``-byte strings the smallest doc of any piece that has it."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    if not len(pieces):
        return []
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 2
    flat[starts + sizes] = 1  # below all bytes
    order = suffix_array(flat, length)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    inside = np.arange(len(flat)) <= (starts + sizes - length)[piece]
    order = order[inside[order]]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in pieces]
    group = np.concatenate([[0], np.flatnonzero(~agree(flat, order, length)) + 1])
    least = np.minimum.reduceat(docs[piece[order]], group)
    found = np.zeros(len(flat), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    return [found[s : s + max(n - length + 1, 0)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# Pieces of a block


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = 1
    while n * 2 <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


class Pieces:
    """A block's maximal runs of strings with one minimizer: [start, start + length - 1 + count). About ``slice_bytes`` of whole documents are hashed at once."""

    def __init__(self, body: bytes, length: int, gram: int, slice_bytes: int = BLOCK_BYTES):
        self.ids, self.raw, self.ends = blocks.unpack(body)
        self.length = length
        self.size = len(self.raw)
        none = np.zeros(0, np.int64)
        found = [(none, np.zeros(0, np.uint64), none, none)]
        x = 0
        while x < len(self.ends):
            a = int(self.ends[x - 1]) if x else 0
            y = max(x + 1, int(np.searchsorted(self.ends, a + slice_bytes, "right")))
            start, hash_, doc, count = self._runs(np.frombuffer(self.raw, np.uint8, int(self.ends[y - 1]) - a, a) if self.ends[y - 1] > a else none.astype(np.uint8), self.ends[x:y] - a, gram)
            found.append((start + a, hash_, doc + x, count))
            x = y
        self.start, self.hash, self.doc, self.count = (np.concatenate(f) for f in zip(*found, strict=True))

    def _runs(self, data: np.ndarray, ends: np.ndarray, gram: int) -> tuple:
        """Start, hash, document and count of the runs of some documents."""
        length = self.length
        firsts = np.concatenate([[0], ends[:-1]])
        ok = np.zeros(len(data) + 1, np.int8)
        long_ = ends - firsts >= length
        ok[firsts[long_]] += 1
        ok[ends[long_] - length + 1] -= 1
        at = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
        if not len(at):
            return at, np.zeros(0, np.uint64), at, at
        least = _slide(rolling.of_grams(rolling.prefix(data), gram), length - gram + 1)[at]
        doc = np.repeat(np.arange(len(ends)), np.maximum(ends - firsts - length + 1, 0))
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
        cut = np.flatnonzero(new)
        # minima crowd near 0: mixed once more, they spread over all buckets
        return at[cut], rolling.mix(least[cut] + np.uint64(1)), doc[cut], np.diff(np.append(cut, len(at)))

    def distinct(self, chosen: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces of the chosen runs by hash, their hashes and smallest docs, and each run's place among them."""
        order = chosen[np.lexsort((self.ids[self.doc[chosen]], self.hash[chosen]))]
        places: dict[bytes, int] = {}
        pieces: list[bytes] = []
        inverse = np.empty(len(order), np.int64)
        first: list[int] = []
        raw, more = self.raw, self.length - 1
        new = np.ones(len(order), bool)
        np.not_equal(self.hash[order[1:]], self.hash[order[:-1]], out=new[1:])
        for i, (s, n, other) in enumerate(zip(self.start[order].tolist(), self.count[order].tolist(), new.tolist(), strict=True)):
            if other:
                places.clear()  # equal pieces have one minimizer
            piece = raw[s : s + n + more]
            at = places.get(piece)
            if at is None:
                at = places[piece] = len(pieces)
                pieces.append(piece)
                first.append(i)
            inverse[i] = at
        pick = order[np.array(first, np.int64)] if first else order[:0]
        self.chosen = order
        return pieces, self.hash[pick], self.ids[self.doc[pick]], inverse


def _bounds(buckets: int) -> np.ndarray:
    return np.array([((1 << 64) * b) // buckets for b in range(buckets)], np.uint64)


def _ask_pieces(pieces: list[bytes], hashes: np.ndarray, docs: np.ndarray, buckets: int, parts: int = PARTS) -> Iterator[tuple[int, bytes]]:
    cuts = np.append(np.searchsorted(hashes, _bounds(buckets * parts)), len(hashes))
    ends = cuts[parts::parts].tolist()
    squeeze = zstandard.ZstdCompressor(level=3)
    x = 0
    for b, y in enumerate(ends):
        if x < y:
            sizes = np.array([len(p) for p in pieces[x:y]], "<u4").tobytes()
            begin = (cuts[b * parts : (b + 1) * parts] - x).astype("<q")
            yield b, struct.pack("<q", y - x) + begin.tobytes() + squeeze.compress(sizes + hashes[x:y].astype("<u4").tobytes() + pack_docs(docs[x:y]) + b"".join(pieces[x:y]))
        x = y


class _Asked:
    """Pieces of a block in a bucket, 32 bits of their minimizers, and their docs; one part's are taken out at a time."""

    def __init__(self, blob: bytes, parts: int):
        n, *begin = struct.unpack_from(f"<{1 + parts}q", blob)
        self.raw = zstandard.ZstdDecompressor().decompress(blob[8 + 8 * parts :])
        self.cuts = [*begin, n]
        self.ends = np.zeros(n + 1, np.int64)
        np.cumsum(np.frombuffer(self.raw, "<u4", n), out=self.ends[1:])
        self.names = np.frombuffer(self.raw, "<u4", n, 4 * n)
        self.docs = unpack_docs(self.raw[8 * n : 8 * n + 9 + n * self.raw[8 * n]], n)
        self.ends += 8 * n + 9 + n * self.raw[8 * n]

    def part(self, k: int) -> tuple[list[bytes], list[int], list[int]]:
        x, y = self.cuts[k], self.cuts[k + 1]
        if x == y:
            return [], [], []
        ends, raw = self.ends[x : y + 1].tolist(), self.raw
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], self.names[x:y].tolist(), self.docs[x:y].tolist()


def _answers(length: int, parts: int = PARTS):
    def part(asked: list[tuple[list[bytes], list[int], list[int]]]) -> Iterator[np.ndarray]:
        """For each block the bits of its pieces in one part."""
        places: dict[bytes, int] = {}
        least: list[int] = []
        names: list[int] = []
        owns = []
        for pieces, own_names, docs in asked:
            own = []
            for piece, name, doc in zip(pieces, own_names, docs, strict=True):
                at = places.setdefault(piece, len(least))
                if at == len(least):
                    least.append(doc)
                    names.append(name)
                elif doc < least[at]:
                    least[at] = doc
                own.append(at)
            owns.append(own)
        # a piece that no other shares its minimizer with shares no string with any
        _, inverse, counts = np.unique(np.array(names, np.uint32), return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[inverse] > 1).tolist()
        distinct = list(places)
        found: list = [None] * len(distinct)
        for at, got in zip(several, least_docs([distinct[i] for i in several], np.array(least, np.int64)[several], length), strict=True):
            found[at] = got
        for own, (pieces, _, docs) in zip(owns, asked, strict=True):
            bits = [np.full(len(p) - length + 1, least[at] < doc) if found[at] is None else found[at] < doc for p, at, doc in zip(pieces, own, docs, strict=True)]
            yield np.concatenate(bits) if bits else np.zeros(0, bool)

    def answers(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        read = [_Asked(blob, parts) for _, blob in held]
        bits: list[list[np.ndarray]] = [[] for _ in held]
        for k in range(parts):
            some = [i for i, r in enumerate(read) if r.cuts[k] < r.cuts[k + 1]]
            for i, got in zip(some, part([read[i].part(k) for i in some]), strict=True):
                bits[i].append(got)
        squeeze = zstandard.ZstdCompressor(level=3)
        for (block, _), got in zip(held, bits, strict=True):
            all_ = np.concatenate(got)
            if all_.any():
                yield block, squeeze.compress(np.packbits(all_).tobytes())

    return answers


def _read_bits(pieces: list[bytes], hashes: np.ndarray, length: int, buckets: int, got: list | None) -> tuple[np.ndarray, np.ndarray]:
    """For all strings of all pieces whether a smaller doc has them, and each piece's offset there."""
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) - length + 1 for p in pieces], out=offsets[1:])
    cuts = [*np.searchsorted(hashes, _bounds(buckets)).tolist(), len(hashes)]
    out = np.zeros(int(offsets[-1]), bool)
    for a in got or ():
        x, y = int(offsets[cuts[a["bucket"]]]), int(offsets[cuts[a["bucket"] + 1]])
        out[x:y] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(a["blob"]), np.uint8), count=y - x).astype(bool)
    return out, offsets


def remove(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): the bytes that stay of every document."""
    grown = min(max(input_bytes(df) // FEW, block_bytes), block_bytes * BLOCKS_GROW)
    table = blocks.build(df, id_col, text_col, grown)
    total = table.agg({"n_bytes": "sum"}).first()[0] or 0
    grow = min(max(total // (bucket_bytes * FEW), 1), BUCKETS_GROW)
    buckets = blocks.bucket_count(total, bucket_bytes * grow)
    cuts = PARTS * grow
    bits = sketch.width_bits(total // 16)
    parts = blocks.partition_count(table, buckets * grow)

    def count(row: tuple) -> Iterator[tuple[int, bytes]]:
        return sketch.questions(Pieces(row[2], length, gram, block_bytes).hash, bits, buckets)

    def candidates(held: Pieces, got: list | None) -> tuple:
        return held.distinct(np.flatnonzero(sketch.repeated(held.hash, bits, buckets, got)))

    def where(row: tuple) -> Iterator[tuple[int, bytes]]:
        pieces, hashes, least, _ = candidates(Pieces(row[2], length, gram, block_bytes), row[3])
        return _ask_pieces(pieces, hashes, least, buckets, cuts)

    counted = blocks.with_answers(table, blocks.ask(table, count, sketch.answers(bits, buckets), parts), "counts")
    placed = blocks.with_answers(counted, blocks.ask(counted, where, _answers(length, cuts), parts), "places")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, _, body, counts, places in blocks.row_tuples(batches):
                held = Pieces(body, length, gram, block_bytes)
                pieces, hashes, least, inverse = candidates(held, counts)
                smaller, offsets = _read_bits(pieces, hashes, length, buckets, places)
                del pieces, hashes, body, counts, places
                later = held.ids[held.doc[held.chosen]] > least[inverse]
                cover = np.zeros(held.size + 1, np.int8)
                for k in range(0, len(held.chosen), RUNS):
                    some, of = held.chosen[k : k + RUNS], inverse[k : k + RUNS]
                    start, count_ = held.start[some], held.count[some]
                    within = np.arange(int(count_.sum())) - np.repeat(np.cumsum(count_) - count_, count_)
                    hit = np.repeat(later[k : k + RUNS], count_) | smaller[np.repeat(offsets[of], count_) + within]
                    at = (np.repeat(start, count_) + within)[hit]
                    cover[at] += 1
                    cover[at + length] -= 1
                a = now = 0
                for doc, b in zip(held.ids.tolist(), held.ends.tolist(), strict=True):
                    over = np.cumsum(cover[a:b], dtype=np.int32) + now
                    now = int(over[-1]) if b > a else now
                    mask = over > 0
                    n = int(mask.sum())
                    kept = held.raw[a:b]
                    spans = 0
                    if n:
                        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        kept = np.frombuffer(kept, np.uint8)[~mask].tobytes()
                    yield None if doc == NO_ID else doc, b - a, n, spans, kept
                    a = b

        return emit(schema, rows(), lambda r: len(r[4]))

    return placed.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
