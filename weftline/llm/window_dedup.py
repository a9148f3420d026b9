"""Substring dedup on word windows, with a count-min prefilter.

A window is ``window`` consecutive words (maximal runs of characters other than
space, \\t, \\n, \\v, \\f, \\r) of one document. A word goes if a window that covers it
also starts in a document with a smaller doc_id. Two passes over the blocks:

1. every window's hash raises a counter in each row of the block's count-min
   sketch; the merged sketches overestimate each window's count (``sketch``);
2. only windows estimated as repeated are grouped, by the 128-bit hash of their
   words (two different windows of 10**13 share one with a probability under
   10**-12), with the smallest doc_id a block; each block is told for which of
   its windows another block holds a smaller one.

Results: windows are judged on the input, equal doc_ids don't remove from each
other, a null doc_id counts as larger than all others, a null text has no words,
repeated rows stay. A text shorter than a window keeps all its words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks, rolling, sketch
from .blocks import NO_ID
from .common import emit

WINDOW = 13
#: Text bytes for each bucket of questions.
BUCKET_BYTES = 8 << 20


class Words:
    """The words of a block, joined by single spaces in ``data``; doc is each word's document."""

    def __init__(self, body: bytes, window: int):
        self.ids, raw, ends = blocks.unpack(body)
        data = np.frombuffer(raw, np.uint8)
        borders = ends[:-1]
        starts, stops = rolling.words(data, borders[(borders > 0) & (borders < len(data))])
        self.firsts = np.searchsorted(starts, np.append(0, ends))  # each document's first word
        self.doc = np.repeat(np.arange(len(ends)), np.diff(self.firsts))
        self.starts, self.stops, self.data, self.raw = starts, stops, data, raw
        if len(starts) >= window:
            hashes = rolling.of_sequences(rolling.of_spans(rolling.prefix(data), starts, stops), window)
            self.at = np.flatnonzero(self.doc[: len(hashes)] == self.doc[window - 1 :])
            self.hashes = hashes[self.at]
        else:
            self.at, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.window = window
        self.joined: tuple[bytes, np.ndarray] | None = None

    def join(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and the words' offsets there."""
        if self.joined is None:
            size = self.stops - self.starts
            offsets = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size + 1, out=offsets[1:])
            out = np.full(int(offsets[-1]), 32, np.uint8)
            # the place of each kept byte: its place in the data less what is left out before it
            inside = np.zeros(len(self.data) + 1, np.int8)
            inside[self.starts] += 1
            inside[self.stops] -= 1
            from_ = np.flatnonzero(np.cumsum(inside[:-1]))
            out[np.arange(len(from_)) + np.repeat(np.arange(len(size)), size)] = self.data[from_]
            self.joined = out.tobytes(), offsets
        return self.joined

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the chosen windows' words, in two halves."""
        text, offsets = self.join()
        a, b = offsets[chosen].tolist(), (offsets[chosen + self.window] - 1).tolist()
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([digest(text[x:y]) for x, y in zip(a, b, strict=True)]), ">u8").reshape(-1, 2)
        return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)


def distinct(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hi, lo) in order, the smallest doc of each, and each row's place among them."""
    order = rolling.grouping(hi, lo)
    h, l_ = hi[order], lo[order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (l_[1:] != l_[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(first) - 1
    least = np.minimum.reduceat(docs[order], np.flatnonzero(first)) if len(order) else docs
    return h[first], l_[first], least, inverse


def pack_docs(docs: np.ndarray) -> bytes:
    base = int(docs.min())
    if int(docs.max()) - base < 1 << 32:
        return struct.pack("<Bq", 4, base) + (docs - base).astype("<u4").tobytes()
    return struct.pack("<Bq", 8, 0) + docs.astype("<i8").tobytes()


def unpack_docs(blob: bytes, n: int) -> np.ndarray:
    size, base = struct.unpack_from("<Bq", blob)
    return np.frombuffer(blob, "<u4" if size == 4 else "<i8", n, 9).astype(np.int64) + base


def _ask_docs(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    bounds = np.array([min((1 << 64) - 1, ((1 << 64) * b) // buckets) for b in range(buckets)], np.uint64)
    cuts = [*np.searchsorted(hi, bounds).tolist(), len(hi)]
    for b in range(buckets):
        x, y = cuts[b], cuts[b + 1]
        if x < y:
            part = blocks.delta(hi[x:y] - bounds[b])
            yield b, struct.pack("<qq", y - x, len(part)) + part + lo[x:y].astype("<u8").tobytes() + pack_docs(docs[x:y])


def _smaller_elsewhere(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For each block a bit for each of its windows: whether another block has it in a smaller doc."""
    his, los, docs = [], [], []
    for _, blob in held:
        n, size = struct.unpack_from("<qq", blob)
        his.append(blocks.undelta(blob[16 : 16 + size]))
        los.append(np.frombuffer(blob, "<u8", n, 16 + size))
        docs.append(unpack_docs(blob[16 + size + 8 * n :], n))
    every = np.concatenate(docs)
    _, _, least, inverse = distinct(np.concatenate(his), np.concatenate(los), every)
    smaller = least[inverse] < every
    at = 0
    for (block, _), own in zip(held, docs, strict=True):
        bits = smaller[at : at + len(own)]
        at += len(own)
        if bits.any():
            yield block, np.packbits(bits).tobytes()


def _read_bits(hi: np.ndarray, buckets: int, got: list | None) -> np.ndarray:
    bounds = np.array([min((1 << 64) - 1, ((1 << 64) * b) // buckets) for b in range(buckets)], np.uint64)
    cuts = [*np.searchsorted(hi, bounds).tolist(), len(hi)]
    out = np.zeros(len(hi), bool)
    for a in got or ():
        x, y = cuts[a["bucket"]], cuts[a["bucket"] + 1]
        out[x:y] = np.unpackbits(np.frombuffer(a["blob"], np.uint8), count=y - x).astype(bool)
    return out


def remove(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words of every document, joined by single spaces."""
    table = blocks.build(df, id_col, text_col, block_bytes)
    total = table.agg({"n_bytes": "sum"}).first()[0] or 0
    buckets = blocks.bucket_count(total, bucket_bytes)
    bits = sketch.width_bits(total // 6)
    parts = blocks.partition_count(table, buckets)

    def count(row: tuple) -> Iterator[tuple[int, bytes]]:
        return sketch.questions(Words(row[2], window).hashes, bits, buckets)

    def candidates(held: Words, got: list | None) -> tuple:
        chosen = held.at[sketch.repeated(held.hashes, bits, buckets, got)]
        hi, lo = held.keys(chosen)
        docs = held.ids[held.doc[chosen]]
        return chosen, docs, *distinct(hi, lo, docs)

    def where(row: tuple) -> Iterator[tuple[int, bytes]]:
        _, _, hi, lo, least, _ = candidates(Words(row[2], window), row[3])
        return _ask_docs(hi, lo, least, buckets)

    counted = blocks.with_answers(table, blocks.ask(table, count, sketch.answers(bits, buckets), parts), "counts")
    placed = blocks.with_answers(counted, blocks.ask(counted, where, _smaller_elsewhere, parts), "places")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, _, body, counts, places in blocks.row_tuples(batches):
                held = Words(body, window)
                chosen, docs, hi, _, least, inverse = candidates(held, counts)
                gone = (docs > least[inverse]) | _read_bits(hi, buckets, places)[inverse]
                cover = np.zeros(len(held.starts) + 1, np.int64)
                cover[chosen[gone]] += 1
                cover[chosen[gone] + window] -= 1
                off = np.cumsum(cover[:-1]) > 0
                text, offsets = held.join()
                dropped = np.zeros(len(off) + 1, np.int64)
                np.cumsum(off, out=dropped[1:])
                for i, doc in enumerate(held.ids.tolist()):
                    a, b = int(held.firsts[i]), int(held.firsts[i + 1])
                    n = int(dropped[b] - dropped[a])
                    if n == 0:
                        kept = text[offsets[a] : offsets[b] - 1] if b > a else b""
                    else:
                        edge = np.flatnonzero(np.diff(off[a:b].view(np.int8), prepend=1, append=1)) + a  # kept runs' first and next words
                        kept = b" ".join([text[x : y - 1] for x, y in offsets[edge].reshape(-1, 2).tolist()])
                    yield None if doc == NO_ID else doc, b - a, n, kept.decode("utf-8")

        return emit(schema, rows(), lambda r: len(r[3]))

    return placed.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
