"""Documents in blocks, and questions about their strings that other tasks answer.

Windowed operators ask of every window whether, or where, it occurs elsewhere. To
keep that small, documents are packed into blocks of some megabytes (one
compressed row each, in a table in the shared folder, so that a block is the same
whenever it is read). A block states its questions as one blob for each bucket of
a hash; all blobs of a bucket meet in one task, which answers each with a blob;
the answers go back to their blocks. A block asks a question once, however many
of its windows are equal, so a string that a third of all documents hold is one
row a block in its bucket, not one a document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, pick, shared_table, text_rows

#: Text bytes in a block.
BLOCK_BYTES = 4 << 20
#: Buckets that a task answers, one after the other.
BUCKETS = 4

#: doc_ids of a block (a null one counts as the largest), and its texts' bytes and ends.
Block = tuple[np.ndarray, bytes, np.ndarray]
NO_ID = (1 << 63) - 1


def pack(ids: list[int], texts: list[bytes]) -> bytes:
    ends = np.cumsum([len(t) for t in texts], dtype="<i8")
    body = np.array(ids, "<i8").tobytes() + ends.tobytes() + b"".join(texts)
    return struct.pack("<q", len(ids)) + zstandard.ZstdCompressor(level=3).compress(body)


def unpack(raw: bytes) -> Block:
    n = struct.unpack_from("<q", raw)[0]
    body = zstandard.ZstdDecompressor().decompress(raw[8:])
    return np.frombuffer(body, "<i8", n), body[16 * n :], np.frombuffer(body, "<i8", n, 8 * n)


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A table (block, n_bytes, body) in the shared folder; each document is whole in one block."""
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            ids, texts, size, n = [], [], 0, 0
            for doc, text in text_rows(batches):
                raw = text.encode("utf-8")
                if ids and size + len(raw) > block_bytes:
                    yield part << 32 | n, size, pack(ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(NO_ID if doc is None else doc)
                texts.append(raw)
                size += len(raw)
            if ids:
                yield part << 32 | n, size, pack(ids, texts)

        return emit(schema, rows(), lambda r: len(r[2]))

    return shared_table(pick(df, id_col, text_col).mapInArrow(run, "block long, n_bytes long, body binary"), "blocks")


def ask(source: DataFrame, questions: Callable[[tuple], Iterator[tuple[int, bytes]]], answers: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], partitions: int) -> DataFrame:
    """(block, answers: array of (bucket, blob)) for the blocks that got any.

    source: (block, ...); questions(row) gives (bucket, blob) of one block. answers(bucket,
    [(block, blob), ...]) gives (block, blob).
    """
    asked = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
    said = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, row[0], blob) for row in row_tuples(batches) for b, blob in questions(row))
        return emit(asked, rows, lambda r: len(r[2]))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held = None, []
            for bucket, block, blob in row_tuples(batches):
                if bucket != now and held:
                    yield from ((k, now, x) for k, x in answers(now, held))
                    held = []
                now = bucket
                held.append((block, blob))
            if held:
                yield from ((k, now, x) for k, x in answers(now, held))

        return emit(said, rows(), lambda r: len(r[2]))

    sent = source.mapInArrow(send, "bucket int, block long, blob binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    got = sent.mapInArrow(reply, "block long, bucket int, blob binary")
    return got.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def row_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a batch one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def with_answers(source: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    return source.join(answers.withColumnRenamed("answers", name).hint("shuffle_hash"), "block", "left")


def bucket_count(total_bytes: int, per: int) -> int:
    return max(1, -(-total_bytes // per))


def partition_count(df: DataFrame, buckets: int) -> int:
    """Tasks that answer: BUCKETS a task, so that a task's size stays as it is when the input grows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS))


def delta(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as bytes: Rice codes of their differences, the quotients in unary, the rest in as many bits as their mean has."""
    n = len(values)
    if not n:
        return struct.pack("<qBq", 0, 0, 0)
    d = np.empty(n, np.uint64)
    d[0], d[1:] = values[0], values[1:] - values[:-1]
    k = max(0, (int(values[-1]) // n).bit_length() - 1)
    ends = np.cumsum((d >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = np.unpackbits(d.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-k // 8)], axis=1, count=k, bitorder="little") if k else d[:0].view(np.uint8)
    return struct.pack("<qBq", n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def undelta(blob: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<qBq", blob)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), 17), count=size)
    d = np.diff(np.flatnonzero(unary), prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        raw = np.zeros((n, 8), np.uint8)
        low = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 17 + -(-size // 8)), count=n * k).reshape(n, k)
        raw[:, : -(-k // 8)] = np.packbits(low, axis=1, bitorder="little")
        d = d << np.uint64(k) | raw.view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)
