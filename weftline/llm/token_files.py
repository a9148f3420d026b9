"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard is two files: ``shard-00000.bin`` holds the ids of its documents one
after the other as little-endian unsigned integers (16 bits where the vocabulary
allows, else 32), ``shard-00000.idx`` a header of three 64-bit integers
(format, bytes an id, documents) and then, as 64-bit integers, the document ids
and the documents' offsets in ids (one more than documents). Shards follow
doc_id: partitions are ranges of it, and of the texts' hashes within one doc_id, so
that no doc_id (null among them) is bound to one shard; rows alike in both are.
``manifest.json`` names the shards with their bases, the prefix sums of the shards' token counts, so that base + offset
is a document's place among all ids. The bases are sums over one row a shard.

A task writes under a name of its own and renames at the end; a repeated task
writes the same bytes, so lost executors leave nothing wrong behind, and one that
fails removes its own. Null doc_ids come first, equal doc_ids in the order of
their texts' 64-bit hashes, then of the texts; a null text has the end id alone.
An empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import mmap
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import emit, input_bytes, pick, scratch_path, text_rows

FORMAT = 1
#: A null doc_id in the index, which holds 64-bit integers.
NO_ID = -(1 << 63)
#: Bytes of compressed input for each shard.
SHARD_BYTES = 32 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(df: DataFrame, out: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Encodes every whole text, appends end_id and writes the shards and the manifest to the folder ``out``; returns the manifest."""
    path = path or bpe.default_vocabulary()
    spark = df.sparkSession
    docs = pick(df, id_col, text_col)
    n = shards or max(spark.sparkContext.defaultParallelism, -(-input_bytes(df) // SHARD_BYTES))
    fields = "shard int, documents long, tokens long, bytes_per_id int"
    schema = pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes_per_id", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        size = 2 if bpe.load(path).size <= 1 << 16 and end_id < 1 << 16 else 4
        kind = f"<u{size}"
        store, folder = _fs(out)
        store.create_dir(folder, recursive=True)
        own = f"{folder}/.{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=kind).tobytes()
        ids, ends, at = [], [0], 0
        try:
            with store.open_output_stream(f"{own}.bin") as f:
                for doc, _, got in bpe.encoded(path, text_rows(batches)):
                    f.write(np.frombuffer(got, "<u4").astype(kind).tobytes() + end)
                    at += len(got) // 4 + 1
                    ids.append(NO_ID if doc is None else doc)
                    ends.append(at)
            if not ids:
                return
            with store.open_output_stream(f"{own}.idx") as f:
                f.write(np.array([FORMAT, size, len(ids), *ids, *ends], dtype="<i8").tobytes())
            for ext in ("bin", "idx"):
                store.move(f"{own}.{ext}", f"{folder}/shard-{shard:05d}.{ext}")
        finally:
            for left in store.get_file_info([f"{own}.bin", f"{own}.idx"]):
                if left.type == pafs.FileType.File:
                    store.delete_file(left.path)
        yield from emit(schema, iter([(shard, len(ids), at, size)]))

    # Keys of the content alone: a number for each row could differ when a lost task is repeated, and lose rows.
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    rows = sorted(ranged.select(*docs.columns).mapInArrow(run, fields).collect())  # one row a shard
    manifest: dict = {"format": FORMAT, "end_id": end_id, "shards": []}
    base = 0
    for r in rows:
        manifest["shards"].append({"shard": r.shard, "base": base, "documents": r.documents, "tokens": r.tokens})
        base += r.tokens
    manifest["tokens"] = base
    store, folder = _fs(out)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """A shard's ids, memory-mapped where the folder is local, else read in ranges."""

    def __init__(self, out: str, shard: int):
        store, folder = _fs(out)
        name = f"{folder}/shard-{shard:05d}"
        with store.open_input_stream(f"{name}.idx") as f:
            head = np.frombuffer(f.read(), "<i8")
        assert head[0] == FORMAT
        n = int(head[2])
        self.kind, self.size = f"<u{head[1]}", int(head[1])
        self.ids, self.offsets = head[3 : 3 + n], head[3 + n :]
        self.mapped = isinstance(store, pafs.LocalFileSystem)
        if self.mapped:
            self.file = open(f"{name}.bin", "rb")
            self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            self.file = store.open_input_file(f"{name}.bin")

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.mapped:
            return np.frombuffer(self.data, self.kind, b - a, a * self.size)
        return np.frombuffer(self.file.read_at((b - a) * self.size, a * self.size), self.kind)


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder, read from its files a shard a task."""
    store, folder = _fs(out)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    table = spark.createDataFrame([(s["shard"], s["base"]) for s in shards], "shard int, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = Shard(out, shard)
                for i, doc in enumerate(held.ids.tolist()):
                    ids = held.document(i)
                    yield None if doc == NO_ID else doc, base + int(held.offsets[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return table.repartition(max(1, len(shards)), F.col("shard")).mapInArrow(lambda b: emit(schema, rows(b)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df's documents to the shared folder and reads the files back."""
    out = scratch_path(df.sparkSession, "tokens")
    write(df, out, path)
    return read(df.sparkSession, out)
