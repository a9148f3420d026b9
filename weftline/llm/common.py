"""What the corpus operators share: input columns, scratch tables, Arrow output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text or media that a Python worker gathers before it yields a batch.
BATCH_BYTES = 4 << 20

_scratch: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text counts as empty."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local master gets a local one (tests); a cluster is an error, as its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/weftline-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}/{name}"
    _scratch.append(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: it cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the given scratch tables, or all of this process; results that still read them must be used up first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(_scratch) if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(p).getParent()
        path.getFileSystem(conf).delete(path, True)
        if p in _scratch:
            _scratch.remove(p)


def since(mark: int) -> list[str]:
    """The scratch tables made since there were ``mark`` of them."""
    return _scratch[mark:]


def mark() -> int:
    return len(_scratch)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose (doc_id, xxhash64 of text) isn't in gone (doc_id, text_hash)."""
    doc, text = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[text]), "left_anti")


def input_bytes(df: DataFrame) -> int:
    """Size of the files behind df as the optimizer knows it (0 where it doesn't); decides only how many partitions are used."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def emit(schema: pa.Schema, rows: Iterator[tuple], weigh=None) -> Iterator[pa.RecordBatch]:
    """Gathers tuples into batches of at most BATCH_BYTES (by ``weigh``) and 4096 rows."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if len(held) >= 4096 or size >= BATCH_BYTES:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) of every row, a small slice of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def span_text(kind: str, start: Column, end: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), start.cast("string"), F.lit(":"), end.cast("string"))
