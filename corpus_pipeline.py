"""A corpus pipeline: reject low quality, keep one of each class of near duplicates, drop benchmark leaks, redact secrets, encode.

Each stage works on all rows that its predecessor kept. The first three drop
rows, the fourth replaces secrets in the texts, the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, decontam, jaccard, quality, secret_scan
from weftline.llm.common import documents, emit, mark, pick, release, scratch_path, since, text_rows


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects."""
    _, cut, model = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model, cut)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of the n-gram Jaccard join."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, whole): the token ids, and whether they decode to the whole text."""
    path = bpe.default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.load(path)

        def rows() -> Iterator[tuple]:
            for doc, text, raw in bpe.encoded(path, text_rows(batches)):
                ids = np.frombuffer(raw, "<i4")
                yield doc, len(ids), ids, vocab.decode(ids) == text

        return emit(schema, rows(), lambda r: 4 * r[1])

    return pick(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, whole boolean")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: No SQL expresses the fitted models, the sampling and the BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own scratch tables, and its input, go when its result is written."""
    docs = documents(spark, sf_dir)
    before: list[str] = []
    for name, stage in STAGES:
        at, path = mark(), scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, [*before, *(p for p in since(at) if p != path)])
        before = [path]
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
