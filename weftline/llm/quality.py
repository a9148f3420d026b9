"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The target model counts words and word pairs, hashed into 2**BITS buckets, over
labelled good rows; the raw model counts them over all documents. A document's
log weight is its summed log ratio of the two, on the scale of a text of NOMINAL
n-grams: the sum's noise grows with a text's length, so it is divided by
length**POWER. With Gumbel noise from a hash of the doc_id added, the documents
with the k largest keys are a sample without replacement in proportion to their
weights. k is the number of documents whose weight passes the threshold that
parts labelled good from bad rows best, where losing a good row counts LOSS times.

The classifier is fitted on at most LABELLED labelled rows, those with the
smallest hashes of their doc_id: one half for the target model, one for the
threshold. The raw counts, weights, k and the k-th key cover all documents.

Results: a null or empty text has weight 0; equal keys at the k-th place are all
selected; repeated rows get equal results; without usable labels all weights are
0 and all documents are selected. Labels that are null, or that contradict each
other, count as bad.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import emit, pick, shared_table, text_rows

BITS = 18
NOMINAL, POWER, DAMP = 1000, 0.75, 50
#: Labelled rows that the classifier may be fitted on.
LABELLED = 20_000
LOSS = 3
SEED = 11


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    words = rolling.of_spans(rolling.prefix(data), *rolling.words(data))
    return (np.concatenate([words, rolling.of_sequences(words, 2)]) >> np.uint64(64 - bits)).astype(np.int64)


def counts(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """n-gram counts over all of (doc_id, text), as one array of 2**bits."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        held: list[np.ndarray] = []
        for _, text in text_rows(batches):
            held.append(features(text, bits))
            if sum(map(len, held[-64:])) > 1 << 20 or len(held) >= 256:
                total += np.bincount(np.concatenate(held), minlength=1 << bits)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)], pa.int32()), pa.array(total[at[i : i + (1 << 16)]], pa.int64())], schema=schema)

    out = np.zeros(1 << bits, np.float64)
    summed = docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits rows
    out[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log ratio of the two models by bucket; where the target sample should hold few n-grams it shrinks to 0."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + 1) / (expected + 1))


def weight(ratio: np.ndarray, text: str, bits: int = BITS) -> float:
    found = features(text, bits)
    return float(ratio[found].sum()) * (NOMINAL / (len(found) + DAMP)) ** POWER


def noise(doc: int | None, seed: int) -> float:
    """Gumbel noise of a document."""
    u = (xxhash.xxh64_intdigest(f"{doc}", seed) + 0.5) / 2.0**64
    return -float(np.log(-np.log(min(max(u, 1e-300), 1 - 1e-16))))


def sortable(key: float) -> int:
    """A signed 64-bit integer in the order of doubles."""
    bits = struct.unpack("<q", struct.pack("<d", key))[0]
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


class Model:
    def __init__(self, ratio: np.ndarray, threshold: float, bits: int):
        self.ratio, self.threshold, self.bits = ratio.astype(np.float32), threshold, bits


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, good, fold) of at most ``limit`` labelled documents; of rows of one doc_id the one with the least text."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.every(good).alias("good")).withColumn("h", F.xxhash64("doc_id"))
    few = rows.orderBy("h", "doc_id").limit(limit).select("doc_id", "good", (F.col("h") % 2 == 0).alias("fold"))
    found = docs.join(F.broadcast(few), "doc_id")  # at most ``limit`` rows of 10 bytes
    return found.groupBy("doc_id", "good", "fold").agg(F.min("text").alias("text")).select("doc_id", "text", "good", "fold")


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, bits: int = BITS) -> Model:
    docs = pick(docs)
    rows = shared_table(labelled(docs, labels, limit), "labelled")
    target = counts(rows.where("good and fold").select("doc_id", "text"), bits)
    if not target.any():
        return Model(np.zeros(1 << bits), -np.inf, bits)
    model = Model(log_ratio(target, counts(docs, bits)), -np.inf, bits)
    held = rows.where("not fold")
    tried = score(held.select("doc_id", "text", "good"), model, extra=True).toArrow()  # at most ``limit`` rows
    w, good = tried.column("log_weight").to_numpy(), tried.column("good").to_numpy(zero_copy_only=False).astype(bool)
    if good.any() and (~good).any():
        ups, downs = np.sort(w[good]), np.sort(w[~good])
        tries = np.unique(w)
        middle = np.concatenate([[tries[0] - 1], (tries[1:] + tries[:-1]) / 2])
        cost = LOSS * np.searchsorted(ups, middle) / len(ups) + 1 - np.searchsorted(downs, middle) / len(downs)
        model.threshold = float(middle[int(np.argmin(cost))])
    return model


def score(docs: DataFrame, model: Model, seed: int = SEED, extra: bool = False) -> DataFrame:
    """(doc_id, log_weight, key, place): place is the key as a sortable integer."""
    fields = [("doc_id", pa.int64()), ("log_weight", pa.float64()), ("key", pa.float64()), ("place", pa.int64())] + [("good", pa.bool_())] * extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                goods = batch.column(2).to_pylist() if extra else [()] * batch.num_rows
                for (doc, text), good in zip(text_rows(iter([batch])), goods, strict=True):
                    w = weight(model.ratio, text, model.bits)
                    key = w + noise(doc, seed)
                    yield (doc, w, key, sortable(key)) + ((good,) if extra else ())

        return emit(pa.schema(fields), rows())

    return docs.mapInArrow(run, "doc_id long, log_weight double, key double, place long" + ", good boolean" * extra)


def kth_largest(scored: DataFrame, k: int) -> int:
    """The k-th largest place, by counting 16 bits at a time: at most 65536 rows reach the driver."""
    low, left = 0, k
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = scored if prefix is None else scored.where(F.shiftright("place", shift + 16) == prefix)
        digit = F.shiftright("place", shift).bitwiseAND(0xFFFF) if prefix is not None else F.shiftright("place", shift)
        table = sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in table:
            if left <= n:
                prefix = d if prefix is None else (prefix << 16) | d
                break
            left -= n
        low = prefix
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, limit: int = LABELLED) -> tuple[DataFrame, int, Model]:
    """(doc_id, log_weight, key, selected) of every document; also the smallest selected place and the model."""
    model = fit(docs, labels, limit)
    scored = shared_table(score(pick(docs), model), "scored")
    total, passed = scored.agg(F.count("*"), F.count_if(F.col("log_weight") >= model.threshold)).first()
    k = min(total, passed if k is None else k)
    cut = kth_largest(scored, k) if 0 < k else (1 << 63) - 1
    return scored.select("doc_id", "log_weight", "key", (F.col("place") >= cut).alias("selected")), cut, model


def keep(docs: DataFrame, model: Model, cut: int, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, that were selected."""
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(at_id).to_pylist(), batch.column(at_text).to_pylist(), strict=True)
            mask = [sortable(weight(model.ratio, text or "", model.bits) + noise(doc, seed)) >= cut for doc, text in pairs]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
