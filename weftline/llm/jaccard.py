"""n-gram Jaccard join by chosen paths, with classes of similar documents.

A document's set holds the hashes of its 5-word shingles (of a shorter text, of
all its words). Documents of one set are copies: a representative stands for them.

1. Every representative gets MINHASHES minhash tokens; the join runs on these
   token sets, whose overlap estimates the Jaccard similarity.
2. A run splits the sets recursively: a node of its tree samples one token place
   by its own hash, and the sets of the node that share the token there go to one
   child. Buckets are counted first, and only those of at most LEAF sets are dealt
   to a task, which compares them in full. Larger ones are split further, or, where their sets are as similar on average as the join asks or at
   depth DEPTH, compared in full by pairs of LEAF-sized groups. Runs and depths
   sample from places of their own, so two sets at the threshold s stay together
   down to depth d with a probability of s^d, whatever happens in other runs; the
   runs give the target recall at depth DEPTH, and more where a pair is more
   similar or its buckets are small earlier. (Where MINHASHES places are too few
   for that, at thresholds below about 0.6, runs share places.)
3. Comparisons in a bucket use 8 bits of each token and a threshold lower by
   MARGIN; a bucket gives a spanning forest of its similar sets, not all pairs.
4. Sets that are linked so, over all runs, form loose groups. Within them every
   pair is verified on the exact sets, group by group or by pairs of
   VERIFY-sized groups: this counts each document's links and gives the classes.

Results: a text without words has no set, no links and is a class of its own.
class_id is the smallest doc_id of the class; n_links counts the other documents
of similarity SIMILARITY or more, copies included. A null doc_id counts as larger
than all others and is reported as null. Repeated rows count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, graphs, rolling
from .common import emit, pick, shared_table, text_rows, without

K, SIMILARITY = 5, 0.8
MINHASHES = 96
RECALL = 0.999
LEAF, VERIFY, DEPTH = 4096, 512, 3
MARGIN = 0.15
#: Rows of 16 bytes that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1 << 21
RUN_BITS = 14
NO_ID = blocks.NO_ID


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with this probability, even if all its buckets are split down to this depth."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(similarity**depth))) if similarity < 1 else 1


def shingles(text: str, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    words = rolling.of_spans(rolling.prefix(data), *rolling.words(data))
    return np.unique(rolling.of_sequences(words, min(k, len(words)))) if len(words) else words


@lru_cache(maxsize=1)
def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, n, np.uint64)


def minhashes(found: np.ndarray, n: int = MINHASHES) -> np.ndarray:
    """The n tokens of a set, as 32-bit integers; long sets are hashed a part at a time."""
    least = np.full(n, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 4096):
        h = found[None, at : at + 4096] ^ _seeds(n)[:, None]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, h.min(1), out=least)
    return (least >> np.uint64(20)).astype(np.uint32)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sid, tokens) of (doc_id, text): sid names the set; it is null for texts without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sid", pa.string()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, text in text_rows(batches):
                found = shingles(text)
                doc = NO_ID if doc is None else doc
                yield (doc, _signed(text), xxhash.xxh3_128_hexdigest(found.tobytes()), minhashes(found).tobytes()) if len(found) else (doc, _signed(text), None, None)

        return emit(schema, rows(), lambda r: 420)

    return docs.mapInArrow(run, "doc_id long, text_hash long, sid string, tokens binary")


_ROWS = pa.schema([("bucket", pa.int64()), ("sid", pa.string()), ("sketch", pa.binary())])


def _child(path: int, run: int, runs: int, depth: int, tokens: np.ndarray) -> int:
    """Path of the child at this depth that a set goes to; the node's own hash decides which place it samples. The last bits name the run."""
    places = range(((depth - 1) * runs + run) % len(tokens), len(tokens), runs * DEPTH)
    i = places[xxhash.xxh64_intdigest(path.to_bytes(8, "little")) % len(places)]
    return xxhash.xxh64_intdigest(b"%d:%d:%d" % (path, i, int(tokens[i]))) >> 1 + RUN_BITS << RUN_BITS | run


def split(rows: DataFrame, depth: int, runs: int) -> DataFrame:
    """(bucket, sid, sketch) of (path, sid, tokens), down to this depth; depth 1 begins as many runs for every row."""
    if runs > 1 << RUN_BITS:
        raise ValueError(f"{runs} runs; at most {1 << RUN_BITS} have numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for path, sid, raw in blocks.row_tuples(batches):
                tokens = np.frombuffer(raw, np.uint32)
                sketch = tokens.astype(np.uint8).tobytes()
                for r in range(runs) if depth == 1 else [path & (1 << RUN_BITS) - 1]:
                    yield _child(r if depth == 1 else path, r, runs, depth, tokens), sid, sketch

        return emit(_ROWS, out(), lambda r: 160)

    return rows.mapInArrow(run, "bucket long, sid string, sketch binary")


def _forest(same: np.ndarray) -> list[tuple[int, int]]:
    """A star for each connected component of a symmetric matrix."""
    left, out = set(range(len(same))), []
    while left:
        root = min(left)
        seen, front = {root}, [root]
        while front:
            row = np.flatnonzero(same[front].any(0)).tolist()
            front = [x for x in row if x not in seen]
            seen.update(front)
        left -= seen
        out += [(root, x) for x in seen if x != root]
    return out


def compare(rows: DataFrame, similarity: float, partitions: int) -> DataFrame:
    """(a, b) of rows (bucket, sid, sketch), none of whose buckets is large: a spanning forest of each bucket's sets at a similarity lower by MARGIN."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    least = int((similarity - MARGIN) * MINHASHES)

    def bucket(held: list[tuple]) -> Iterator[tuple]:
        names = sorted(dict(held).items())
        if len(names) < 2:
            return
        m = np.frombuffer(b"".join(t for _, t in names), np.uint8).reshape(len(names), -1)
        same = np.zeros((len(m), len(m)), bool)
        for i in range(len(m)):
            same[i] = np.count_nonzero(m == m[i], axis=1) >= least
        yield from ((names[a][0], names[b][0]) for a, b in _forest(same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, held = None, []
            for key, sid, sketch in blocks.row_tuples(batches):
                if key != now:
                    yield from bucket(held)
                    now, held = key, []
                held.append((sid, sketch))
            yield from bucket(held)

        return emit(schema, out())

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a string, b string")


def counted(rows: DataFrame, key: str, least: int) -> tuple[DataFrame, int]:
    """(key, n) of the keys with more than ``least`` rows, at most one for every ``least`` rows, and how many there are; counts are summed within map tasks first."""
    large = shared_table(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least), "large")
    n = large.count()
    return (F.broadcast(large) if n <= BROADCAST_ROWS else large), n


def tiled(rows: DataFrame, key: str, size: str, leaf: int, name: str) -> DataFrame:
    """Rows with ``name``: the key where its bucket has at most ``leaf`` rows, else a row for each pair of groups of about ``leaf / 2`` rows."""
    groups = F.ceil(F.col(size) / F.lit(leaf // 2)).cast("int")
    own = F.pmod(F.xxhash64("sid"), groups).cast("int")
    one = F.array(F.concat_ws("/", F.col(key).cast("string"), F.lit("all")))
    many = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.concat_ws("/", F.col(key).cast("string"), F.least(g, own).cast("string"), F.greatest(g, own).cast("string")))
    return rows.withColumn(name, F.explode(F.when(F.col(size) <= leaf, one).otherwise(many)))


def tight(rows: DataFrame, similarity: float, n: int) -> DataFrame:
    """(path) of the ``n`` buckets (path, sid, tokens) whose sets are on average nearly as similar to one of them as asked."""
    pivot = rows.groupBy("path").agg(F.min_by("tokens", "sid").alias("pivot"))
    pivot = F.broadcast(pivot) if n <= BROADCAST_ROWS // 32 else pivot
    alike = sum((F.substring("tokens", 4 * i + 1, 4) == F.substring("pivot", 4 * i + 1, 4)).cast("int") for i in range(MINHASHES))
    return rows.join(pivot, "path").groupBy("path").agg(F.avg(alike).alias("alike")).where(F.col("alike") >= 0.9 * similarity * MINHASHES).select("path")


def candidates(reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b): links between sets found by the runs."""
    partitions = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = reps.select("sid", "tokens")
    runs = runs_for(recall, similarity)
    rows = split(tokens.select(F.lit(0).cast("long").alias("path"), "sid", "tokens"), 1, runs)
    edges = None
    for depth in range(1, DEPTH + 1):
        rows = shared_table(rows, "rows")
        large, n = counted(rows, "bucket", LEAF)
        found = shared_table(compare(rows.join(large.select("bucket"), "bucket", "left_anti") if n else rows, similarity, partitions), "compared")
        edges = found if edges is None else edges.unionByName(found)
        if not n:
            break
        # large buckets aren't dealt as such: their rows are split again, or go to tiles
        held = rows.select("bucket", "sid").join(large, "bucket").withColumnRenamed("bucket", "path")
        held = shared_table(held.join(tokens, "sid").select("path", "n", "sid", "tokens"), "held")
        full = large.select(F.col("bucket").alias("path")) if depth == DEPTH else shared_table(tight(held, similarity, n), "tight")
        full = F.broadcast(full) if n <= BROADCAST_ROWS else full
        sketch = F.expr(f"unhex(array_join(transform(sequence(0, {MINHASHES - 1}), i -> hex(substring(tokens, 4 * i + 1, 1))), ''))")
        tiles = tiled(held.join(full, "path", "left_semi"), "path", "n", LEAF, "tile").select(F.xxhash64("tile").alias("bucket"), "sid", sketch.alias("sketch"))
        edges = edges.unionByName(shared_table(compare(tiles, similarity, partitions), "tiles"))
        if depth == DEPTH:
            break
        rows = split(held.select("path", "sid", "tokens").join(full, "path", "left_anti"), depth + 1, runs)
    return edges.distinct()


def verify(members: DataFrame, docs: DataFrame, similarity: float, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(sid, links) and (a, b) of the pairs within each label of members (label, sid, first_doc, copies) that are similar in fact."""
    sized = members.join(counted(members, "label", VERIFY)[0], "label", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("first_doc"), "text")
    texts = own.join(sized, "first_doc")
    held = pa.schema([("label", pa.string()), ("n", pa.int64()), ("sid", pa.string()), ("copies", pa.int64()), ("found", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for text, label, n, sid, copies in blocks.row_tuples(batches):
                found = shingles(text).tobytes()
                if xxhash.xxh3_128_hexdigest(found) == sid:  # of equal doc_ids with different texts, the one meant
                    yield label, n, sid, copies, found

        return emit(held, out(), lambda r: len(r[4]))

    exact = texts.select("text", "label", "n", "sid", "copies").mapInArrow(fetch, "label string, n long, sid string, copies long, found binary")
    dealt = tiled(exact, "label", "n", VERIFY, "tile").select("tile", "n", "sid", "copies", "found")
    schema = pa.schema([("sid", pa.string()), ("links", pa.int64()), ("b", pa.string())])

    def tile(key: str, rows: list[tuple]) -> Iterator[tuple]:
        kept = sorted({sid: (n, copies, found) for n, sid, copies, found in rows}.items())
        names = [s for s, _ in kept]
        copies = np.array([c for _, (_, c, _) in kept], np.int64)
        parts = [np.frombuffer(f, np.uint64) for _, (_, _, f) in kept]
        size = np.array([len(p) for p in parts])
        ids = np.unique(np.concatenate(parts), return_inverse=True)[1]
        starts = np.cumsum(size) - size
        _, *pair = key.rsplit("/", 2) if not key.endswith("/all") else (key,)
        side = None
        if pair and pair[0] != pair[1]:
            groups = -(-kept[0][1][0] // (VERIFY // 2))
            side = np.array([_group(s, groups) for s in names])
        flag = np.zeros(int(ids.max()) + 1, np.int32)
        same = np.zeros((len(names), len(names)), bool)
        for i, (a, n) in enumerate(zip(starts.tolist(), size.tolist(), strict=True)):
            flag[ids[a : a + n]] = 1
            common = np.add.reduceat(flag[ids], starts)
            flag[ids[a : a + n]] = 0
            same[i] = common >= similarity * (n + size - common) - 1e-9
        np.fill_diagonal(same, False)
        if side is not None:
            same &= side[:, None] != side[None, :]  # pairs within a group are counted in its own tile
        for i in np.flatnonzero(same.any(1)).tolist():
            yield names[i], int(copies[same[i]].sum()), None
        yield from ((names[a], 0, names[b]) for a, b in _forest(same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, rows = None, []
            for key, *row in blocks.row_tuples(batches):
                if key != now and rows:
                    yield from tile(now, rows)
                    rows = []
                now = key
                rows.append(tuple(row))
            if rows:
                yield from tile(now, rows)

        return emit(schema, out())

    got = shared_table(dealt.repartition(partitions, "tile").sortWithinPartitions("tile").mapInArrow(run, "sid string, links long, b string"), "verified")
    return got.where("b is null").groupBy("sid").agg(F.sum("links").alias("links")), got.where("b is not null").select(F.col("sid").alias("a"), "b")


def _signed(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8"), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _group(sid: str, groups: int) -> int:
    """Spark's pmod(xxhash64(sid), groups)."""
    return _signed(sid) % groups


def join(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, first): first marks the row whose doc_id is the class's id and whose set stands for it."""
    docs = pick(df, id_col, text_col)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = shared_table(sets(docs), "sets")
    reps = own.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    reps = shared_table(reps, "reps")
    loose = graphs.components(candidates(reps, similarity, recall))
    members = loose.select(F.col("node").alias("sid"), "label").join(reps.drop("tokens"), "sid")
    links, edges = verify(members, docs, similarity, partitions)
    labels = graphs.components(edges).select(F.col("node").alias("sid"), "label")
    known = reps.drop("tokens").join(labels, "sid", "left").join(links, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    classes = known.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    known = known.join(classes, "label").select("sid", "first_doc", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.select("doc_id", "text_hash", "sid").join(known, "sid", "left")
    class_id = F.coalesce("class_id", "doc_id")
    null = lambda c: F.when(c != NO_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), "text_hash", null(class_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), ((F.col("doc_id") == class_id) & (F.col("first_doc").isNull() | (F.col("first_doc") == class_id))).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class; of repeated rows one."""
    found = shared_table(join(docs), "classes")
    kept = without(docs, found.where(~F.col("first")))
    repeated = found.where("first").groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
