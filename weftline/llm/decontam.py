"""Benchmark decontamination with SimHash windows. DataFrame functions only.

For every benchmark item and document, windows of as many words as the item has
are compared with it. A window of similarity > 0 shares a shingle (``K``
consecutive words; of shorter items, all their words) with its item, so windows
are laid where such a shingle falls on its place in the item. Each window's
SimHash is taken over its shingles; fingerprints are cut into RADIUS + 1 blocks:
by the pigeonhole principle fingerprints within RADIUS bits share a block. At the
radius that a similarity of 0.8 needs such a block has three bits, too few to
tell windows and items apart, so a block is looked up together with a shingle:
of an item's shingles, the rarest that hold more than 1 - SIMILARITY of its
weight are needed ones, of which every similar window has one. Windows and items
of one size that share a needed shingle and a block are candidates, and all pairs
within RADIUS that can be similar are among them. Those within it are verified by
the exact weighted Jaccard similarity of their shingles, where a shingle that d
items hold weighs 1 / d, and one outside the pair's item no more than the item's
shingles do on average (as much where no item holds it).

Words are lower-cased and split at white space. A window that would begin before
its document or end behind it is moved inside, and is shorter where the document
is. A pair keeps its most similar window, the first one of equals. Equal windows
are fingerprinted and verified once, so copies of a passage cost one row each.
An item is an item_id and the shingles of a text: different texts of one item_id
are compared each by itself, and a document's pair with the item_id is the most
similar one. A null item_id counts as one and is reported as null.
Null and empty texts have no windows and no shingles; empty tables give an empty
result; repeated (doc_id, text) rows give one row, equal doc_ids with different
texts one row for the more similar one; a null doc_id is reported as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, shared_table, without

K, SIMILARITY = 5, 0.8
#: Of 64-bit fingerprints. At a similarity of 0.8 they differ by 9.7 bits on average, with a deviation of 2.9.
RADIUS = 20
#: Benchmark shingles that are broadcast at most (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "\x20" * 5), "\x20"), "")


def with_shingles(df: DataFrame, k: int) -> DataFrame:
    """df with n (words) and s: the hashes of all its shingles of k words, in order."""
    hashed = df.withColumn("w", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    each = ", ".join(f"get(w, i + {j})" for j in range(k))
    shingles = F.expr(f"if(size(w) >= {k}, transform(sequence(0, size(w) - {k}), i -> xxhash64({each})), cast(array() as array<bigint>))")
    return hashed.withColumns({"n": F.size("w"), "s": shingles}).drop("w")


def simhash(column: str) -> Column:
    """64 bits: each the majority among the hashes' bits."""
    votes = f"aggregate({column}, 0, (a, h) -> a + if(shiftright(h, b) & 1 = 1, 1, -1))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if({votes} > 0, 1L, 0L), b))")


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks: structs of (number, bits)."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def items(benchmark: DataFrame, k: int = K) -> DataFrame:
    """(item, item_id, k, n, s) of the items with words, by item; rows of one item_id and equal shingles once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    sized = rows.withColumn("k", F.least(F.lit(k), F.size(words(F.col("text")))))
    out = None
    for size in range(1, k + 1):
        part = with_shingles(sized.where(F.col("k") == size), size).select("item_id", "k", "n", "s")
        out = part if out is None else out.unionByName(part)
    shown = F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.col("k").cast("string"), F.array_join(F.transform("s", lambda h: h.cast("string")), ","))
    return out.select(F.sha2(shown, 256).alias("item"), "item_id", "k", "n", "s").dropDuplicates(["item"])


def find(docs: DataFrame, benchmark: DataFrame, k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start_word, n_words, distance) of every pair with a similar window."""
    spark = docs.sparkSession
    docs = pick(docs, id_col, text_col)
    bench = shared_table(items(benchmark, k), "items")
    places = bench.select("k", "n", F.posexplode("s").alias("at", "h"))
    total, sizes = places.agg(F.count("*"), F.sort_array(F.collect_set("k"))).first()  # at most k sizes
    # a shingle's places within items of one size lead to the same windows
    laid = places.select("k", "h", F.col("n").alias("size"), "at").distinct()
    laid = F.broadcast(laid) if total <= BROADCAST_ROWS else laid
    windows = None
    for size in sizes or []:
        # outer: else a filter on s would be pushed down with s written out in it, at the cost of s for each shingle
        rows = with_shingles(docs, size).select("doc_id", F.xxhash64("text").alias("text_hash"), "s", F.posexplode_outer("s").alias("pos", "h"))
        hit = rows.join(laid.where(F.col("k") == size).select("h", "size", "at"), "h")
        length = F.least(F.col("size") - size + 1, F.size("s"))
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("s") - length))
        part = hit.select("doc_id", "text_hash", F.lit(size).alias("k"), "size", start.alias("start"), F.slice("s", start + 1, length).alias("win"))
        windows = part if windows is None else windows.unionByName(part)
    if windows is None:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, similarity double, start_word int, n_words int, distance int")
    windows = shared_table(windows.withColumn("content", F.sha2(F.array_join(F.transform("win", lambda h: h.cast("string")), ","), 256)), "windows")
    once = windows.groupBy("k", "size", "content").agg(F.first("win").alias("win"))
    prints = shared_table(once.withColumn("f", simhash("win")), "prints")
    # items' shingles by weight, the rarest first; those that a similar window can't all lack
    df = bench.select("k", F.explode(F.array_distinct("s")).alias("h")).groupBy("k", "h").count().select("k", "h", (1.0 / F.col("count")).alias("w"))
    known = bench.select("item", "k", F.col("n").alias("size"), F.explode("s").alias("h")).groupBy("item", "k", "size", "h").agg(F.count("*").alias("c")).join(df, ["k", "h"])
    order = Window.partitionBy("item").orderBy(F.col("w").desc(), "h")
    ranked = known.withColumns({"before": F.sum(F.col("w") * F.col("c")).over(order) - F.col("w") * F.col("c"), "all": F.sum(F.col("w") * F.col("c")).over(Window.partitionBy("item"))})
    known = shared_table(ranked.withColumn("needed", F.col("before") <= (1 - similarity) * F.col("all") + 1e-9).drop("before", "all"), "known")
    # multi-index: a shared needed shingle and an equal block, then the whole distance
    keys = shared_table(known.where("needed").join(bench.select("item", simhash("s").alias("g")), "item").select("k", "size", "h", "item", "g"), "keys")
    left = prints.select("k", "size", "content", "f", F.explode(F.array_distinct("win")).alias("h")).join(keys.select("k", "size", "h").distinct(), ["k", "size", "h"], "left_semi")
    left = left.withColumn("b", F.explode(blocks_of(F.col("f"), radius)))
    right = keys.withColumn("b", F.explode(blocks_of(F.col("g"), radius)))
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("g")))
    near = left.join(right, ["k", "size", "h", "b"]).where(distance <= radius)
    near = shared_table(near.select("k", "size", "content", "item", distance.alias("distance")).distinct(), "near")
    # weighted similarity: the pair's shingles on both sides, one row each
    pair = ["k", "size", "content", "item", "distance"]
    counts = prints.select("k", "size", "content", F.explode("win").alias("h")).groupBy("k", "size", "content", "h").agg(F.count("*").alias("c"))
    none, no_weight = F.lit(0).cast("long"), F.lit(None).cast("double")
    ours = near.join(known.select("item", "h", "w", "c"), "item").select(*pair, "h", F.col("c").alias("a"), none.alias("b"), "w")
    theirs = near.join(counts, ["k", "size", "content"]).join(df.withColumnRenamed("w", "any"), ["k", "h"], "left").select(*pair, "h", none.alias("a"), F.col("c").alias("b"), F.coalesce("any", F.lit(1.0)).alias("w"))
    each = ours.unionByName(theirs).groupBy(*pair, "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("w").alias("w"))
    means = known.groupBy("item").agg((F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("mean"))
    either = F.when(F.col("a") > 0, F.col("w") * F.greatest("a", "b")).otherwise(F.col("b") * F.least("mean", "w"))
    rated = each.join(means, "item").groupBy(*pair).agg((F.sum(F.col("w") * F.least("a", "b")) / F.sum(either)).alias("similarity"))
    good = rated.where(F.col("similarity") >= similarity - 1e-12).join(bench.select("item", "item_id"), "item").drop("item")
    found = windows.select("doc_id", "text_hash", "k", "size", "start", "content").distinct().join(good, ["k", "size", "content"])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "size", "distance")).alias("b")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("start_word"), F.col("b.size").alias("n_words"), F.col("b.distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window similar to a benchmark item."""
    return without(docs, find(docs, benchmark))
