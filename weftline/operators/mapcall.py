"""Mapped calls: over arrays and maps, zipped, nested, gathered in order.

Two ways are offered. Where the callable is a Column function, ``over_array`` and
``over_map`` keep the collection in its row: no shuffle. Where it is a DataFrame
function, ``fork`` makes a row an element and ``gather`` puts the results back,
so that NULL, empty and full collections stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def over_array(values: Column, call: Callable[[Column, Column], Column]) -> Column:
    """[call(element, index), ...]; NULL gives NULL, [] gives []."""
    return F.transform(values, call)


def over_map(values: Column, call: Callable[[Column, Column], Column]) -> Column:
    """{key: call(key, value), ...} with the same keys."""
    return F.transform_values(values, call)


def zipped(**arrays: Column) -> Column:
    """Arrays in lock-step as structs. Lengths must be equal; any NULL array gives NULL."""
    names, (first, *rest) = list(arrays), list(arrays.values())
    even = F.lit(True)
    for other in rest:
        even = even & (F.size(first) == F.size(other))
    kind = F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))
    together = F.transform(kind, lambda z: F.struct(*(z[n].alias(n) for n in names)))
    known = F.lit(True)
    for a in arrays.values():
        known = known & a.isNotNull()
    return F.when(known & even, together).when(known, F.raise_error(F.concat(F.lit("mapped over arrays of different lengths: "), *_joined([F.size(a).cast("string") for a in arrays.values()]))))


def _joined(parts: list[Column]) -> list[Column]:
    return [c for i, p in enumerate(parts) for c in ([F.lit(", ")] if i else []) + [p]]


def zipped_maps(left: Column, right: Column) -> Column:
    """Maps of equal key sets as a map of structs (l, r)."""
    same = F.array_sort(F.map_keys(left)) == F.array_sort(F.map_keys(right))
    both = F.map_zip_with(left, right, lambda _, a, b: F.struct(a.alias("l"), b.alias("r")))
    return F.when(same, both).when(left.isNotNull() & right.isNotNull(), F.raise_error(F.lit("mapped over maps with different keys")))


def zipped_by_key(**maps: Column) -> Column:
    """Maps of equal key sets in lock-step: a map of structs. Any NULL map gives NULL."""
    first, *rest = maps.values()
    even, known = F.lit(True), first.isNotNull()
    for other in rest:
        even = even & (F.array_sort(F.map_keys(first)) == F.array_sort(F.map_keys(other)))
        known = known & other.isNotNull()
    together = F.transform_values(first, lambda k, v: F.struct(*((v if m is first else m[k]).alias(n) for n, m in maps.items())))
    return F.when(known & even, together).when(known, F.raise_error(F.lit("mapped over maps with different keys")))


def mismatch(*sizes: Column) -> Column:
    """The error text of a zip over collections of these sizes, else NULL."""
    first, *rest = sizes
    odd = F.lit(False)
    for s in rest:
        odd = odd | (s != first)
    return F.when(odd, F.concat(F.lit("length mismatch: "), *_joined([s.cast("string") for s in sizes])))


def fork(df: DataFrame, source: str, item: str = "item") -> DataFrame:
    """A row an element: fork_ix (and fork_key of a map), item. Empty and NULL collections keep one row with a NULL fork_ix."""
    others = [c for c in df.columns if c != source]
    if dict(df.dtypes)[source].startswith("map"):
        entries = F.array_sort(F.map_entries(source))
        got = df.select(*others, F.col(source).isNull().alias("fork_null"), F.posexplode_outer(entries).alias("fork_ix", "_entry"))
        return got.select(*others, "fork_null", "fork_ix", F.col("_entry.key").alias("fork_key"), F.col("_entry.value").alias(item))
    return df.select(*others, F.col(source).isNull().alias("fork_null"), F.posexplode_outer(source).alias("fork_ix", item))


def gather(forks: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """One row for each key: the results in fork order (or by fork key); NULL results stay in place, empty gives [] and NULL gives NULL."""
    keyed = "fork_key" in forks.columns
    entry = F.struct("fork_ix", *(["fork_key"] if keyed else []), F.col(value).alias("v"))
    got = forks.groupBy(*keys).agg(F.max("fork_null").alias("_null"), F.sort_array(F.collect_list(F.when(F.col("fork_ix").isNotNull(), entry))).alias("_all"))
    merged = F.map_from_entries(F.transform("_all", lambda e: F.struct(e["fork_key"], e["v"]))) if keyed else F.transform("_all", lambda e: e["v"])
    return got.select(*keys, F.when(~F.col("_null"), merged).alias(out))


def product(dims: dict[str, Column]) -> Column:
    """All forks of nested mapped calls over independent arrays, the first varying fastest, as structs of elements with ``fork_ix``."""
    names = list(dims)
    total, strides = F.lit(1), {}
    for n in names:
        strides[n] = total
        total = total * F.size(dims[n])
    indices = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(indices, lambda i: F.struct(i.alias("fork_ix"), *(F.get(dims[n], (F.floor(i / strides[n]) % F.size(dims[n])).cast("int")).alias(n) for n in names)))


def nested(outer: Column, inner: Callable[[Column, Column, Column], Column], of: Callable[[Column], Column]) -> Column:
    """A ragged nested call: for each element of outer, inner(element, outer index, inner index) over of(element)."""
    return F.transform(outer, lambda o, i: F.transform(of(o), lambda x, j: inner(x, i, j)))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two mapped results over one root, joined fork by fork."""
    return left.join(right, [*keys, "fork_ix"], "inner")


def fuse(*calls: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Split of a merge: consecutive mapped calls over the same forks as one call, with no gather between."""

    def call(x: Column, _: Column) -> Column:
        for c in calls:
            x = c(x)
        return x

    return call


def element(values: Column, index: Column | int, strict: bool = True) -> Column:
    """The element at a 0-based index (or of a map key); NULL of a NULL collection; beyond the end an error, or NULL if not strict."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.when(at < F.size(values), F.get(values, at)).when(values.isNotNull() & F.lit(strict), F.raise_error(F.lit("index out of range")))


def fork_key_name(key: Column) -> Column:
    """fork_<key> of a map's fork, percent escaped."""
    from ..functions.scalar import path_escape

    return F.concat(F.lit("fork_"), path_escape(key))


def fork_name(index: Column, size: Column) -> Column:
    """forkN with leading zeros for the width of the last index."""
    width = F.length(F.greatest(size - 1, F.lit(0)).cast("string"))
    return F.concat(F.lit("fork"), F.lpad(index.cast("string"), width, "0"))
