"""split / main / join: scatter into chunks, a call a chunk, gather.

The declarative way (``run``) makes join an aggregate, so Spark combines within
map tasks and a fork's chunks never meet in one row. ``run_ordered`` is the
general way: chunk outputs as arrays in chunk order, for joins that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = ("__threads", "__mem_gb", "__vmem_gb", "__special")


def overlay(stage: Mapping[str, Column], chunk: Mapping[str, Column]) -> dict[str, Column]:
    """Arguments of a chunk: the stage's, overridden by the chunk's; reserved resource keys are taken out."""
    return {k: v for k, v in {**stage, **chunk}.items() if k not in RESERVED}


def resources(chunk: Mapping[str, Column]) -> dict[str, Column]:
    return {k: v for k, v in chunk.items() if k in RESERVED}


def run(chunks: DataFrame, keys: Sequence[str], main: Mapping[str, Column], join: Mapping[str, Column], forks: DataFrame | None = None, empty: Mapping[str, object] = {}) -> DataFrame:  # noqa: B006
    """A row a fork. ``chunks`` has a row a chunk; with ``forks`` a fork without chunks is joined too, with the values of ``empty``."""
    outs = chunks.select(*keys, *(c.alias(n) for n, c in main.items())).groupBy(*keys).agg(*(c.alias(n) for n, c in join.items()))
    if forks is None:
        return outs
    return forks.join(outs, list(keys), "left").withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in empty.items()})


def run_ordered(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], main: Mapping[str, Column], join: Callable[[Column], Column], out: str) -> DataFrame:
    """join(array of chunk outputs, ordered by chunk)."""
    entry = F.struct(*order, F.struct(*(c.alias(n) for n, c in main.items())).alias("_out"))
    got = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    return got.select(*keys, join(F.transform("_all", lambda e: e["_out"])).alias(out))


def chunk_array(values: Column, size: int) -> Column:
    """An array cut into chunks of at most ``size``."""
    n = F.ceil(F.size(values) / F.lit(size)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i * size + 1, size))
