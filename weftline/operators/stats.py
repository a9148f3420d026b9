"""The canonical stages: POW, MULTIPLY, SUM, RANGE, and STATISTICS composed of mapped calls over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pow_(value: Column, exponent: Column | float) -> Column:
    return F.pow(value, F.lit(exponent) if not isinstance(exponent, Column) else exponent)


def multiply(a: Column, b: Column) -> Column:
    return a * b


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def range_(begin: Column, end: Column) -> Column:
    """Half-open; empty where end <= begin."""
    return F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))


def statistics(values: Column) -> dict[str, Column]:
    """len, mean, variance and population deviation of an array, from mapped calls."""
    n = F.size(values).cast("long")
    mean = F.when(n > 0, multiply(total(values), 1 / n))
    variance = F.when(n > 0, multiply(total(F.transform(values, lambda x: pow_(x - mean, 2))), 1 / n))
    return {"n": n, "mean": mean, "variance": variance, "std_dev": pow_(variance, 0.5)}


def statistics_fused(value: Column) -> dict[str, Column]:
    """The same as aggregates, which combine within map tasks."""
    return {"n": F.count(value), "mean": F.avg(value), "variance": F.var_pop(value), "std_dev": F.stddev_pop(value)}


def merge_dicts(left: Column, right: Column) -> Column:
    """The right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
