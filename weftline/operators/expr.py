"""Projection through nesting, structural narrowing, wildcard binding and conditional values, as Column builders."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value in the plan once."""
    return F.get(F.transform(F.array(value), body), 0)


def project(value: Column, kind: T.DataType, path: Sequence[str]) -> tuple[Column, T.DataType]:
    """value.path with arrays and maps on the way kept around the result; NULLs pass through."""
    if not path:
        return value, kind
    if isinstance(kind, T.ArrayType):
        inner = project(F.lit(None), kind.elementType, path)[1]
        return F.transform(value, lambda x: project(x, kind.elementType, path)[0]), T.ArrayType(inner)
    if isinstance(kind, T.MapType):
        inner = project(F.lit(None), kind.valueType, path)[1]
        if _has_map(inner):
            raise TypeError(f"projecting {'.'.join(path)} through a map would nest maps")
        return F.transform_values(value, lambda _, v: project(v, kind.valueType, path)[0]), T.MapType(kind.keyType, inner)
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise KeyError(f"{kind.simpleString()} has no member {path[0]}")
    return project(value.getField(path[0]), kind[path[0]].dataType, path[1:])


def _has_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def path_of(df: DataFrame, dotted: str) -> Column:
    """A column for a dotted path of df."""
    first, *rest = dotted.split(".")
    return project(df[first], df.schema[first].dataType, rest)[0]


def integral(value: Column) -> Column:
    """A number as an integer; a fraction is an error."""
    return F.when(value == F.floor(value), value.cast("long")).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not an integer: "), value.cast("string"))).cast("long"))


def narrow(value: Column, given: T.DataType, to: T.DataType) -> Column:
    """value rebuilt with only the members that ``to`` declares, in its order; structs widen to maps."""
    if given == to:
        return value
    if isinstance(to, T.StructType) and isinstance(given, T.StructType):
        missing = [n for n in to.names if n not in given.names]
        if missing:
            raise KeyError(f"missing members {missing}")
        parts = [narrow(value.getField(f.name), given[f.name].dataType, f.dataType).alias(f.name) for f in to]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(to, T.ArrayType) and isinstance(given, T.ArrayType):
        return F.transform(value, lambda x: narrow(x, given.elementType, to.elementType))
    if isinstance(to, T.MapType) and isinstance(given, T.MapType):
        return F.transform_values(value, lambda _, v: narrow(v, given.valueType, to.valueType))
    if isinstance(to, T.MapType) and isinstance(given, T.StructType):
        pairs = [c for f in given for c in (F.lit(f.name), narrow(value.getField(f.name), f.dataType, to.valueType))]
        return F.when(value.isNotNull(), F.create_map(*pairs))
    if isinstance(to, T.LongType) and isinstance(given, (T.DoubleType, T.FloatType)):
        return integral(value)
    if isinstance(to, T.DoubleType) and isinstance(given, T.IntegralType) or isinstance(to, T.LongType) and isinstance(given, T.IntegralType):
        return value.cast(to)
    raise TypeError(f"{given.simpleString()} isn't assignable to {to.simpleString()}")


def wildcard(df: DataFrame, source: str | None, params: Sequence[str]) -> list[Column]:
    """``* = source``: the members (or, without a source, the columns) whose names are parameters; others are skipped."""
    if source is None:
        return [df[c] for c in df.columns if c in params]
    kind = df.schema[source].dataType
    while isinstance(kind, (T.ArrayType, T.MapType)):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    return [path_of(df, f"{source}.{n}").alias(n) for n in kind.names if n in params]


def disabled(value: Column, flag: Column) -> Column:
    """NULL where the flag holds. A NULL flag is an error: it may not be read as false."""
    return F.when(~guard(flag), value)


def guard(flag: Column) -> Column:
    return F.coalesce(flag, F.raise_error(F.lit("a disabled modifier is null")).cast("boolean"))


def inherited(*flags: Column) -> Column:
    """A call is disabled if it or any pipeline around it is; an outer flag spares the inner ones their null check."""
    *outer, last = flags
    out = guard(last)
    for flag in reversed(outer):
        out = F.when(guard(flag), F.lit(True)).otherwise(out)
    return out


def disabled_each(values: Column, flags: Column) -> Column:
    """Element-wise ``disabled`` over arrays of one length."""
    from .mapcall import zipped

    return F.transform(zipped(v=values, d=flags), lambda z: disabled(z["v"], z["d"]))


def json_path(text: Column, path: str) -> Column:
    """An untyped path into a JSON document as text; scalars are their text, a missing field is NULL."""
    return F.get_json_object(text, "$." + path)


def json_path_mapped(text: Column, path: str) -> Column:
    """``json_path`` with arrays on the way mapped over, at any depth: the result is JSON text, in which a missing field is null. A scalar on the way stands for itself. Built-in functions can't map over arrays of unknown depth, so this one runs in Arrow batches."""
    parts = path.split(".")

    def step(value: object, at: int) -> object:
        if isinstance(value, list):
            return [step(v, at) for v in value]
        return step(value.get(parts[at]), at + 1) if isinstance(value, dict) and at < len(parts) else value

    def one(doc: str | None) -> str | None:
        return None if doc is None else json.dumps(step(json.loads(doc), 0), separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(one)

    return run(text)
