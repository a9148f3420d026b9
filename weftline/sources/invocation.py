"""Arguments and invocations: JSON in and out, environment variables, zipped metadata."""

from __future__ import annotations

import dataclasses
import io
import json
import os
import string
import types as python_types
import typing
import zipfile
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import Call, CompileError, Program, Split, refs
from ..types import TypeId, Types


def schema_of(params: Mapping[str, TypeId], types: Types) -> T.StructType:
    return T.StructType([T.StructField(n, types.to_spark(t), True, types.file_note(t)) for n, t in params.items()])


def read_args(spark: SparkSession, path: str, params: Mapping[str, TypeId], types: Types, limit: int | None = None) -> DataFrame:
    """A row a JSON document; documents over ``limit`` bytes are an error."""
    docs = spark.read.text(path, wholetext=True)
    if limit is not None:
        small = F.when(F.octet_length("value") <= limit, F.col("value")).otherwise(F.raise_error(F.lit(f"a document is over {limit} bytes")).cast("string"))
        docs = docs.select(small.alias("value"))
    return docs.select(F.from_json("value", schema_of(params, types)).alias("a")).select("a.*")


def parse_args(doc: Column, params: Mapping[str, TypeId], types: Types) -> Column:
    """A JSON column as a struct of the parameters; a missing argument is NULL."""
    return F.from_json(doc, schema_of(params, types))


def to_invocation(df: DataFrame) -> DataFrame:
    """Each row as an invocation document, NULLs written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("invocation"))


def split_args(doc: str) -> tuple[dict, list[str]]:
    """Arguments of an invocation document, ``{"split": ...}`` unwrapped, and the names that are split."""
    given = json.loads(doc)
    mapped = [k for k, v in given.items() if isinstance(v, dict) and set(v) == {"split"}]
    return {k: v["split"] if k in mapped else v for k, v in given.items()}, mapped


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole documents, unparsed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def call_of(program: Program, target: str, doc: str) -> Call:
    """A top call of an invocation document: a missing argument is null, ``{"split": ...}`` is mapped over, and one that isn't a parameter is an error."""
    given, mapped = split_args(doc)
    params = program.callables[target].inputs
    if unknown := sorted(given.keys() - params.keys()):
        raise CompileError(f"{target} has no parameters {unknown}")
    return Call(target, {p: Split(given[p]) if p in mapped else given.get(p) for p in params})


def document_of(call: Call) -> str:
    """The invocation document of a call whose arguments are values."""
    if any(refs(v) for v in call.bindings.values()):
        raise CompileError(f"{call.id} isn't a top call: it refers to other calls")
    return json.dumps({p: {"split": v.value} if isinstance(v, Split) else v for p, v in call.bindings.items()})


def expand_env(source: str, env: Mapping[str, str] | None = None) -> str:
    """``$NAME`` and ``${NAME}`` replaced; unknown names become empty."""

    class Env(dict):
        def __missing__(self, key: str) -> str:
            return ""

    return string.Template(source).safe_substitute(Env(os.environ if env is None else env))


def from_zip(df: DataFrame, member: str) -> DataFrame:
    """(path, text) of a member of each zip file in a binaryFile frame (path, content)."""

    def read(content: bytes) -> str | None:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(member).decode("utf-8") if member in z.namelist() else None

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        return contents.map(read)

    return df.select("path", text("content").alias("text"))


_PLAIN = {int: "int", float: "float", str: "string", bool: "bool"}


def hinted(kind: type, types: Types) -> TypeId:
    """The type of a type hint; a dataclass in it is declared as a struct of its name."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, python_types.UnionType):
        (kind,) = (a for a in args if a is not type(None))
        return hinted(kind, types)
    if origin is list:
        return hinted(args[0], types).mapped("array")
    if origin is dict and args[0] is str:
        return hinted(args[1], types).mapped("map")
    if dataclasses.is_dataclass(kind):
        types.add(kind.__name__, params_of(kind, types))
        return TypeId(kind.__name__)
    if kind not in _PLAIN:
        raise TypeError(f"{kind} has no type here")
    return TypeId(_PLAIN[kind])


def params_of(cls: type, types: Types) -> dict[str, TypeId]:
    """A dataclass's fields with the types of their hints."""
    return {name: hinted(kind, types) for name, kind in typing.get_type_hints(cls).items()}


def from_dataclasses(spark: SparkSession, cls: type, rows: list, types: Types) -> DataFrame:
    """Instances of a dataclass as typed rows, the schema from its hints."""
    return from_objects(spark, [dataclasses.asdict(r) for r in rows], params_of(cls, types), types)


def from_objects(spark: SparkSession, rows: list, params: Mapping[str, TypeId], types: Types) -> DataFrame:
    """Python objects or dicts as typed rows."""
    plain = [r if isinstance(r, dict) else vars(r) for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in params) for r in plain], schema_of(params, types))
