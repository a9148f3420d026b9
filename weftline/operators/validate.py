"""Validation of inputs and outputs against declared types, with all errors and alarms collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TypeId, Types
from .expr import let

LEVELS = ("disable", "log", "alarm", "error")


class Assertion(Exception):
    """A stage's own check failed: it is never retried."""


class StageError(Exception):
    """A stage failed in another way; it may be retried."""


def none() -> Column:
    return F.array().cast("array<string>")


def scalar_errors(value: Column, name: str, at: str) -> Column:
    """An array of the error text, if a VARIANT isn't a legal ``name``, behind ``at``. NULL is always legal."""
    kind = F.schema_of_variant(value)
    number, whole = "BIGINT|DOUBLE|DECIMAL|INT", F.try_variant_get(value, "$", "double")
    legal = {
        "int": kind.isin("BIGINT", "VOID") | (kind.rlike(f"^({number})") & (whole == F.floor(whole))),
        "float": kind.rlike(f"^(VOID|{number})"),
        "bool": kind.isin("BOOLEAN", "VOID"),
        "map": kind.rlike("^(VOID|OBJECT)"),
    }.get(name, kind.isin("STRING", "VOID"))
    return F.when(legal | value.isNull(), none()).otherwise(F.array(F.concat(F.lit(f"{at}not a legal {name}: "), kind)))


def joined(*parts: Column) -> Column:
    """The arrays one after another. In lambdas, which are interpreted, flatten costs less than concat."""
    return F.flatten(F.array(*parts).cast("array<array<string>>"))


def object_type(names: Sequence[str]) -> str:
    """The Spark type that reads an object's members in one pass: NULL for what is no object; a member is NULL only where it is missing."""
    quoted = ("`{}`: variant".format(n.replace("`", "``")) for n in names)
    return f"struct<{', '.join(quoted)}>"


def members_of(read: Column, names: Sequence[str], array: bool = False) -> tuple[Column, list[str]]:
    """What was read as ``object_type`` (``array``: as an array of it), and the names of its fields: places if the members' names differ by case alone, which Spark ignores."""
    if len({n.lower() for n in names}) == len(names):
        return read, list(names)
    places = [f"_{i}" for i in range(len(names))]
    kind = object_type(places)
    return read.cast(f"array<{kind}>" if array else kind), places


def variant_errors(value: Column, t: TypeId, types: Types, path: str = "") -> Column:
    """An array of error texts with paths for a VARIANT against a type; empty where it is valid.

    ``value`` stands in the result several times, so it should be cheap: a column, a lambda's
    variable or a field of one. Members are read once for an object, those of an array's objects
    together, and the kind of a whole subtree only where the subtree isn't what was declared.
    """
    at = f"{path}: " if path else ""
    element = t.element() if t.array_dim or t.map_dim else None

    def other(wanted: str) -> Column:
        null = value.isNull() | (F.schema_of_variant(value) == "VOID")
        return F.when(null, none()).otherwise(F.array(F.lit(f"{at}not {wanted}")))

    def each(items: Column, path: str) -> Column:
        return F.flatten(F.transform(items, lambda x: variant_errors(x, element, types, path)))

    if t.array_dim and element.name in types.structs and not element.array_dim and not element.map_dim:
        names = list(types.structs[element.name])
        items, fields = members_of(F.try_variant_get(value, "$", f"array<{object_type(names)}>"), names, array=True)

        def objects(items: Column) -> Column:
            void = F.when(F.exists(items, lambda x: x.isNull()), F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "VOID"))
            no_object = F.array(F.lit(f"{path}[]: not a {element}"))

            def one(void: Column, x: Column, i: Column) -> Column:
                return F.when(x.isNotNull(), member_errors(x, fields, element.name, types, f"{path}[]")).when(F.get(void, i), none()).otherwise(no_object)

            return let(void, lambda v: F.flatten(F.transform(items, lambda x, i: one(v, x, i))))

        return F.coalesce(let(items, objects), other(f"an array of {element}"))
    if t.array_dim:
        return F.coalesce(each(F.try_variant_get(value, "$", "array<variant>"), f"{path}[]"), other(f"an array of {element}"))
    if t.map_dim:
        items = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        return F.coalesce(each(items, f"{path}{{}}"), other(f"a map of {element}"))
    if t.name in types.structs:
        names = list(types.structs[t.name])
        read, fields = members_of(F.try_variant_get(value, "$", object_type(names)), names)
        return let(read, lambda x: F.when(x.isNotNull(), member_errors(x, fields, t.name, types, path)).otherwise(other(f"a {t.name}")))
    return scalar_errors(value, t.name, at)


def member_errors(read: Column, fields: Sequence[str], name: str, types: Types, path: str) -> Column:
    """The errors of the members of a struct ``name``, read as ``fields``."""
    at, under = (f"{path}: ", f"{path}.") if path else ("", "")
    return joined(
        *(
            F.when(read[f].isNull(), F.array(F.lit(f"{at}missing member {m}"))).otherwise(variant_errors(read[f], t, types, f"{under}{m}"))
            for f, (m, t) in zip(fields, types.structs[name].items(), strict=True)
        )
    )


@dataclass
class Report:
    errors: Column
    alarms: Column


def arguments(doc: Column, params: Mapping[str, TypeId], types: Types, optional: tuple[str, ...] = (), outputs: bool = False, parsed: bool = False) -> Report:
    """Checks a JSON object column against parameters: a missing one is an error, an unknown one an error (of outputs: an alarm). ``parsed``: doc is a VARIANT."""
    value = doc if parsed else F.try_parse_json(doc)
    known = [*params, *optional]

    def extra(v: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>"))
        return F.coalesce(F.transform(F.filter(keys, lambda k: ~k.isin(known)), lambda k: F.concat(F.lit("unexpected "), k)), none())

    def found(v: Column) -> Column:
        read, fields = members_of(F.try_variant_get(v, "$", object_type(list(params))), list(params))

        def each(x: Column) -> Column:
            parts = [
                F.when(x[f].isNull(), F.array(F.lit(f"missing {'output' if outputs else 'parameter'} {p}"))).otherwise(variant_errors(x[f], t, types, p))
                for f, (p, t) in zip(fields, params.items(), strict=True)
            ]
            return F.when(x.isNull(), F.array(F.lit("not an object"))).otherwise(joined(*parts, *(() if outputs else (extra(v),))))

        return let(read, each)

    errors = found(value) if parsed else let(value, found)
    return Report(errors, extra(value) if outputs else none())


def returns(outs: Mapping[str, Column], params: Mapping[str, TypeId], literals: tuple[str, ...] = ()) -> Column:
    """Errors of a pipeline's outputs: a missing one is an error; those bound to literals are trusted."""
    missing = [F.when(F.lit(p not in outs and p not in literals), F.lit(f"missing output {p}")) for p in params]
    return F.array_compact(F.array(*missing))


def collected(records: DataFrame, keys: Sequence[str], alarms: str, order: str) -> DataFrame:
    """Alarms over a run: how many, of how many records, and the first record that has one. Nothing stops for them."""
    n = F.size(alarms)
    return records.groupBy(*keys).agg(F.sum(n).cast("long").alias("alarms"), F.count("*").alias("records"), F.min(F.when(n > 0, F.col(order))).alias("first"))


def enforce(errors: Column, level: str) -> Column:
    """The policy: ``error`` raises where there are errors, ``alarm`` and ``log`` keep them, ``disable`` drops them."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    if level == "disable":
        return F.array().cast("array<string>")
    if level == "error":
        return F.when(F.size(errors) == 0, errors).otherwise(F.raise_error(F.array_join(errors, "; ")).cast("array<string>"))
    return errors


def preflight(check: Column, message: str):
    """A Column that raises an assertion's message where the check doesn't hold."""
    return F.when(F.coalesce(check, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"ASSERT: {message}")).cast("boolean"))
