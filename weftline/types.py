"""The type system: scalars, files, structs, arrays and string-keyed maps, all nullable.

A TypeId is a base name with the dimensions around it: ``T[][]`` has array_dim 2;
``map<T[]>[]`` is an array (array_dim 1) of maps (map_dim 1 + 1 inner array).
Maps of maps don't exist. ``to_spark`` gives the DataFrame type of a TypeId.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import types as T

SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "path": T.StringType(), "file": T.StringType(), "map": T.StringType()}


class TypeMismatch(TypeError):
    """A value of one type can't stand where another is declared."""


@dataclass(frozen=True)
class TypeId:
    name: str
    array_dim: int = 0
    map_dim: int = 0

    def __str__(self) -> str:
        inner = f"map<{self.name}{'[]' * (self.map_dim - 1)}>" if self.map_dim else self.name
        return inner + "[]" * self.array_dim

    @staticmethod
    def parse(text: str) -> TypeId:
        m = re.fullmatch(r"\s*(?:map<\s*([\w.]+)((?:\[\])*)\s*>|([\w.]+))((?:\[\])*)\s*", text)
        if not m:
            raise ValueError(f"not a type: {text!r}")
        mapped, inner, plain, outer = m.groups()
        return TypeId(mapped or plain, len(outer) // 2, 1 + len(inner) // 2 if mapped else 0)

    def element(self) -> TypeId:
        """What an array or map of this type holds."""
        if self.array_dim:
            return replace(self, array_dim=self.array_dim - 1)
        if self.map_dim:
            return TypeId(self.name, self.map_dim - 1, 0)
        raise TypeMismatch(f"{self} holds no elements")

    def mapped(self, over: str) -> TypeId:
        """The result type of a call of this result type that is mapped over an array or a map."""
        if over == "array":
            return replace(self, array_dim=self.array_dim + 1)
        if self.map_dim:
            raise TypeMismatch(f"mapping {self} over a map would nest maps")
        return TypeId(self.name, 0, self.array_dim + 1)


@dataclass
class Types:
    """Declared structs (name to ordered members) and file types."""

    structs: dict[str, dict[str, TypeId]]
    filetypes: frozenset[str] = frozenset()

    @staticmethod
    def of(structs: Mapping[str, Mapping[str, str]] = {}, filetypes: tuple[str, ...] = ()) -> Types:  # noqa: B006
        types = Types({}, frozenset(filetypes))
        for name, members in structs.items():
            types.add(name, {k: TypeId.parse(v) for k, v in members.items()})
        return types

    def add(self, name: str, members: dict[str, TypeId]) -> None:
        """An equal redefinition is tolerated; an empty struct, one that holds itself or a differing redefinition is an error."""
        if not members:
            raise ValueError(f"struct {name} has no members")
        if any(t.name == name for t in members.values()):
            raise ValueError(f"struct {name} contains itself")
        if self.structs.get(name, members) != members:
            raise ValueError(f"struct {name} is declared twice")
        self.structs[name] = members

    def to_spark(self, t: TypeId) -> T.DataType:
        if t.array_dim or t.map_dim:
            inner = self.to_spark(t.element())
            return T.ArrayType(inner) if t.array_dim else T.MapType(T.StringType(), inner)
        if t.name in SCALARS:
            return SCALARS[t.name]
        if t.name in self.filetypes:
            return T.StringType()
        if t.name in self.structs:
            return T.StructType([T.StructField(k, self.to_spark(m), True, self.file_note(m)) for k, m in self.structs[t.name].items()])
        raise ValueError(f"unknown type {t.name}")

    def file_note(self, t: TypeId) -> dict:
        """Column metadata that keeps which strings are files."""
        return {"filetype": t.name} if self.is_file(t.name) else {}

    def is_file(self, name: str) -> bool:
        return name in ("file", "path") or name in self.filetypes

    def contains_files(self, t: TypeId) -> str:
        """``no``, ``maybe`` (strings and untyped maps may hold paths), ``file`` or ``directory``."""
        if t.name in self.structs:
            kinds = {self.contains_files(m) for m in self.structs[t.name].values()}
            kind = "directory" if kinds & {"file", "directory"} else "maybe" if "maybe" in kinds else "no"
        else:
            kind = "file" if self.is_file(t.name) else "maybe" if t.name in ("string", "map") else "no"
        return "directory" if kind == "file" and (t.array_dim or t.map_dim) else kind

    def assignable(self, to: TypeId, given: TypeId) -> bool:
        """Whether a value of type ``given`` may be bound to ``to``."""
        if to == given or given.name == "null":
            return True
        if to == TypeId("map"):
            return given.array_dim == 0 and (given.map_dim > 0 or given.name in self.structs)
        if to.array_dim:
            return to.array_dim == given.array_dim and self.assignable(replace(to, array_dim=0), replace(given, array_dim=0))
        if given.array_dim:
            return False
        if to.map_dim:
            if given.map_dim:
                return self.assignable(to.element(), given.element())
            members = self.structs.get(given.name)
            return bool(members) and all(self.assignable(to.element(), m) for m in members.values())
        if given.map_dim:
            return False
        if to.name in self.structs:
            mine, theirs = self.structs[to.name], self.structs.get(given.name)
            return theirs is not None and all(k in theirs and self.assignable(t, theirs[k]) for k, t in mine.items())
        if to.name == "float":
            return given.name == "int"
        if to.name in ("file", "path"):
            return given.name == "string" or (given.name in self.filetypes and to.name == "file")
        if to.name == "string":
            return given.name in self.filetypes
        if to.name in self.filetypes:
            return given.name in ("file", "string")
        return False
