"""Outputs: defaults, file names, typed JSON, and final files laid out like the value they belong to."""

from __future__ import annotations

import json
import os
import shutil
import zipfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TypeId, Types


def out_name(name: str, t: TypeId, types: Types, given: str = "") -> str:
    """The given name, else the output's (with its file type as extension, where it is one file of a named type)."""
    if given:
        return given
    single = not t.array_dim and not t.map_dim and t.name in types.filetypes
    return f"{name}.{t.name}" if single else name


def default_outs(params: Mapping[str, TypeId], types: Types, folder: str) -> dict[str, Column]:
    """Arrays and maps empty, files at their default path, all else NULL."""
    out = {}
    for name, t in params.items():
        kind = types.to_spark(t)
        if t.array_dim:
            out[name] = F.array().cast(kind)
        elif t.map_dim:
            out[name] = F.create_map().cast(kind)
        elif types.is_file(t.name):
            out[name] = F.lit(os.path.join(folder, out_name(name, t, types)))
        else:
            out[name] = F.lit(None).cast(kind)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """One typed JSON document a row, NULLs written out; Spark's committer makes the write atomic."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_atomic(path: str, value: object) -> None:
    """A driver-side document, complete or absent."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=4)
    os.replace(f"{path}.tmp", path)


def place_outputs(value: object, t: TypeId, types: Types, target: str, move: bool = True) -> object:
    """Moves the files of a value under ``target`` in folders of the value's shape; returns the value with new paths, NULL for a missing file."""
    if value is None:
        return None
    if t.array_dim or t.map_dim:
        inner = t.element()
        if types.contains_files(inner) not in ("file", "directory"):
            return value
        pairs = enumerate(value) if t.array_dim else sorted(value.items())
        width = len(str(max(len(value) - 1, 0)))
        placed = {k: place_outputs(v, inner, types, os.path.join(target, f"{k:0{width}d}" if t.array_dim else k), move) for k, v in pairs}
        return list(placed.values()) if t.array_dim else placed
    if t.name in types.structs:
        return {k: place_outputs(value.get(k), m, types, os.path.join(target, out_name(k, m, types)), move) for k, m in types.structs[t.name].items()}
    if not types.is_file(t.name):
        return value
    if not os.path.lexists(value):
        return None
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.islink(value):
        os.symlink(os.readlink(value), target)
    elif move:
        shutil.move(value, target)
    elif os.path.isdir(value):
        shutil.copytree(value, target)
    else:
        shutil.copy2(value, target)
    return target


def summary(value: Mapping[str, object], names: Mapping[str, str] = {}, indent: str = "") -> str:  # noqa: B006
    """Outputs as aligned lines; names gives display names."""
    width = max((len(names.get(k, k)) for k in value), default=0)
    lines = []
    for k, v in value.items():
        label = f"{indent}- {names.get(k, k) + ':':<{width + 1}}"
        if isinstance(v, Mapping) and v:
            lines += [label.rstrip(), summary(v, {}, indent + "  ")]
        elif isinstance(v, list) and v:
            lines += [label.rstrip(), summary({str(i): x for i, x in enumerate(v)}, {}, indent + "  ")]
        else:
            lines.append(f"{label} {'null' if v is None else v}")
    return "\n".join(lines)


def zip_folder(folder: str, to: str) -> None:
    """All files below a folder in one archive, which then appears at once."""
    with zipfile.ZipFile(f"{to}.tmp", "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(folder):
            for f in sorted(files):
                path = os.path.join(top, f)
                z.write(path, os.path.relpath(path, folder))
    os.replace(f"{to}.tmp", to)
