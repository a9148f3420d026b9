"""Scalar behaviours of the runtime as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that Windows keeps for devices (fixed values).
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(10)), *(f"LPT{i}" for i in range(10)))


def int_from_float(value: Column) -> Column:
    """The integer of an integral number, else NULL."""
    return F.when(value == F.floor(value), value.cast("long"))


def legal_unix_name(name: Column) -> Column:
    """At most 255 bytes, not empty, ``.`` or ``..``, without ``/`` and NUL."""
    return (F.octet_length(name) <= 255) & ~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\0")


def legal_output_name(name: Column) -> Column:
    """A Unix name that Windows takes too: no reserved character or device, no space or dot at its end."""
    stem = F.upper(F.substring_index(name, ".", 1))
    return legal_unix_name(name) & ~name.rlike(r'[<>:"\\|?*\x01-\x1f]') & ~name.rlike(r"[ .]$") & ~stem.isin(*DEVICES)


def path_escape(text: Column) -> Column:
    """Percent escapes of a path segment: a space is %20 and ``$&+=:@`` stay."""
    out = F.url_encode(text)
    for given, kept in (("\\+", "%20"), ("%24", "\\$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("\\*", "%2A")):
        out = F.regexp_replace(out, given, kept)
    return out


def zero_pad(index: Column, size: Column) -> Column:
    return F.lpad(index.cast("string"), F.length(F.greatest(size - 1, F.lit(0)).cast("string")), "0")


def round_up(value: Column, parts: int) -> Column:
    """Away from zero to a multiple of 1/parts."""
    scaled = value * parts
    return F.when(value >= 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / parts


def sanitise(value: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def partial_name(name: Column) -> Column:
    """A dotted name without its first two components."""
    return F.array_join(F.slice(F.split(name, r"\."), 3, 1 << 20), ".")


def inside(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


JOURNAL = r"^(.*)\.fork([^.]*)(?:\.chnk(\d+))?(?:\.u([0-9a-f]+))?\.(\w+)$"


def journal_parts(name: Column) -> Column:
    """(node, fork, chunk, uniquifier, state) of a journal file's name."""
    part = lambda i: F.nullif(F.regexp_extract(name, JOURNAL, i), F.lit(""))
    return F.struct(*(part(i).alias(n) for i, n in enumerate(("node", "fork", "chunk", "uniquifier", "state"), 1)))


def classify(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first pattern that matches."""
    out = F.lit(default)
    for pattern, kind in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s")))


def strings_inside(text: Column) -> Column:
    """All string values of a JSON document, at any depth, with their escapes resolved."""
    quoted = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'), F.lit(0))
    values = F.filter(quoted, lambda q: q.endswith('"'))
    return F.transform(values, lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string"))


def digits_wide(n: Column) -> Column:
    """How many characters the largest index of n takes."""
    return F.length(F.greatest(n - 1, F.lit(0)).cast("string"))


def stamp(ts: Column) -> Column:
    """A time as log lines begin with it."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def aliases(path: Column, links: Column) -> Column:
    """The path under every alias of a folder above it: links is an array of (folder, alias)."""
    hit = F.filter(links, lambda x: inside(path, x["folder"]))
    return F.array_distinct(F.concat(F.array(path), F.transform(hit, lambda x: F.concat(x["alias"], F.substring(path, F.length(x["folder"]) + 1, F.length(path))))))


def clean_bytes(value: Column) -> Column:
    """Bytes as UTF-8 text, bad ones left out."""
    return F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(value.cast("string"))), "\ufffd", "")
