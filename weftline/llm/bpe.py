"""Byte-level BPE: encoding by forced boundaries, and decoding.

A byte pair that stands inside no vocabulary token can never be merged: the text
may be cut between its two bytes, and the fragments encoded independently, if the
splitting pattern then sees the same pieces. It does wherever the byte before the
cut ends no white space (whose pieces depend on what follows) and the cut makes no
new contraction, which begins with an apostrophe; a cut inside a run of letters,
digits or signs leaves two shorter runs. So a table of 65,536 byte pairs gives
every cut, at one lookup a byte; a fragment is about a word, or a part of one.
Fragments repeat, so each worker keeps a bounded cache of their ids.

Texts of any length and script are encoded whole; a text without a certain cut is
one fragment. Strings of special tokens become their ids; the text between them
is encoded as above. Null text counts as empty and has no ids; input columns
other than the two named ones don't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import emit, pick

#: The splitting pattern of the byte-level vocabularies (a fixed value of their format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments that a worker keeps, and the longest of them in bytes.
CACHE, CACHED_BYTES = 500_000, 48
#: Last bytes of white space characters, of one byte and of several.
_WHITE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands in no UTF-8.
_MARK = 0xFF


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """One vocabulary file (JSON of the tokenizers library), ready to encode and decode."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.core = tiktoken.Encoding("weftline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        #: inside[a << 8 | b]: the pair (a, b) stands inside some token.
        self.inside = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8).astype(np.uint32)
            self.inside[t[:-1] << 8 | t[1:]] = True
        #: cuts[a << 8 | b]: between bytes a and b a cut is certain, in a text without wide white space and in any text.
        self.cuts = self._cuts(())
        self.careful = self._cuts(tuple({w.encode()[-1] for w in _WIDE}))
        self.marked = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[bytes, bytes] = {b"": b""}

    def _cuts(self, wide: tuple[int, ...]) -> np.ndarray:
        cuts = ~self.inside.reshape(256, 256)
        cuts[[*_WHITE, *wide]] = False
        cuts[:, 0x80:0xC0] = False  # within a character
        signs = [b for b in range(128) if b not in _WHITE and not chr(b).isalnum()]
        cuts[[*signs, *range(128, 256)], ord("'")] = False  # in a run of signs the apostrophe opens no contraction
        cuts[ord("'")] = False
        cuts[_MARK] = cuts[:, _MARK] = False
        return cuts.ravel()

    def fragments(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The fragments of all texts, and how many each text has."""
        raws = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(bytes((_MARK,)).join(raws), np.uint8)
        plain = all(t.isascii() or not any(w in t for w in _WIDE) for t in texts)
        pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
        at = np.flatnonzero((self.cuts if plain else self.careful)[pairs]) + 1
        ends = np.cumsum([len(r) + 1 for r in raws])
        n = np.diff(np.searchsorted(at, ends), prepend=0) + 1
        return np.insert(data, at, _MARK).tobytes().split(bytes((_MARK,))), n

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain, whole = [], {}
        for i, text in enumerate(texts):
            if self.marked and "<" in text and self.marked.search(text):
                whole[i] = self._with_special(text)
                plain.append("")
            else:
                plain.append(text)
        if not plain:
            return []
        found, n = self.fragments(plain)
        ids = list(map(self.cache.get, found))
        if None in ids:
            own: dict[bytes, bytes] = {}
            for i in [i for i, x in enumerate(ids) if x is None]:
                if (got := own.get(f := found[i])) is None:
                    got = own[f] = np.array(self.core.encode_ordinary(f.decode("utf-8")), "<u4").tobytes()
                ids[i] = got
            if len(self.cache) < CACHE:
                self.cache.update((f, x) for f, x in own.items() if len(f) <= CACHED_BYTES)
        cuts = np.cumsum(n).tolist()
        out = [b"".join(ids[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
        for i, got in whole.items():
            out[i] = got
        return out

    def _with_special(self, text: str) -> bytes:
        """Ids of a text that holds strings of special tokens: what stands between them is encoded by itself."""
        parts, at = [], 0
        marks = []
        for m in self.marked.finditer(text):
            parts.append(text[at : m.start()])
            marks.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        found = self.encode([*parts, text[at:]])
        return b"".join(x for pair in zip(found, [*marks, b""], strict=True) for x in pair)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(path: str, rows: Iterator[tuple], chars: int = 1 << 20) -> Iterator[tuple[int, str, bytes]]:
    """(doc_id, text, ids) of (doc_id, text) rows; encodes about ``chars`` characters at a time."""
    bpe = load(path)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= chars or len(held) >= 4096:
            yield from ((d, t, x) for (d, t), x in zip(held, bpe.encode([t for _, t in held]), strict=True))
            held, size = [], 0
    yield from ((d, t, x) for (d, t), x in zip(held, bpe.encode([t for _, t in held]), strict=True))


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, one row for each input row; repeated rows and null ids stay."""
    from .common import text_rows

    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, np.frombuffer(x, "<i4")) for d, _, x in encoded(path, text_rows(batches)))
        return emit(schema, rows, lambda r: 4 * len(r[1]))

    return pick(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        rows = ((d, bpe.decode(np.asarray(x if x is not None else [], dtype=np.int64))) for b in batches for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        return emit(schema, rows, lambda r: len(r[1]))

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
