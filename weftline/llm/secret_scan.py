"""Secret scans: patterns, and the token efficiency of random strings.

Three patterns find assignments, access keys and hexadecimal strings. Beside
them, the token-efficiency test looks at runs of 20 or more characters out of
``A-Za-z0-9+/_=-``: text that a vocabulary has learned gives many characters a
token, a random string few. Runs with under EFFICIENCY characters a token are
reported as ``random``, unless they are known digests (hexadecimal of a digest's
length, UUIDs), identifiers (words and numbers joined by ``_``, ``-`` or ``/``,
where the words alone have KNOWN characters a token or more, or there are none)
or overlap a base span.

Spans are in code points, end exclusive. Null and empty texts have no spans.
Repeated rows give equal rows; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, pick, text_rows

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters a token under which a run counts as random.
EFFICIENCY = 2.0
#: Characters a token from which an identifier's letters count as words.
KNOWN = 2.5
#: Hexadecimal lengths of CRC-64 to SHA-512 digests.
DIGESTS = {16, 32, 40, 48, 56, 64, 96, 128}
LETTERS = re.compile(r"[A-Za-z]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
IDENTIFIER = re.compile(r"([A-Za-z]+[0-9]{0,4}|[0-9]{1,8})([_/-]+([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[_/=-]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import base64

    import tiktoken

    from .bpe import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in ASSIGN_WORDS) else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def is_identifier(run: str, vocab) -> bool:
    """Whether a run is numbers and words that the vocabulary has learned."""
    parts = LETTERS.findall(run) if IDENTIFIER.fullmatch(run) else [run]
    return sum(map(len, parts)) >= KNOWN * sum(len(vocab.encode_ordinary(p)) for p in parts)


def random_spans(text: str, base: list[tuple[str, int, int]], vocab, efficiency: float) -> list[tuple[str, int, int]]:
    found = []
    for m in RUN.finditer(text):
        run = m[0].strip("=-_/+")
        a = m.start() + m[0].index(run) if run else m.start()
        b = a + len(run)
        if len(run) < 20 or any(a < y and x < b for _, x, y in base) or UUID.fullmatch(run):
            continue
        if len(run) in DIGESTS and all(c in "0123456789abcdefABCDEF" for c in run):
            continue
        if len(run) < efficiency * len(vocab.encode_ordinary(run)) and not is_identifier(run, vocab):
            found.append(("random", a, b))
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, path: str | None = None, efficiency: float = EFFICIENCY, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra[, text]): spans of the patterns, those that the method adds, and if asked the text with every span replaced by ``[SECRET]``."""
    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("base", _SPANS), ("extra", _SPANS), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        vocab = vocabulary(path)
        for doc, text in text_rows(batches):
            base = base_spans(text)
            extra = random_spans(text, base, vocab, efficiency)
            pack = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield doc, pack(base), pack(extra), redacted(text, base + extra) if redact else None

    got = pick(df, id_col, text_col).mapInArrow(lambda b: emit(schema, rows(b), lambda r: len(r[3] or "") + 64), f"doc_id long, base {SPANS}, extra {SPANS}, text string")
    return got if redact else got.drop("text")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every maximal run of spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None, efficiency: float = EFFICIENCY) -> DataFrame:
    """All rows and columns of docs, with every secret in text replaced, and n_chars (where there is one) counted anew for these."""
    path = path or default_vocabulary()
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(size).to_pylist() if size is not None else []
            changed = False
            for i, text in enumerate(texts):
                base = base_spans(text) if text else []
                spans = base + random_spans(text, base, vocab, efficiency) if text else []
                if spans:
                    changed, texts[i] = True, redacted(text, spans)
                    if lengths:
                        lengths[i] = len(texts[i])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if lengths:
                    batch = batch.set_column(size, batch.schema.field(size), pa.array(lengths, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s spans by start, then kind as listed."""
    order = F.expr(f"transform(array({', '.join(repr(k) for k in (*KINDS, 'random'))}), (k, i) -> named_struct('kind', k, 'at', i))")
    rank = lambda k: F.element_at(F.map_from_entries(order), k)

    def line(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s["kind"]).alias("r"), s["end"].alias("b"), s["kind"].alias("k"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "extra")).alias("spans"))


