"""ISO media containers: writing them, walking their boxes, reading them back.

``store`` puts each document's bytes, losslessly, as frames of 24 x 24 8-bit
samples into an ISO base media file (ftyp, mdat, moov with nested boxes) and
keeps it in a binary column. ``probe`` walks the nested boxes of such a column,
decodes the sample tables (stts, stsz, stsc, stco/co64, stss) and the runs of
movie fragments (tfhd, tfdt, trun), and gives codec, size, duration and the byte
ranges of the key frames, and a line on every track; it looks at no payload.
``payloads`` then reads the stored frames by the sample tables.

An empty or null text is one frame of padding. A null, empty or broken container
gives a row with null features and ``error`` set; it fails no task: depth and all
counts are held against bounds before they are followed. Repeated
rows give equal values; the file has no times, so equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import emit, pick, shared_table, text_rows

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
PAD = b"\xff"
TIMESCALE, FRAME_TICKS = 25000, 1000
#: Frames in a chunk, and frames from one key frame to the next.
CHUNK, KEY_EVERY = 16, 12
#: Levels of nested boxes; the standard's files have about eight.
DEPTH = 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """An ISO media file whose frames are the payload, a multiple of FRAME bytes."""
    n = len(payload) // FRAME
    ticks = n * FRAME_TICKS
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = box(b"mdat", payload)
    first = len(head) + len(mdat) - len(payload)
    chunks = first + np.arange(-(-n // CHUNK), dtype=np.int64) * CHUNK * FRAME
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    last = n - (len(chunks) - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (len(chunks) > 1) + [(len(chunks), last, 1)] * (last != CHUNK or len(chunks) == 1)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    wide = len(chunks) and int(chunks[-1]) >= 1 << 32
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
        full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, TIMESCALE, ticks), struct.pack(">HH", 0x55C4, 0))
    mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return head + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of kinds, start, start of body, end) of every box, parents before children."""
    end = len(data) if end is None else end
    if len(path) > DEPTH:
        raise ValueError(f"boxes nested deeper than {DEPTH}")
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} reaches beyond what holds it")
        yield (*path, kind), start, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def table(data: bytes, at: int, end: int, width: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a counted table behind its 4 bytes of version and flags."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width * int(kind[-1]) > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, at + 8).reshape(n, width).astype(np.int64)


def samples(data: bytes, t: dict[bytes, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Offset, size and time of a track's samples by its sample tables, and which are key frames; counts are held against each other before anything is laid out by them."""
    at, end = t[b"stsz"]
    one, n = struct.unpack_from(">II", data, at + 4)
    if one * n > len(data):
        raise ValueError("samples larger than the file")
    sizes = np.full(n, one, np.int64) if one else table(data, at + 4, end, 1)[:, 0]
    chunks = table(data, *t[b"co64"], 1, ">u8")[:, 0] if b"co64" in t else table(data, *t[b"stco"], 1)[:, 0]
    runs = table(data, *t[b"stsc"], 3)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(runs) and (runs[0, 0] != 1 or (lengths < 1).any()) or int((runs[:, 1] * lengths).sum()) != n:
        raise ValueError("chunks and samples differ in number")
    in_chunk = np.repeat(runs[:, 1], lengths)
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(in_chunk) - in_chunk
    offsets = before + np.repeat(chunks - before[np.minimum(firsts, max(n - 1, 0))], in_chunk) if n else before
    stts = table(data, *t[b"stts"], 2)
    if int(stts[:, 0].sum()) != n:
        raise ValueError("times and samples differ in number")
    deltas = np.repeat(stts[:, 1], stts[:, 0])
    keys = table(data, *t[b"stss"], 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a key frame that isn't there")
    return {"offsets": offsets, "sizes": sizes, "times": np.cumsum(deltas) - deltas, "deltas": deltas, "keys": keys}


def fragments(data: bytes, boxes: list[tuple[tuple, int, int, int]], track: int) -> dict[str, np.ndarray]:
    """The samples of a track in the file's movie fragments."""
    defaults = (0, 0, 0)
    for path, _, at, _ in boxes:
        if path[-1] == b"trex" and struct.unpack_from(">I", data, at + 4)[0] == track:
            defaults = struct.unpack_from(">III", data, at + 12)
    rows: list[np.ndarray] = []
    moof = at_data = time = 0
    own, given = False, defaults
    for path, start, at, end in boxes:
        if path[-1] == b"moof":
            moof = at_data = start
        elif path[-1] == b"tfhd":
            flags, own = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0] == track
            at += 8
            if flags & 1:
                at_data, at = struct.unpack_from(">Q", data, at)[0], at + 8
            elif flags & 0x20000:
                at_data = moof
            at += 4 * (flags >> 1 & 1)
            found = []
            for k, bit in enumerate((8, 16, 32)):
                found.append(struct.unpack_from(">I", data, at)[0] if flags & bit else defaults[k])
                at += 4 * bool(flags & bit)
            given, base = tuple(found), at_data
        elif path[-1] == b"tfdt" and own:
            time = struct.unpack_from(">Q" if data[at] else ">I", data, at + 4)[0]
        elif path[-1] == b"trun":
            flags, n = struct.unpack_from(">II", data, at)
            at += 8
            if flags & 1:
                at_data, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first = struct.unpack_from(">I", data, at)[0] if flags & 4 else None
            at += 4 * bool(flags & 4)
            width = sum(bool(flags & b) for b in (0x100, 0x200, 0x400, 0x800))
            if at + 4 * n * width > end or not flags & 0x200 and given[1] * n > len(data):
                raise ValueError("a fragment's run is cut off")
            if n > len(data):
                raise ValueError("samples larger than the file")
            cells = np.frombuffer(data, ">u4", n * width, at).reshape(n, width).astype(np.int64)
            cols, k = [], 0
            for j, bit in enumerate((0x100, 0x200, 0x400)):
                cols.append(cells[:, k] if flags & bit else np.full(n, given[j], np.int64))
                k += bool(flags & bit)
            if first is not None and n:
                cols[2] = np.append(first, cols[2][1:])
            ends = np.cumsum(cols[1])
            if own and n:
                rows.append(np.stack([at_data + ends - cols[1], cols[1], time + np.cumsum(cols[0]) - cols[0], cols[0], cols[2] >> 16 & 1]))
                time += int(cols[0].sum())
            at_data += int(ends[-1]) if n else 0
    got = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.int64)
    return {"offsets": got[0], "sizes": got[1], "times": got[2], "deltas": got[3], "keys": np.flatnonzero(got[4] == 0)}


def probe_bytes(data: bytes) -> dict:
    """The first video track: codec, size, timescale, duration, and offset, size, time and key flag of its samples; beside it (kind, codec, timescale, duration, samples) of every track.

    Samples are those of the sample tables and, behind them, of movie fragments.
    """
    boxes = list(walk(data))
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, _, at, end in boxes:
        if path[-1] == b"trak":
            tracks.append({})
        elif b"trak" in path:
            tracks[-1][path[-1]] = (at, end)
    fragmented = any(path[-1] == b"moof" for path, *_ in boxes)
    found, every = None, []
    for t in tracks:
        kind = data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]
        at = t[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        at = t[b"stsd"][0] + 8
        codec = data[at + 4 : at + 8].decode("latin-1").strip()
        own = samples(data, t)
        if fragmented:
            head = t[b"tkhd"][0]
            more = fragments(data, boxes, struct.unpack_from(">I", data, head + (20 if data[head] else 12))[0])
            more["keys"] = more["keys"] + len(own["sizes"])
            own = {k: np.concatenate([own[k], more[k]]) for k in own}
            duration = duration or (int(own["times"][-1] + own["deltas"][-1]) if len(own["times"]) else 0)
        if len(own["sizes"]) and (int(own["offsets"].min()) < 0 or int((own["offsets"] + own["sizes"]).max()) > len(data)):
            raise ValueError("a sample outside the file")
        every.append({"kind": kind.decode("latin-1"), "codec": codec, "timescale": timescale, "duration": duration, "samples": len(own["sizes"])})
        if kind == b"vide" and found is None:
            width, height = struct.unpack_from(">HH", data, at + 32)
            found = {"codec": codec, "width": width, "height": height, "timescale": timescale, "duration": duration, **own}
    if found is None:
        raise ValueError("no video track")
    return {**found, "tracks": every}


def read_payload(data: bytes, found: dict) -> bytes:
    """The stored samples, joined; neighbours are read as one range."""
    at, size = found["offsets"], found["sizes"]
    if len(at) == 0:
        return b""
    cuts = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    firsts, lasts = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(at) - 1]
    return b"".join(data[int(at[a]) : int(at[b] + size[b])] for a, b in zip(firsts, lasts, strict=True))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an ISO media file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, text in text_rows(batches):
            raw = text.encode("utf-8")
            yield doc, len(raw), mux(raw + PAD * (-len(raw) % FRAME if raw else FRAME))

    return pick(df, id_col, text_col).mapInArrow(lambda b: emit(schema, rows(b), lambda r: len(r[2])), "doc_id long, n_bytes long, media binary")


PROBED = "codec string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<time:long,offset:long,size:long>>, tracks array<struct<kind:string,codec:string,timescale:long,duration:long,samples:long>>, error string"
_KEYS = pa.list_(pa.struct([("time", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64())]))
_PROBED = [("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _KEYS), ("tracks", _TRACKS), ("error", pa.string())]


def _features(data: bytes | None) -> tuple[dict | None, tuple]:
    try:
        found = probe_bytes(data or b"")
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return None, (None,) * 8 + (f"{type(e).__name__}: {e}",)
    k = found["keys"]
    ranges = [{"time": a, "offset": b, "size": c} for a, b, c in zip(found["times"][k].tolist(), found["offsets"][k].tolist(), found["sizes"][k].tolist(), strict=True)]
    return found, (found["codec"], found["width"], found["height"], found["timescale"], found["duration"], len(found["sizes"]), ranges, found["tracks"], None)


def probe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, codec, width, height, timescale, duration, n_samples, keyframes, tracks, error) of a binary column of ISO media files."""
    schema = pa.schema([("doc_id", pa.int64()), *_PROBED])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, media in zip(b.column(0), b.column(1), strict=True):
                yield doc.as_py(), *_features(media.as_py())[1]

    return df.select(df[id_col].cast("long").alias("doc_id"), df[media_col].alias("media")).mapInArrow(lambda b: emit(schema, rows(b)), f"doc_id long, {PROBED}")


def digests(df: DataFrame) -> DataFrame:
    """store()'s rows, read back: digests of payload and file beside the probed features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *_PROBED])
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + PROBED

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, n, media in zip(*(b.column(i) for i in range(3)), strict=True):
                data = media.as_py()
                found, probed = _features(data)
                payload = read_payload(data, found) if found else b""
                ranges = hashlib.sha256(repr([tuple(k.values()) for k in probed[6] or []]).encode()).hexdigest()[:16]
                feature = f"{probed[0]}/{probed[1]}x{probed[2]}/{probed[4]}@{probed[3]}/samples={probed[5]}/keys={len(probed[6] or [])}:{ranges}"
                yield doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, *probed

    return df.select("doc_id", "n_bytes", "media").mapInArrow(lambda b: emit(schema, rows(b), lambda r: 24 * len(r[14] or ())), fields)


def stored_digests(df: DataFrame) -> DataFrame:
    """Stores every text in a table of media files in the shared folder, then reads that table."""
    return digests(shared_table(store(df), "media"))
