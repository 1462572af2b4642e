"""Media columns: payloads stored in Matroska files, and a parser that turns files into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import trimming, tune, without
from trialspark.llm._text import buffers, spans_of_rows

SLICE = 1 << 20
RATE = 8000
FRAME = 512
LACED = 8
CLUSTER_FRAMES = 256

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones are kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return _id(name) + vint(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and the block's data: none for one frame, fixed-size for equal frames, else EBML lacing of size differences."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(x) for x in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    out = bytes([len(frames) - 1]) + vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
        out += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return 0x06, out + b"".join(frames)


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples at 8 kHz: ``payload``, byte for byte. Equal payloads, equal files."""
    view = memoryview(payload)
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"trialspark") + _element(WRITING_APP, b"trialspark") + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    body, cues = [info, _TRACKS], []
    at = sum(map(len, body))
    step = FRAME * LACED
    for c in range(0, len(payload), FRAME * CLUSTER_FRAMES):
        base = c * 1000 // RATE
        parts = [_uint(TIMESTAMP, base)]
        first = len(parts[0])
        for b in range(c, min(len(payload), c + FRAME * CLUSTER_FRAMES), step):
            flag, data = _lace([view[i : min(i + FRAME, len(payload))].tobytes() for i in range(b, min(len(payload), b + step), FRAME)])
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - base, 0x80 | flag) + data))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at) + _uint(CUE_RELATIVE_POSITION, first))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


@dataclass
class Parsed:
    """Packets (track, timestamp in ns, offset, length, keyframe, cluster's offset), tracks by number and cues (ns, track, offset of the cluster)."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float | None = None


class Damaged(ValueError):
    pass


def _read_vint(data, at: int, end: int, marker: bool) -> tuple[int, int, bool]:
    """Value, where it ends, and whether all its bits are ones."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"a number is cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    low = n & (1 << 7 * width) - 1
    return (n if marker else low), at + width, low == (1 << 7 * width) - 1


def elements(data, at: int, end: int, until: frozenset = frozenset()):
    """Id, first byte of the body and its end, of each element; one of unknown size ends where the next of ``until`` starts, or its parent."""
    while at < end:
        name, body, _ = _read_vint(data, at, end, True)
        size, body, unknown = _read_vint(data, body, end, False)
        if unknown:
            stop = end if name == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            raise Damaged(f"an element at {at} is cut off")
        yield name, body, stop
        at = stop


def _unknown_end(data, at: int, end: int) -> int:
    while at < end:
        name, body, _ = _read_vint(data, at, end, True)
        if name in TOP_LEVEL:
            return at
        size, body, _ = _read_vint(data, body, end, False)
        at = body + size
    return end


def _int(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def laced(data, at: int, end: int, flag: int) -> list[tuple[int, int]]:
    """First byte and length of each frame of a block's data (after its flags)."""
    kind = flag & 0x06
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 0x04:
        if (end - at) % n:
            raise Damaged("fixed-size lacing doesn't divide its block")
        sizes = [(end - at) // n] * n
    elif kind == 0x02:
        for _ in range(n - 1):
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            start = at
            value, at, _ = _read_vint(data, at, end, False)
            sizes.append(value if k == 0 else sizes[-1] + value - (1 << (7 * (at - start) - 1)) + 1)
    if kind != 0x04:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Parsed:
    """Packets, tracks and cues of a Matroska file. Laced frames get their track's default duration between them."""
    out = Parsed()
    for name, a, b in elements(data, 0, len(data)):
        if name == SEGMENT:
            _segment(data, a, b, out)
    return out


def _segment(data, start: int, end: int, out: Parsed) -> None:
    for name, a, b in elements(data, start, end):
        if name == INFO:
            for n, c, d in elements(data, a, b):
                if n == TIMESTAMP_SCALE:
                    out.scale = _int(data, c, d)
                elif n == DURATION:
                    out.duration = _float(data, c, d)
        elif name == TRACKS:
            for n, c, d in elements(data, a, b):
                if n == TRACK_ENTRY:
                    t = {n2: (e, f) for n2, e, f in elements(data, c, d)}
                    number = _int(data, *t[TRACK_NUMBER]) if TRACK_NUMBER in t else 0
                    out.tracks[number] = {"type": _int(data, *t[TRACK_TYPE]) if TRACK_TYPE in t else None, "codec": bytes(data[slice(*t[CODEC_ID])]).decode("ascii", "replace") if CODEC_ID in t else None, "frame_ns": _int(data, *t[DEFAULT_DURATION]) if DEFAULT_DURATION in t else 0}
        elif name == CLUSTER:
            base, where = 0, a
            for n, c, d in elements(data, a, b):
                if n == TIMESTAMP:
                    base = _int(data, c, d)
                elif n == SIMPLE_BLOCK:
                    _block(data, c, d, base, where, None, out)
                elif n == BLOCK_GROUP:
                    inner = [(n2, e, f) for n2, e, f in elements(data, c, d)]
                    key = not any(n2 == REFERENCE_BLOCK for n2, _, _ in inner)
                    for n2, e, f in inner:
                        if n2 == BLOCK:
                            _block(data, e, f, base, where, key, out)
        elif name == CUES:
            for n, c, d in elements(data, a, b):
                if n == CUE_POINT:
                    time = 0
                    for n2, e, f in elements(data, c, d):
                        if n2 == CUE_TIME:
                            time = _int(data, e, f) * out.scale
                        elif n2 == CUE_TRACK_POSITIONS:
                            p = {n3: _int(data, g, h) for n3, g, h in elements(data, e, f)}
                            out.cues.append((time, p.get(CUE_TRACK, 0), start + p.get(CUE_CLUSTER_POSITION, 0)))


def _block(data, a: int, b: int, base: int, where: int, key: bool | None, out: Parsed) -> None:
    track, at, _ = _read_vint(data, a, b, False)
    if at + 3 > b:
        raise Damaged(f"a block at {a} is cut off")
    relative, flag = struct.unpack_from(">hB", data, at)
    step = out.tracks.get(track, {}).get("frame_ns", 0)
    for k, (first, size) in enumerate(laced(data, at + 3, b, flag)):
        out.packets.append((track, (base + relative) * out.scale + k * step, first, size, bool(flag & 0x80) if key is None else key, where))


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit or (0 if text else unit))


def _map(docs: DataFrame, column: str, outs: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    tune(docs.sparkSession)
    docs = without(docs, *[n for n, _, _ in outs if n != column])
    plain = [f for f in docs.schema.fields if f.name != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [f"{n} {t}" for n, t, _ in outs])

    def work(batches):
        for batch in batches:
            for i, j in spans_of_rows(buffers(batch.column(column))[1], SLICE):
                part = batch.slice(i, j - i)
                made = [make(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in plain] + [pa.array(x, t) for x, (_, _, t) in zip(zip(*made, strict=True), outs, strict=True)], [f.name for f in plain] + [n for n, _, _ in outs])

    return docs.mapInArrow(trimming(work), schema)


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_bytes`` and ``media``: a file of the text's bytes, zero-padded to a positive multiple of 64.

    A null text counts as an empty one (64 zeros).  Empty input: no rows.  Columns of ``docs`` with an output's name give way.
    """
    return _map(docs, text_col, [("n_bytes", "bigint", pa.int64()), ("media", "binary", pa.binary())], lambda x: (len(x or b""), mux(padded(x or b""))))


_PACKET = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int64())])
_PACKET_SQL = "array<struct<track:int,timestamp_ns:bigint,offset:bigint,length:bigint,keyframe:boolean,cluster:bigint>>"


def packets(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each packet: the other columns of ``media``, ``track, timestamp_ns, offset, length, keyframe, cluster`` and ``error``.

    Offsets are in the file; ``cluster`` is where the packet's cluster's body starts.  A null, empty or damaged file gives
    one row with nulls, and for a damaged one the ``error``.  Columns of ``media`` with an output's name give way.
    """

    def make(x):
        try:
            return ([dict(zip([f.name for f in _PACKET], p, strict=True)) for p in parse(x).packets] if x else []), None
        except (Damaged, struct.error, IndexError) as e:
            return [], str(e) or "damaged"

    names = [f.name for f in _PACKET]
    rows = _map(without(media, *names, "error"), media_col, [("__packets", _PACKET_SQL, pa.list_(_PACKET)), ("error", "string", pa.string())], make)
    kept = [c for c in rows.columns if c not in ("__packets", "error")]
    return rows.select(*[F.col(f"`{c}`") for c in kept], "error", F.explode_outer("__packets").alias("p")).select(*[F.col(f"`{c}`") for c in kept], *[f"p.{n}" for n in names], "error")


def features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Digests and a feature of what a file's packets hold, in the order of their timestamps.

    ``payload_bytes, payload_sha256, tail_crc32`` (last 64 bytes), ``media_bytes, media_sha256`` and ``feature``: packets,
    clusters, the last packet's ms, mean and root mean square around 128 of the samples, and crossings of 128.
    A null file is null throughout; a damaged one fails.
    """
    outs = [("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]

    def make(x):
        if x is None:
            return (None,) * 6
        p = sorted(parse(x).packets, key=lambda p: (p[0], p[1], p[2]))
        payload = b"".join([x[a : a + n] for _, _, a, n, _, _ in p])
        n, total, square, crossings, last = max(1, len(payload)), 0, 0, 0, None
        for a in range(0, len(payload), SLICE):
            s = np.frombuffer(payload, np.uint8, min(SLICE, len(payload) - a), a).astype(np.int64) - 128
            up = s >= 0
            total, square = total + int(s.sum()), square + int((s * s).sum())
            crossings += int((up[1:] != up[:-1]).sum()) + int(last is not None and last != up[0])
            last = up[-1]
        feature = f"{len(p)}:{len({q[5] for q in p})}:{p[-1][1] // 1_000_000 if p else 0}:{total / n:.6f}:{(square / n) ** 0.5:.6f}:{crossings}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature

    return _map(media, media_col, outs, make)


def query(spark, sf_dir: str) -> DataFrame:
    stored = to_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return features(stored)
