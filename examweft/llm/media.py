"""Media columns: Matroska.

``write`` stores a payload as 8-bit mono PCM in a Matroska stream: EBML header, one segment with info,
one track, clusters of laced blocks, and cues. ``parse`` walks the elements of any such stream (sizes of
1 to 8 bytes, unknown sizes, simple blocks and block groups, all kinds of lacing, cues) into a packet
table: track, timestamp, byte range, lacing and key flag. Payloads are cut out by those byte ranges.

A file is one row and is parsed in one task; nothing is shuffled. What a cell can hold (2 GB) bounds it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from examweft.llm.common import map_batches, whole_text

#: Element ids of the container format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold others, and those that end an element of unknown size.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

PAD, RATE, FRAME, LACE, BLOCKS_PER_CLUSTER = 64, 8000, 1024, 8, 16


# --- numbers of variable length -------------------------------------------------------------------

def put_size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def get_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None is the reserved "unknown"."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - first.bit_length()
    raw = data[at : at + width]
    if len(raw) < width:
        raise ValueError(f"cut short at byte {at}")
    n = int.from_bytes(raw, "big")
    if keep_marker:
        return n, at + width
    n ^= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + put_size(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


# --- writing --------------------------------------------------------------------------------------

def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block behind their lacing head."""
    if kind == NO_LACE:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACE:
        head += put_size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += put_size(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, offset: int, kind: int, frames: list[bytes], key: bool = True) -> bytes:
    return put_size(track) + struct.pack(">hB", offset, (0x80 if key else 0) | kind << 1) + lace(frames, kind)


def write(payload: bytes, rate: int = RATE) -> bytes:
    """A Matroska stream with ``payload`` as 8-bit samples; equal payloads give equal streams."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"examweft") + element(WRITING_APP, b"examweft") + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, step = [info, tracks], [], FRAME * LACE
    at = len(info) + len(tracks)
    for c in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        begin = c * 1000 // rate
        parts = [uint(TIMESTAMP, begin)]
        for b in range(c, min(c + step * BLOCKS_PER_CLUSTER, len(payload)), step):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + step, len(payload)), FRAME)]
            kind = NO_LACE if len(frames) == 1 else FIXED if len({len(f) for f in frames}) == 1 else EBML_LACE
            parts.append(element(SIMPLE_BLOCK, block(1, b * 1000 // rate - begin, kind, frames)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# --- reading --------------------------------------------------------------------------------------

@dataclass
class Packet:
    track: int
    timestamp: int  # in ticks of the segment's scale; frames of one lace share their block's
    offset: int
    size: int
    lacing: int
    lace_index: int
    keyframe: bool


@dataclass
class Stream:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte of the cluster
    clusters: list[int] = field(default_factory=list)


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if kind == NO_LACE:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if kind == XIPH:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        else:
            begin = at
            n, at = get_number(data, at)
            sizes.append(n if not i else sizes[-1] + n - ((1 << 7 * (at - begin) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at > end:
        raise ValueError("lacing beyond its block")
    return sizes, at


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the contents of each element between two bytes."""
    while at < end:
        kind, at = get_number(data, at, keep_marker=True)
        size, at = get_number(data, at)
        stop = at + size if size is not None else _unknown_end(data, kind, at, end)
        if stop > end:
            raise ValueError(f"cut short: the element at byte {at} ends beyond what holds it")
        yield kind, at, stop
        at = stop


def _unknown_end(data: bytes, kind: int, at: int, end: int) -> int:
    """A cluster of unknown size lasts to the next top-level element, anything else to its parent's end."""
    while kind == CLUSTER and at < end:
        child, to = get_number(data, at, keep_marker=True)
        if child in TOP:
            return at
        size, to = get_number(data, to)
        at = to + (size or 0)
    return end


def _int(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def _float(data: bytes, begin: int, end: int) -> float:
    return struct.unpack(">f" if end - begin == 4 else ">d", data[begin:end])[0] if end > begin else 0.0


def _packets(data: bytes, begin: int, end: int, base: int, key: bool | None) -> Iterator[Packet]:
    track, at = get_number(data, begin)
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, kind)
    for i, n in enumerate(sizes):
        yield Packet(track, base + offset, at, n, kind, i, bool(flags & 0x80) if key is None else key)
        at += n


def parse(data: bytes) -> Stream:
    """Tracks, packets and cues of a stream; bytes that are no Matroska raise ValueError."""
    out = Stream()
    try:
        top = list(elements(data, 0, len(data)))
        if not top or top[0][0] != EBML:
            raise ValueError("no EBML header")
        for kind, a, b in top:
            if kind == EBML:
                out.doc_type = next((data[x:y].decode("ascii", "replace") for k, x, y in elements(data, a, b) if k == DOC_TYPE), "")
            elif kind == SEGMENT:
                _segment(data, a, b, out)
    except (IndexError, struct.error) as e:
        raise ValueError(f"cut short: {e}") from e
    return out


def _segment(data: bytes, begin: int, end: int, out: Stream) -> None:
    for kind, a, b in elements(data, begin, end):
        if kind == INFO:
            for k, x, y in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    out.scale = _int(data, x, y)
                elif k == DURATION:
                    out.duration = _float(data, x, y)
        elif kind == TRACKS:
            out.tracks += [_track(data, x, y) for k, x, y in elements(data, a, b) if k == TRACK_ENTRY]
        elif kind == CLUSTER:
            out.clusters.append(a)
            base = 0
            for k, x, y in elements(data, a, b):
                if k == TIMESTAMP:
                    base = _int(data, x, y)
                elif k == SIMPLE_BLOCK:
                    out.packets += _packets(data, x, y, base, None)
                elif k == BLOCK_GROUP:
                    inner = list(elements(data, x, y))
                    key = all(i[0] != REFERENCE for i in inner)
                    for i, p, q in inner:
                        if i == BLOCK:
                            out.packets += _packets(data, p, q, base, key)
        elif kind == CUES:
            for k, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    inner = list(elements(data, x, y))
                    time = next((_int(data, p, q) for i, p, q in inner if i == CUE_TIME), 0)
                    for i, p, q in inner:
                        if i == CUE_POSITIONS:
                            at = {j: _int(data, r, s) for j, r, s in elements(data, p, q)}
                            out.cues.append((time, at.get(CUE_TRACK, 0), begin + at.get(CUE_CLUSTER, 0)))


def _track(data: bytes, begin: int, end: int) -> dict:
    track = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0}
    for k, x, y in elements(data, begin, end):
        if k == TRACK_NUMBER:
            track["number"] = _int(data, x, y)
        elif k == TRACK_TYPE:
            track["type"] = _int(data, x, y)
        elif k == CODEC_ID:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif k == AUDIO:
            for i, p, q in elements(data, x, y):
                if i == SAMPLING:
                    track["rate"] = _float(data, p, q)
                elif i == CHANNELS:
                    track["channels"] = _int(data, p, q)
                elif i == BIT_DEPTH:
                    track["bits"] = _int(data, p, q)
    return track


def track_payload(data: bytes, stream: Stream, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in stream.packets if p.track == track)


# --- columns --------------------------------------------------------------------------------------

def feature(stream: Stream, payload: bytes) -> str:
    """Packets, clusters, cues, last timestamp; mean and deviation of the samples, and their sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x)))) if len(x) > 1 else 0
    last = stream.packets[-1].timestamp if stream.packets else 0
    return f"packets={len(stream.packets)};clusters={len(stream.clusters)};cues={len(stream.cues)};last={last};mean={x.mean() if len(x) else 0:.4f};std={x.std() if len(x) else 0:.4f};crossings={crossings}"


def text_payload(data: bytes) -> bytes:
    return data + bytes((-len(data)) % PAD or (0 if data else PAD))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (binary): each text, zero-padded to a positive multiple of 64 bytes, as a stream.

    Null counts as empty; repeated rows are written each; columns of other names are ignored.
    """

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.as_buffer().to_pybytes() for x in batch.column("_text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(text_payload(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, whole_text(text_col).alias("_text")), function, f"`{id_col}` {kind}, n_bytes long, media binary")


def packets(files: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """The packet table: id_col, packet, track, timestamp_ns, offset, size, lacing, lace_index, keyframe.

    A null file has no packets; one that is no Matroska, or is cut short, has one row with ``error`` set.
    """

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, media in enumerate(batch.column(media_col)):
            if not media.is_valid:
                continue
            try:
                s = parse(media.as_buffer().to_pybytes())
                rows += [(i, n, p.track, p.timestamp * s.scale, p.offset, p.size, p.lacing, p.lace_index, p.keyframe, None) for n, p in enumerate(s.packets)]
            except ValueError as e:
                rows.append((i, *[None] * 8, str(e)))
        cols = list(zip(*rows, strict=True)) or [[]] * 10
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(cols[0], pa.int32())), *map(pa.array, cols[1:], types)], names=[id_col, "packet", "track", "timestamp_ns", "offset", "size", "lacing", "lace_index", "keyframe", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return map_batches(files.select(id_col, media_col), function, f"`{id_col}` {kind}, packet int, track int, timestamp_ns long, offset long, size long, lacing int, lace_index int, keyframe boolean, error string")


def describe(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and what is read back from each file: payload size, digests, feature string; null for a null file."""
    keep = list(keep)

    def one(data: bytes) -> tuple:
        stream = parse(data)
        payload = track_payload(data, stream)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream, payload)

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*(one(m.as_buffer().to_pybytes()) if m.is_valid else (None,) * 6 for m in batch.column(media_col)), strict=True)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, cols, types)], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    return map_batches(files.select(*keep, media_col), function, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
