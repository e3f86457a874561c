"""Matroska files as columns: a writer of PCM tracks and a parser of EBML elements into packet tables.

The parser walks variable-length EBML elements (known and unknown sizes), clusters, simple
blocks and block groups with all four lacings, and cues; it gives each packet's track,
timestamp and byte range. Element ids are those of RFC 8794 and RFC 9559.

Defined results: null media gives no packets; null text is stored as empty text; empty text
is one block of 64 zero bytes; broken files raise ``ValueError`` in parse() and give one row
with ``error`` set in packet_table(). Equal texts give equal files: no dates or random ids, so
repeated rows give equal rows, each for itself. Texts of any length become one file, of as many
clusters as needed; an empty table gives an empty table; other columns don't matter.
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
from pyspark.sql import functions as F

from .common import table

# Element ids of the format.
EBML, EBML_DOCTYPE, EBML_DOCTYPE_VERSION, EBML_DOCTYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS))
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: The layout that mux() writes: 8-bit mono samples, 8000 a second.
RATE, FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8000, 1024, 8, 4


def write_id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def write_size(n: int, width: int = 0) -> bytes:
    """A variable-length number; all ones are kept for unknown sizes."""
    if not width:
        width = 1
        while n >= (1 << (7 * width)) - 1:
            width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return write_id(ident) + write_size(len(body)) + body


def unsigned(ident: int, x: int) -> bytes:
    return element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def write_block(track: int, relative_ms: int, frames: list[bytes]) -> bytes:
    """The body of a simple block: laced in fixed sizes where frames are alike, else with EBML sizes."""
    head = write_size(track) + struct.pack(">h", relative_ms)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len({len(f) for f in frames}) == 1:
        return head + bytes((0x80 | FIXED_LACING << 1, len(frames) - 1)) + b"".join(frames)
    sizes = [len(f) for f in frames]
    laces = write_size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = 1
        while abs(b - a) > (1 << (7 * width - 1)) - 2:
            width += 1
        laces += write_size(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + bytes((0x80 | EBML_LACING << 1, len(frames) - 1)) + laces + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file with the payload as the samples of one PCM track."""
    head = element(EBML, element(EBML_DOCTYPE, b"matroska") + unsigned(EBML_DOCTYPE_VERSION, 4) + unsigned(EBML_DOCTYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"lumenframe") + element(WRITING_APP, b"lumenframe"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    step = FRAME * FRAMES_IN_BLOCK
    for start in range(0, len(payload), step * BLOCKS_IN_CLUSTER):
        time = start * 1000 // RATE
        body = [unsigned(TIMESTAMP, time)]
        for b in range(start, min(len(payload), start + step * BLOCKS_IN_CLUSTER), step):
            frames = [payload[i : min(i + FRAME, b + step)] for i in range(b, min(b + step, len(payload)), FRAME)]
            body.append(element(SIMPLE_BLOCK, write_block(1, b * 1000 // RATE - time, frames)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    body = b"".join(parts)
    return head + write_id(SEGMENT) + write_size(len(body), 8) + body


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise ValueError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Value (-1: unknown), next byte, width."""
    if at >= end or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"size cut off at byte {at}")
    x = int.from_bytes(data[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (-1 if x == (1 << (7 * width)) - 1 else x), at + width, width


def children(data: bytes, at: int, end: int, unknown_ends: frozenset[int] = TOP_LEVEL) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements in a range. An element of unknown size ends where one of unknown_ends begins."""
    while at < end:
        ident, at = read_id(data, at, end)
        size, at, _ = read_size(data, at, end)
        if size < 0:
            stop = at
            while stop < end:
                inner, after = read_id(data, stop, end)
                if ident != SEGMENT and inner in unknown_ends:
                    break
                length, after, _ = read_size(data, after, end)
                stop = end if length < 0 else after + length
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at byte {at} ends beyond its parent")
        yield ident, at, stop
        at = stop


def number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def real(data: bytes, at: int, end: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", data[at:end])[0], 8: lambda: struct.unpack(">d", data[at:end])[0]}[end - at]()


def lace(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """First byte and size of each frame in a block's data."""
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lace head at byte {at}")
    n, at = data[at] + 1, at + 1
    if kind == FIXED_LACING:
        if (end - at) % n:
            raise ValueError(f"uneven fixed lacing at byte {at}")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == XIPH_LACING:
                size = 0
                while True:
                    if at >= end:
                        raise ValueError("lace sizes cut off")
                    size, at = size + data[at], at + 1
                    if data[at - 1] < 255:
                        break
            else:
                x, at, width = read_size(data, at, end)
                size = x if k == 0 else sizes[-1] + x - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


@dataclass
class Media:
    timestamp_scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, first byte, size, key frame, cluster, lacing)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, byte where the cluster begins)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0


def parse(data: bytes) -> Media:
    out = Media()
    top = list(children(data, 0, len(data), frozenset()))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    raw_cues = []
    for ident, first, stop in top:
        if ident != SEGMENT:
            continue
        for kind, a, b in children(data, first, stop):
            if kind == INFO:
                for i, x, y in children(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        out.timestamp_scale = number(data, x, y)
                    elif i == DURATION:
                        out.duration = real(data, x, y)
            elif kind == TRACKS:
                for i, x, y in children(data, a, b):
                    if i == TRACK_ENTRY:
                        read_track(data, x, y, out)
            elif kind == CLUSTER:
                read_cluster(data, a, b, out)
            elif kind == CUES:
                for i, x, y in children(data, a, b):
                    if i == CUE_POINT:
                        time = 0
                        for j, p, q in children(data, x, y):
                            if j == CUE_TIME:
                                time = number(data, p, q)
                            elif j == CUE_TRACK_POSITIONS:
                                where = {k: number(data, r, s) for k, r, s in children(data, p, q)}
                                raw_cues.append((time, where.get(CUE_TRACK, 0), first + where.get(CUE_CLUSTER_POSITION, 0)))
    out.cues = [(t * out.timestamp_scale, track, at) for t, track, at in raw_cues]
    return out


def read_track(data: bytes, at: int, end: int, out: Media) -> None:
    track: dict = {"codec": "", "type": 0, "frame_ns": 0}
    n = 0
    for i, x, y in children(data, at, end):
        if i == TRACK_NUMBER:
            n = number(data, x, y)
        elif i == TRACK_TYPE:
            track["type"] = number(data, x, y)
        elif i == CODEC_ID:
            track["codec"] = data[x:y].decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            track["frame_ns"] = number(data, x, y)
        elif i == AUDIO:
            for j, p, q in children(data, x, y):
                if j == SAMPLING_FREQUENCY:
                    track["rate"] = real(data, p, q)
                elif j in (CHANNELS, BIT_DEPTH):
                    track["channels" if j == CHANNELS else "bits"] = number(data, p, q)
    out.tracks[n] = track


def read_cluster(data: bytes, at: int, end: int, out: Media) -> None:
    time = 0
    for i, x, y in children(data, at, end):
        if i == TIMESTAMP:
            time = number(data, x, y)
        elif i == SIMPLE_BLOCK:
            read_block(data, x, y, time, None, out)
        elif i == BLOCK_GROUP:
            parts = {j: (p, q) for j, p, q in children(data, x, y)}
            if BLOCK in parts:
                length = number(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                read_block(data, *parts[BLOCK], time, length, out)
    out.clusters += 1


def read_block(data: bytes, at: int, end: int, cluster_time: int, duration: int | None, out: Media) -> None:
    track, at, _ = read_size(data, at, end)
    if at + 3 > end:
        raise ValueError("block head cut off")
    time = (cluster_time + struct.unpack(">h", data[at : at + 2])[0]) * out.timestamp_scale
    flags = data[at + 2]
    frames = lace(data, at + 3, end, flags)
    step = out.tracks.get(track, {}).get("frame_ns", 0) or (duration or 0) * out.timestamp_scale // len(frames)
    for k, (first, size) in enumerate(frames):
        out.packets.append((track, time + k * step, first, size, bool(flags & 0x80), out.clusters, flags >> 1 & 3))


PACKETS = pa.schema([("media_id", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("first_byte", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int64()), ("lacing", pa.int32()), ("error", pa.string())])


def packet_table(df: DataFrame, ident: str, media: str) -> DataFrame:
    """A row for each packet of each file in a binary column."""

    def rows(batches):
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(i, *p, None) for p in parse(data).packets]
                except (ValueError, KeyError, struct.error) as e:
                    found = [(i, None, None, None, None, None, None, None, str(e))]
                for k in range(0, len(found), 50_000):
                    part = found[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), PACKETS.types)], schema=PACKETS)

    schema = "media_id long, track long, timestamp_ns long, first_byte long, size long, keyframe boolean, cluster long, lacing int, error string"
    return df.select(F.col(ident).cast("long"), F.col(media)).mapInArrow(rows, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % 64 if data else 64)


#: Files go on in batches of about so many bytes.
BATCH_BYTES = 4 << 20
MUXED = pa.schema([("media_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def mux_texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, n_bytes, media): each text stored as a file."""

    def rows(batches):
        for batch in batches:
            out, held = [], 0
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, payload = padded(x)
                out.append((i, n, mux(payload)))
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), MUXED.types)], schema=MUXED)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), MUXED.types)], schema=MUXED)

    return df.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(rows, "media_id long, n_bytes long, media binary")


def describe(media: Media, payload: bytes) -> str:
    """Features of what was read: structure of the file and simple statistics of the samples, as integers."""
    samples = np.frombuffer(payload, np.uint8)
    signed = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    ms = media.packets[-1][1] // 1_000_000 if media.packets else 0
    return f"clusters={media.clusters};cues={len(media.cues)};packets={len(media.packets)};last_ms={ms};sum={int(samples.sum(dtype=np.int64))};energy={int((signed.astype(np.int64) ** 2).sum())};crossings={crossings}"


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_digests(media: DataFrame) -> DataFrame:
    """Reads each stored file back through its packets' byte ranges, and digests it."""

    def rows(batches):
        for batch in batches:
            out = []
            for i, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = parse(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in found.packets])
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(found, payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), DIGEST.types)], schema=DIGEST)

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_matroska(spark, sf_dir: str) -> DataFrame:
    return media_digests(mux_texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
