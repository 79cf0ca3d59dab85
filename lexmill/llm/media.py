"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`mux` stores bytes as 8-bit samples of one audio track; `demux` reads any Matroska bytes whose blocks are unencrypted:
elements of known and unknown size, SimpleBlock and BlockGroup, all four lacings, several tracks. A block of a group is a key
frame if the group refers to no other block; a group's duration spaces its laced frames where the track has no default.

Null text is empty text; an empty payload has no packets. A text of any length is handled frame by frame. Bytes that are no
Matroska, or end early, give the packets before the fault and an error text. Equal texts give equal rows; repeated rows
each give theirs. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK, BLOCK_DURATION = 0xFB, 0x9B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

MASTERS = frozenset({SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS})
#: An element of unknown size ends where one of these begins, unless it can hold it.
TOP = frozenset({SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS})

FRAME, RATE, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 192, 8000, 8, 128
FRAME_MS = FRAME * 1000 // RATE
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def element_id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are left for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return element_id(kind) + vint(len(body)) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    """The body of a SimpleBlock of key frames, `at` milliseconds into its cluster."""
    head = vint(track) + struct.pack(">hB", at, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - before) < 1 << 7 * w - 1)
            head += vint(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """payload as frames of FRAME 8-bit samples (the last may be shorter), with the lacing kinds in turn."""
    duration = -(-len(payload) * 1000 // RATE)
    header = element(EBML, b"".join((
        unsigned(EBML_VERSION, 1), unsigned(EBML_READ_VERSION, 1), unsigned(EBML_MAX_ID, 4), unsigned(EBML_MAX_SIZE, 8),
        element(DOC_TYPE, b"matroska"), unsigned(DOC_TYPE_VERSION, 4), unsigned(DOC_TYPE_READ_VERSION, 2),
    )))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    entry = b"".join((
        unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), element(CODEC_ID, b"A_PCM/INT/LIT"),
        unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000), audio,
    ))
    parts = [
        element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", duration))),
        element(TRACKS, element(TRACK_ENTRY, entry)),
    ]
    at, cues = sum(map(len, parts)), []
    step = FRAME * FRAMES_A_BLOCK
    for first in range(0, len(payload), step * BLOCKS_A_CLUSTER):
        start = first // FRAME * FRAME_MS
        body = [unsigned(TIMESTAMP, start)]
        for k, begin in enumerate(range(first, min(len(payload), first + step * BLOCKS_A_CLUSTER), step)):
            piece = payload[begin : begin + step]
            frames = [piece[i : i + FRAME] for i in range(0, len(piece), FRAME)]
            even = len(piece) % FRAME == 0
            lacing = NO_LACING if len(frames) == 1 else (XIPH, EBML_LACING, FIXED)[k % 3] if even else XIPH
            body.append(element(SIMPLE_BLOCK, block(1, begin // FRAME * FRAME_MS - start, frames, lacing)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What demux found. packets: (track, timestamp ms, offset, length, cluster, key frame); offsets are from the first byte."""

    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    duration_ms: float = 0.0
    error: str | None = None


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """The variable-length integer at `at`: value, the position behind it, and whether all its bits are ones."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & (1 << 7 * width) - 1
    return value if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block whose frames begin at the position returned."""
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"uneven fixed lacing at byte {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == XIPH:
            n = 0
            while True:
                n, byte, at = n + data[at], data[at], at + 1
                if byte < 255:
                    break
            sizes.append(n)
        else:
            value, behind, _ = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (behind - at) - 1) - 1))
            at = behind
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing beyond its block at byte {at}")
    return sizes, at


def demux(data: bytes) -> Media:
    """Packets, cues, tracks and clusters of Matroska bytes; `error` tells where reading ended early."""
    media = Media()
    state = {"cluster": -1, "base": 0, "scale": 1_000_000, "segment": 0, "track": {}, "cue": [0, 0, 0], "duration": 0.0}
    try:
        if not data.startswith(element_id(EBML)):
            raise ValueError("no EBML header")
        _walk(data, 0, len(data), None, media, state)
    except (ValueError, IndexError, struct.error) as fault:
        media.error = str(fault)
    media.duration_ms = state["duration"] * state["scale"] / 1e6
    return media


def _walk(data: bytes, at: int, end: int, parent: int | None, media: Media, state: dict, open_ended: bool = False) -> int:
    while at < end:
        begin = at
        kind, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        if open_ended and kind in TOP and (parent != SEGMENT or kind == SEGMENT):
            return begin
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element at byte {begin} goes beyond byte {end}")
        if kind in MASTERS:
            if kind == SEGMENT:
                state["segment"] = at
            elif kind == CLUSTER:
                state["cluster"], state["base"] = len(media.clusters), 0
                media.clusters.append((begin, 0))
            elif kind == TRACK_ENTRY:
                state["track"] = {}
            elif kind == BLOCK_GROUP:
                state["group"], state["refers"], state["lasts"] = len(media.packets), False, None
            at = _walk(data, at, stop, kind, media, state, unknown)
            if kind == TRACK_ENTRY:
                media.tracks[state["track"].get("number", 0)] = state["track"]
            elif kind == CUE_TRACK_POSITIONS:
                media.cues.append(tuple(state["cue"]))
            elif kind == BLOCK_GROUP:
                _close_group(media, state)
            continue
        if kind in (SIMPLE_BLOCK, BLOCK):
            _block(data, at, stop, kind, media, state)
        else:
            _value(data[at:stop], kind, media, state)
        at = stop
    return at


def _close_group(media: Media, state: dict) -> None:
    """Key frames and times of the packets of a block group, known once all of it is read."""
    packets = media.packets[state["group"] :]
    spread = state["lasts"] and packets and not media.tracks.get(packets[0][0], {}).get("frame_ns")
    for k, (track, when, at, size, cluster, _) in enumerate(packets):
        when += k * state["lasts"] * state["scale"] // (len(packets) * 1_000_000) if spread else 0
        media.packets[state["group"] + k] = (track, when, at, size, cluster, not state["refers"])


def _value(body: bytes, kind: int, media: Media, state: dict) -> None:
    number = lambda: int.from_bytes(body, "big")
    real = lambda: struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
    if kind == TIMESTAMP:
        state["base"] = number()
        media.clusters[-1] = (media.clusters[-1][0], number() * state["scale"] // 1_000_000)
    elif kind == REFERENCE_BLOCK:
        state["refers"] = True
    elif kind == BLOCK_DURATION:
        state["lasts"] = number()
    elif kind == TIMESTAMP_SCALE:
        state["scale"] = number()
    elif kind == DURATION:
        state["duration"] = real()
    elif kind in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
        state["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "frame_ns"}[kind]] = number()
    elif kind == SAMPLING_FREQUENCY:
        state["track"]["rate"] = real()
    elif kind == CODEC_ID:
        state["track"]["codec"] = body.decode("ascii", "replace")
    elif kind == CUE_TIME:
        state["cue"][0] = number() * state["scale"] // 1_000_000
    elif kind == CUE_TRACK:
        state["cue"][1] = number()
    elif kind == CUE_CLUSTER_POSITION:
        state["cue"][2] = number() + state["segment"]


def _block(data: bytes, at: int, end: int, kind: int, media: Media, state: dict) -> None:
    track, at, _ = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    scale, step = state["scale"], media.tracks.get(track, {}).get("frame_ns", 0)
    when = (state["base"] + relative) * scale
    key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else False
    for n in sizes:
        if at + n > end:
            raise ValueError(f"frame at byte {at} goes beyond its block")
        media.packets.append((track, when // 1_000_000, at, n, state["cluster"], key))
        at, when = at + n, when + step


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def describe(media: bytes) -> tuple:
    """Features of what is stored: payload size, SHA-256, CRC-32 of the last 16 bytes, and a text of the stream's figures."""
    read = demux(media)
    if read.error:
        raise ValueError(read.error)
    payload = b"".join([media[o : o + n] for _, _, o, n, _, _ in read.packets])
    samples = np.frombuffer(payload, np.uint8)
    figures = {
        "tracks": len(read.tracks), "packets": len(read.packets), "clusters": len(read.clusters), "cues": len(read.cues),
        "last_ms": read.packets[-1][1], "duration_ms": int(read.duration_ms), "sum": int(samples.sum(dtype=np.int64)),
        "peak": int(samples.max()), "turns": int(np.count_nonzero(np.diff(samples > 127))),
    }
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), ";".join(f"{k}={v}" for k, v in figures.items())


PACKETS = "key bigint, packet int, track int, timestamp_ms bigint, byte_offset bigint, byte_length bigint, cluster int, key_frame boolean, in_cues boolean, error string"


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each packet of a binary column; media without packets give one row with nulls. in_cues: a cue names its cluster."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PACKETS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                read = demux(data or b"")
                cued = {position for _, _, position in read.cues}
                out = [(one, i, *p, read.clusters[p[4]][0] in cued if p[4] >= 0 else False, read.error) for i, p in enumerate(read.packets)]
                out = out or [(one, *[None] * 8, read.error or "no packets")]
                for first in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[first : first + 50_000]), types)], names=names)

    return media.select(key, column).mapInArrow(rows, PACKETS)


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as Matroska, read it back and describe it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FEATURES.split(", ")]
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for k in range(batch.num_rows):
                n, payload = padded(batch.column(1)[k].as_py())
                stored = mux(payload)
                size, sha, tail, feature = describe(stored)
                out.append((ids[k], n, size, sha, tail, len(stored), hashlib.sha256(stored).hexdigest(), feature))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(rows, FEATURES)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
