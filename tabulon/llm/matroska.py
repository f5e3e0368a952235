"""Matroska (EBML) files as media columns: writer, parser, packet tables, sample features.

The writer stores 8-bit PCM samples in one audio track: EBML head, Segment with Info, Tracks, Clusters of
laced SimpleBlocks and Cues. The parser knows no fixed layout: it reads variable-length element ids and
sizes (unknown sizes of Segment and Cluster too), skips what it doesn't know, undoes the three lacings
(Xiph, EBML, fixed-size) of SimpleBlocks and Blocks in BlockGroups, and gives packets with track,
timestamp, key flag and byte range, plus tracks and cue points.

Defined results: a null or empty text is stored as one frame of blanks; broken bytes raise `BadMedia` in
`parse` and give an `error` row in the packet table, with the packets before it; a null media cell gives no
packet. An empty table gives an empty result, repeated rows are each stored, extra columns aren't
read. Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Fixed values of the format: element ids with their marker bits.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE = 8000
FRAME = 192


class BadMedia(ValueError):
    """Bytes that aren't well-formed."""


# --- reading ---


def read_id(b: memoryview, at: int) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        raise BadMedia(f"no element id at {at}")
    n = 9 - b[at].bit_length()
    if n > 4 or at + n > len(b):
        raise BadMedia(f"bad element id at {at}")
    return int.from_bytes(b[at : at + n], "big"), at + n


def read_size(b: memoryview, at: int) -> tuple[int | None, int]:
    """Value of a variable-length size; None: unknown."""
    if at >= len(b) or not b[at]:
        raise BadMedia(f"no size at {at}")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise BadMedia(f"size cut off at {at}")
    v = int.from_bytes(b[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def _signed(b: memoryview, at: int) -> tuple[int, int]:
    n = 9 - b[at].bit_length() if at < len(b) and b[at] else 0
    v, to = read_size(b, at)
    return (v if v is not None else (1 << 7 * n) - 1) - ((1 << 7 * n - 1) - 1), to


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    key: bool
    cluster: int
    lace: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0


def frames(b: memoryview, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and (offset, size) of each frame of a block."""
    track, at = read_size(b, at)
    if track is None or at + 3 > end:
        raise BadMedia(f"block cut off at {at}")
    rel, flags = int.from_bytes(b[at : at + 2], "big", signed=True), b[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, rel, flags, [(at, end - at)]
    if at >= end:
        raise BadMedia("laced block without a count")
    n = b[at] + 1
    at += 1
    if lacing == FIXED:
        size, over = divmod(end - at, n)
        if over:
            raise BadMedia("fixed lacing doesn't divide the block")
        sizes = [size] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == XIPH:
                size = 0
                while at < end and b[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise BadMedia("lace cut off")
                size, at = size + b[at], at + 1
            elif i == 0:
                size, at = read_size(b, at)
                if size is None:
                    raise BadMedia("lace of unknown size")
            else:
                step, at = _signed(b, at)
                size = sizes[-1] + step
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise BadMedia("laces exceed their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, rel, flags, out


def parse(data: bytes, into: Media | None = None) -> Media:
    """Walk the elements. On broken bytes raises BadMedia; `into` then holds what came before."""
    b, m = memoryview(data), into if into is not None else Media()
    stack: list[tuple[int, int]] = []  # (id, end) of open masters
    at, base, segment = 0, 0, 0
    track: dict = {}
    cue = [0, 0, 0]
    first = True
    while True:
        while stack and at >= stack[-1][1]:
            kind, _ = stack.pop()
            if kind == TRACK_ENTRY:
                m.tracks.append(track)
            elif kind == CUE_TRACK_POSITIONS:
                m.cues.append(tuple(cue))
        if at >= len(b):
            break
        here = at
        kind, at = read_id(b, at)
        size, at = read_size(b, at)
        if first and kind != EBML:
            raise BadMedia("no EBML head")
        first = False
        if size is None:
            if kind not in (SEGMENT, CLUSTER):
                raise BadMedia(f"unknown size of element {kind:x}")
            end = len(b)
        else:
            end = at + size
        if kind in TOP and stack and stack[-1][0] == CLUSTER and stack[-1][1] == len(b):
            stack.pop()  # a cluster of unknown size ends where the next top element begins
        if end > (stack[-1][1] if stack else len(b)):
            raise BadMedia(f"element {kind:x} at {here} exceeds its parent")
        if kind == EBML:
            stack.append((EBML, end))
            continue
        if kind in MASTERS:
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                m.clusters += 1
                base = 0
            elif kind == TRACK_ENTRY:
                track = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "default": 0}
            elif kind == CUE_POINT:
                cue = [0, 0, 0]
            stack.append((kind, end))
            continue
        raw = b[at:end]
        number = int.from_bytes(raw, "big") if size is not None and size <= 8 else 0
        if kind == DOC_TYPE:
            m.doc_type = bytes(raw).rstrip(b"\0").decode("latin-1")
        elif kind == TIMESTAMP_SCALE:
            m.scale = number
        elif kind in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "default"}[kind]] = number
        elif kind == CODEC_ID:
            track["codec"] = bytes(raw).rstrip(b"\0").decode("latin-1")
        elif kind == SAMPLING_FREQUENCY:
            track["rate"] = float(np.frombuffer(raw, ">f4" if size == 4 else ">f8")[0]) if size in (4, 8) else 0.0
        elif kind == CLUSTER_TIMESTAMP:
            base = number
        elif kind in (SIMPLE_BLOCK, BLOCK):
            no, rel, flags, found = frames(b, at, end)
            step = next((t["default"] for t in m.tracks if t["number"] == no), 0)
            for i, (o, n) in enumerate(found):
                m.packets.append(Packet(no, (base + rel) * m.scale + i * step, o, n, bool(flags & 0x80) or kind == BLOCK, m.clusters - 1, i))
        elif kind == CUE_TIME:
            cue[0] = number
        elif kind == CUE_TRACK:
            cue[1] = number
        elif kind == CUE_CLUSTER_POSITION:
            cue[2] = segment + number
        at = end
    return m


# --- writing ---


def vint(v: int, n: int = 0) -> bytes:
    n = n or next(k for k in range(1, 9) if v < (1 << 7 * k) - 1)
    return (v | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, payload: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def uint(kind: int, v: int) -> bytes:
    return element(kind, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def block(track: int, rel: int, parts: list[bytes], lacing: int = NO_LACING, key: bool = True) -> bytes:
    """Body of a SimpleBlock of one frame, or of several under a lacing."""
    head = vint(track) + rel.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if lacing == NO_LACING:
        return head + parts[0]
    head += bytes([len(parts) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in parts[:-1])
    elif lacing == EBML_LACING:
        for i, x in enumerate(parts[:-1]):
            if i == 0:
                head += vint(len(x))
            else:
                d = len(x) - len(parts[i - 1])
                n = next(k for k in range(1, 9) if -((1 << 7 * k - 1) - 1) <= d <= (1 << 7 * k - 1) - 1)
                head += vint(d + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(parts)


def mux(samples: bytes, frame: int = FRAME, laces: int = 128, blocks: int = 16, rate: int = RATE) -> bytes:
    """8-bit samples as an audio track: frames of `frame` samples, `laces` in a block, `blocks` in a cluster."""
    scale = 1_000_000_000 * frame // rate  # one tick a frame
    n = len(samples) // frame
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, scale) + element(DURATION, np.array(float(n), ">f8").tobytes()) + element(MUXING_APP, b"tabulon") + element(WRITING_APP, b"tabulon"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(float(rate), ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, scale) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, n, laces * blocks):
        out = [uint(CLUSTER_TIMESTAMP, c)]
        for f in range(c, min(n, c + laces * blocks), laces):
            k = min(laces, n - f)
            run = samples[f * frame : (f + k) * frame]
            out.append(element(SIMPLE_BLOCK, vint(1) + (f - c).to_bytes(2, "big") + (bytes([0x80 | FIXED << 1, k - 1]) if k > 1 else b"\x80") + run))
        cluster = element(CLUSTER, b"".join(out))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def demux(data: bytes, m: Media, track: int = 1) -> bytes:
    """A track's bytes in packet order; neighbouring ranges are copied at once."""
    own = [p for p in m.packets if p.track == track]
    out, start, end = [], 0, 0
    for p in own:
        if p.offset != end:
            out.append(data[start:end])
            start = p.offset
        end = p.offset + p.size
    out.append(data[start:end])
    return b"".join(out)


def payload(text: bytes, frame: int = FRAME) -> bytes:
    return text.ljust(max(1, -(-len(text) // frame)) * frame, b" ")


def features(samples: bytes, m: Media, frame: int = FRAME) -> str:
    """Packets, duration, mean, root mean square about it, zero crossings and loudest frame of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    power = int((x.astype(np.uint32) ** 2).sum(dtype=np.int64)) / len(x)
    high = x >= 128
    loud = int(x.reshape(-1, frame).sum(axis=1, dtype=np.int64).argmax()) if len(x) % frame == 0 else 0
    t = m.tracks[0]
    return f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};codec={t['codec']};rate={t['rate']:.0f};ms={len(x) * 1000 // RATE};mean={mean:.4f};rms={max(0.0, power - mean * mean) ** 0.5:.4f};crossings={int((high[1:] != high[:-1]).sum())};loudest={loud}"


def _store(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 8 << 20):
            rows = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                media = mux(payload(raw))
                m = parse(media)
                back = demux(media, m)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, m), media if keep else None))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            take = 8 if keep else 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:take], kinds, strict=False))], names=["doc_id", *names[:take]])


def media_column(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Texts stored as Matroska audio and read back: sizes, digests, features (and the files in `media`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _store(it, keep),
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep else ""),
    )


def _packets(batches: Iterator[pa.RecordBatch], id_column: str) -> Iterator[pa.RecordBatch]:
    names = ["track", "timestamp_ns", "offset", "size", "key_frame", "cluster", "lace", "error"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        at, rows = [], []
        for i, data in enumerate(batch.column("media")):
            if not data.is_valid:
                continue
            m, error = Media(), None
            try:
                parse(data.as_py(), m)
            except BadMedia as e:
                error = str(e)
            own = [(p.track, p.timestamp, p.offset, p.size, p.key, p.cluster, p.lace, None) for p in m.packets]
            own += [(None,) * 7 + (error,)] if error else []
            at += [i] * len(own)
            rows += own
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_column, *names])


def packet_table(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row a packet of the `media` column: track, time, byte range, key flag, cluster, place in its lace."""
    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "media").mapInArrow(lambda it: _packets(it, id_column), f"{id_column} {kind}, track int, timestamp_ns long, offset long, size long, key_frame boolean, cluster int, lace int, error string")
