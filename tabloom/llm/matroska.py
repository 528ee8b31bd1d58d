"""Operator 8: Matroska media columns.

A parser for the variable-length elements of EBML: tracks, clusters, simple blocks and block
groups with every kind of lacing, and cues, as a packet table with timestamps, tracks and byte
ranges; and a writer that stores bytes as 8-bit PCM samples in such a file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields_of, slices, with_fields

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE, FRAME_NS = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, READ_VERSION = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Packet(NamedTuple):
    """timestamp: in nanoseconds."""

    track: int
    timestamp: int
    start: int
    end: int
    cluster: int
    lace: int
    keyframe: bool


class Media(NamedTuple):
    scale: int
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, next place, length); for a size, all ones mean unknown and give -1."""
    if at >= len(data):
        raise ValueError(f"a number is cut off at {at}")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no variable-length number at {at}")
    value = int.from_bytes(data[at : at + length])
    if not keep_marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            value = -1
    return value, at + length, length


def vint(value: int, length: int = 0) -> bytes:
    while not length or value >= (1 << 7 * length) - 1:
        length += 1
    return (value | 1 << 7 * length).to_bytes(length)


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8) + vint(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) one after another; an unknown size ends at an element that can't be inside."""
    while at < end:
        kind, body, _ = read_vint(data, at, True)
        size, body, _ = read_vint(data, body)
        if size < 0:
            stop, inner = body, body
            tops = {CLUSTER, CUES, TRACKS, INFO} if kind == CLUSTER else {EBML, SEGMENT}
            while inner < end:
                below, inner_body, _ = read_vint(data, inner, True)
                if below in tops:
                    break
                n, inner_body, _ = read_vint(data, inner_body)
                inner = end if n < 0 else inner_body + n
                stop = min(inner, end)
            yield kind, body, stop
            at = stop
        else:
            if body + size > end:
                raise ValueError(f"element {kind:#x} at {at} ends after its parent")
            yield kind, body, body + size
            at = body + size


def frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block whose header ends at `at`."""
    if lacing == NO_LACING:
        return [(at, end)]
    n = data[at] + 1
    at += 1
    if lacing == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("frames of fixed lacing have unequal sizes")
        sizes = [size] * n
    elif lacing == XIPH:
        sizes = []
        for _ in range(n - 1):
            size = 0
            while (x := data[at]) == 255:
                size, at = size + 255, at + 1
            sizes.append(size + x)
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        sizes = []
        for k in range(n - 1):
            value, at, length = read_vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * length - 1) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("laces run over their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets of all clusters in file order; raises ValueError for what isn't such a file.

    A frame in a lace begins where the one before it ends: after the track's frame duration, else an equal
    share of its block's duration, else with its block. Simple blocks say whether they are keyframes; blocks in
    groups are if they refer to no other block.
    """
    media = Media(1_000_000, [], [], [], [])
    number = lambda a, b: int.from_bytes(data[a:b])
    scale, each = media.scale, {}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        segment = a
        for kind, a, b in elements(data, a, b):  # noqa: B020, PLW2901
            if kind == INFO:
                scale = next((number(x, y) for k, x, y in elements(data, a, b) if k == SCALE), scale)
            elif kind == TRACKS:
                for k, x, y in elements(data, a, b):
                    if k == TRACK:
                        track = {}
                        for f, p, q in elements(data, x, y):
                            if f == CODEC:
                                track["codec"] = data[p:q].decode()
                            elif f in (TRACK_NUMBER, TRACK_TYPE, LACING, FRAME_NS):
                                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", LACING: "lacing", FRAME_NS: "frame_ns"}[f]] = number(p, q)
                            elif f == AUDIO:
                                for g, r, s in elements(data, p, q):
                                    if g == RATE:
                                        track["rate"] = struct.unpack(">d" if s - r == 8 else ">f", data[r:s])[0]
                                    elif g in (CHANNELS, DEPTH):
                                        track["channels" if g == CHANNELS else "depth"] = number(r, s)
                        media.tracks.append(track)
                        each[track.get("number")] = track.get("frame_ns", 0)
            elif kind == CLUSTER:
                base, place = 0, len(media.clusters)
                media.clusters.append(a)
                for k, x, y in elements(data, a, b):
                    if k == TIMESTAMP:
                        base = number(x, y)
                    elif k == SIMPLE_BLOCK:
                        block(data, x, y, base, scale, place, media.packets, each)
                    elif k == BLOCK_GROUP:
                        inside = list(elements(data, x, y))
                        lasts = next((number(p, q) * scale for f, p, q in inside if f == BLOCK_DURATION), 0)
                        key = all(f != REFERENCE for f, _, _ in inside)
                        for f, p, q in inside:
                            if f == BLOCK:
                                block(data, p, q, base, scale, place, media.packets, each, key, lasts)
            elif kind == CUES:
                for k, x, y in elements(data, a, b):
                    if k == CUE_POINT:
                        time, found = 0, []
                        for f, p, q in elements(data, x, y):
                            if f == CUE_TIME:
                                time = number(p, q)
                            elif f == CUE_POSITIONS:
                                found.append({g: number(r, s) for g, r, s in elements(data, p, q) if g in (CUE_TRACK, CUE_CLUSTER)})
                        media.cues.extend((time, c.get(CUE_TRACK, 0), segment + c.get(CUE_CLUSTER, 0)) for c in found)
    return media._replace(scale=scale)


def block(data: bytes, at: int, end: int, base: int, scale: int, cluster: int, packets: list[Packet], each: dict[int, int], key: bool | None = None, lasts: int = 0) -> None:
    """Adds a block's frames. each: nanoseconds of a track's frame, 0 if not known; lasts: those of the block."""
    track, at, _ = read_vint(data, at)
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    found = frames(data, at + 3, end, flags >> 1 & 3)
    step = each.get(track) or lasts // len(found)
    for k, (a, b) in enumerate(found):
        packets.append(Packet(track, (base + offset) * scale + k * step, a, b, cluster, k, bool(flags & 0x80) if key is None else key))


def laced(parts: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return parts[0]
    head = bytes([len(parts) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in parts[:-1])
    elif lacing == EBML_LACING and len(parts) > 1:
        head += vint(len(parts[0]))
        for p, q in zip(parts, parts[1:-1]):
            step, length = len(q) - len(p), 1
            while abs(step) >= (1 << 7 * length - 1) - 1:
                length += 1
            head += vint(step + (1 << 7 * length - 1) - 1, length)
    return head + b"".join(parts)


def mux(samples: bytes, rate: int = 8000, frame: int = 1024, laces: int = 4, blocks: int = 8) -> bytes:
    """samples as one mono track of unsigned 8-bit PCM; blocks take the kinds of lacing in turn."""
    header = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(READ_VERSION, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"tabloom") + element(WRITER, b"tabloom") + element(DURATION, struct.pack(">d", len(samples) * 1000 / rate)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + uint(FRAME_NS, frame * 1_000_000_000 // rate) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts = [samples[i : i + frame] for i in range(0, len(samples), frame)]
    groups = [parts[i : i + laces] for i in range(0, len(parts), laces)]
    body, cues = [info, tracks], []
    place, sample = len(info) + len(tracks), 0
    for c in range(0, len(groups), blocks):
        time = sample * 1000 // rate
        out = [uint(TIMESTAMP, time)]
        for g, group in enumerate(groups[c : c + blocks], c):
            sizes = {len(p) for p in group}
            lacing = NO_LACING if len(group) == 1 else (XIPH, EBML_LACING, FIXED)[g % 3]
            lacing = XIPH if lacing == FIXED and len(sizes) > 1 else lacing
            out.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", sample * 1000 // rate - time, 0x80 | lacing << 1) + laced(group, lacing)))
            sample += sum(map(len, group))
        cluster = element(CLUSTER, b"".join(out))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return header + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the unpadded length."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


PACKETS = "track int, timestamp_ns long, byte_start long, byte_end long, cluster int, lace int, keyframe boolean"


def packet_table(media: DataFrame, content: str = "content") -> DataFrame:
    """One row for each packet of each file in a binary column, the other columns kept; see PACKETS.

    Null, empty and damaged contents give no packets; repeated rows give theirs each; an empty table gives no rows. Columns
    of the input with a packet column's name are replaced. A file of any length is parsed whole, a few files at a time.
    """
    names = list(fields_of(PACKETS))
    kept = media.drop(*names)
    others = [c for c in kept.columns if c != content]
    schema = with_fields(kept.select(*others), fields_of(PACKETS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, content):
            rows = []
            for i, data in enumerate(batch.column(batch.schema.get_field_index(content)).to_pylist()):
                try:
                    found = parse(data or b"")
                except (ValueError, IndexError, struct.error):
                    continue
                rows += [(i, *p) for p in found.packets]
            if rows:
                at, *columns = zip(*rows)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                left = batch.select(others).take(pa.array(at)) if others else None
                yield pa.RecordBatch.from_arrays([*(left.columns if left else ()), *map(pa.array, columns, kinds)], [*others, *names])

    return kept.mapInArrow(find, schema)


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, text: str = "text", media: str | None = None) -> DataFrame:
    """docs with the columns of STORED (and, if named, the file itself) in place of the text.

    The text's payload (see payload_of) is muxed, parsed again, and its packets' bytes joined; all
    columns but n_bytes come from what was read back. feature: packets, clusters, cues, lacings'
    frames, the last frame's start and sums of the samples and their squares. Null counts as an empty text; texts of any length are
    stored whole; repeated rows are stored each; an empty table gives no rows; of the input's columns, those with the added names are replaced.
    """
    added = fields_of(STORED) | ({media: "binary"} if media else {})
    names = list(added)
    kept = docs.drop(*names)
    others = [c for c in kept.columns if c != text]
    schema = with_fields(kept.select(*others), added)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, text):
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                samples, n = payload_of(t)
                data = mux(samples)
                found = parse(data)
                back = b"".join([data[p.start : p.end] for p in found.packets])
                x = np.frombuffer(back, np.uint8).astype(np.int64)
                of = {c for _, _, c in found.cues} == {a - (len(vint(b - a)) + 4) for a, b in cluster_ranges(data)}
                feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cues={len(found.cues)};indexed={int(of)};laced={sum(p.lace > 0 for p in found.packets)};last_ms={found.packets[-1].timestamp // 1_000_000};sum={int(x.sum())};squares={int((x * x).sum())}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, *[data] * bool(media)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*others, *names])

    return kept.mapInArrow(store, schema)


def cluster_ranges(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the clusters' bodies."""
    return [(x, y) for kind, a, b in elements(data, 0, len(data)) if kind == SEGMENT for k, x, y in elements(data, a, b) if k == CLUSTER]
