"""Media columns: Matroska files written and parsed in binary columns.

``packets`` walks variable-length EBML elements (known and unknown sizes), clusters, SimpleBlocks and BlockGroups, takes
apart Xiph, fixed-size and EBML lacing, and gives a table of packets: track, timestamp, byte range, key flag. ``cues``
gives the seek index. ``mux`` stores bytes losslessly as one track of 8-bit PCM samples.

Null values: a null text is empty (one frame of zeros), a null file has no packets. A file that breaks off yields the
packets that are whole. Repeated rows give repeated results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_text

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DURATION, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x4489, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 16


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 if all its bits are set (unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError("broken element")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise ValueError("broken element")
    value = int.from_bytes(data[at : at + size], "big")
    if keep:
        return value, at + size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), at + size


def coded(value: int, size: int = 0) -> bytes:
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def raw(number: int) -> bytes:
    return number.to_bytes(max(1, (number.bit_length() + 7) // 8), "big")


def element(kind: int, body: bytes) -> bytes:
    return raw(kind) + coded(len(body)) + body


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and body of a block: none for one frame, fixed-size for equal ones, EBML otherwise."""
    if len(frames) == 1:
        return 0, frames[0]
    count = bytes([len(frames) - 1])
    if len({*map(len, frames)}) == 1:
        return 0x04, count + b"".join(frames)
    head, last = coded(len(frames[0])), len(frames[0])
    for f in frames[1:-1]:
        step = len(f) - last
        size = next(n for n in range(1, 9) if abs(step) < (1 << 7 * n - 1) - 1)
        head += coded(step + (1 << 7 * size - 1) - 1, size)
        last = len(f)
    return 0x06, count + head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, lace: int = LACE, blocks: int = BLOCKS, rate: int = RATE) -> bytes:
    """A Matroska file with ``payload`` as mono 8-bit PCM of track 1; cues point to every cluster."""
    track = element(TRACK_NUMBER, b"\1") + element(TRACK_UID, b"\1") + element(TRACK_TYPE, b"\2") + element(CODEC_ID, b"A_PCM/INT/LIT")
    track += element(DEFAULT_DURATION, raw(frame * 1_000_000_000 // rate))
    track += element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + element(CHANNELS, b"\1") + element(BIT_DEPTH, b"\x08"))
    body = element(INFO, element(TIMESTAMP_SCALE, raw(1_000_000)) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    parts = [body + element(TRACKS, element(TRACK_ENTRY, track))]
    at, marks = len(parts[0]), b""
    for c in range(0, len(payload), frame * lace * blocks):
        stamp = c * 1000 // rate
        inner = [element(TIMESTAMP, raw(stamp))]
        for b in range(c, min(len(payload), c + frame * lace * blocks), frame * lace):
            end = min(len(payload), b + frame * lace)
            flags, data = laced([payload[i : min(i + frame, end)] for i in range(b, end, frame)])
            inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // rate - stamp, 0x80 | flags) + data))
        marks += element(CUE_POINT, element(CUE_TIME, raw(stamp)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, raw(at))))
        parts.append(element(CLUSTER, b"".join(inner)))
        at += len(parts[-1])
    parts.append(element(CUES, marks))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    begin: int
    end: int
    lace: int
    key: bool


def children(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """Ids and body ranges of the elements in a range; an unknown size reaches to the next element of the same or a
    higher level. A cluster of unknown size ends where another top element begins."""
    while at < end:
        try:
            kind, body = vint(data, at, keep=True)
            size, body = vint(data, body)
        except ValueError:
            return
        if inside and kind in TOP:
            return
        if size < 0:
            stop = end
            if kind == CLUSTER:
                stop = body
                for k, _, e in children(data, body, end, CLUSTER):
                    stop = e
            yield kind, body, stop
            at = stop
        elif body + size <= end or kind in TOP:  # of what breaks off, only the large elements are looked into
            yield kind, body, min(body + size, end)
            at = body + size
        else:
            return


def number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def lace_sizes(data: bytes, at: int, end: int, flags: int) -> tuple[list[int], int]:
    """Frame sizes of a block's body, and where the first frame begins."""
    kind = flags >> 1 & 3
    if not kind:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:  # Xiph: sums of bytes up to the first below 255
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:  # EBML: the first size, then signed differences
        if count > 1:
            size, at = vint(data, at)
            sizes.append(size)
            for _ in range(count - 2):
                step, after = vint(data, at)
                size += step - ((1 << 7 * (after - at) - 1) - 1)
                at = after
                sizes.append(size)
    else:
        return [(end - at) // count] * count, at
    return [*sizes, end - at - sum(sizes)], at


def packets(data: bytes | None) -> list[Packet]:
    """All whole packets of a file, in order."""
    out: list[Packet] = []
    for kind, a, b in children(data or b"", 0, len(data or b"")):
        if kind != SEGMENT:
            continue
        scale, default = 1_000_000, {}
        for kind, a1, b1 in children(data, a, b):
            if kind == INFO:
                for k, x, y in children(data, a1, b1):
                    scale = number(data, x, y) if k == TIMESTAMP_SCALE else scale
            elif kind == TRACKS:
                for k, x, y in children(data, a1, b1):
                    if k == TRACK_ENTRY:
                        facts = {k2: number(data, p, q) for k2, p, q in children(data, x, y) if k2 in (TRACK_NUMBER, DEFAULT_DURATION)}
                        default[facts.get(TRACK_NUMBER, 0)] = facts.get(DEFAULT_DURATION, 0)
            elif kind == CLUSTER:
                stamp = 0
                for k, x, y in children(data, a1, b1):
                    if k == TIMESTAMP:
                        stamp = number(data, x, y)
                        continue
                    key = True
                    if k == BLOCK_GROUP:
                        inner = {k2: (p, q) for k2, p, q in children(data, x, y)}
                        if BLOCK not in inner:
                            continue
                        key, (x, y) = REFERENCE not in inner, inner[BLOCK]
                    elif k != SIMPLE_BLOCK:
                        continue
                    try:
                        track, p = vint(data, x)
                        offset, flags = struct.unpack_from(">hB", data, p)
                        sizes, p = lace_sizes(data, p + 3, y, flags)
                    except (ValueError, IndexError, struct.error):
                        continue
                    key = bool(flags & 0x80) if k == SIMPLE_BLOCK else key
                    for i, size in enumerate(sizes):
                        if size < 0 or p + size > y:
                            break
                        out.append(Packet(track, (stamp + offset) * scale + i * default.get(track, 0), p, p + size, i, key))
                        p += size
    return out


def cues(data: bytes | None) -> list[tuple[int, int, int]]:
    """The seek index: (time, track, place of the cluster in the file)."""
    out = []
    for kind, a, b in children(data or b"", 0, len(data or b"")):
        for k1, a1, b1 in children(data, a, b) if kind == SEGMENT else ():
            for _, a2, b2 in children(data, a1, b1) if k1 == CUES else ():
                when = 0
                for k3, a3, b3 in children(data, a2, b2):
                    if k3 == CUE_TIME:
                        when = number(data, a3, b3)
                    elif k3 == CUE_POSITIONS:
                        facts = {k4: number(data, p, q) for k4, p, q in children(data, a3, b3)}
                        out.append((when, facts.get(CUE_TRACK, 0), a + facts.get(CUE_CLUSTER, 0)))
    return out


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def store(text: Column) -> Column:
    """A text's padded UTF-8 as a Matroska file."""
    return per_text(lambda texts: pa.array([mux(payload_of(t)) for t in texts], pa.binary()), "binary")(text)


def packet_rows(media: Column) -> Column:
    """array<struct<track, timestamp_ns, begin, end, lace, key>> of a binary column; explode it for a table."""
    kind = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("lace", pa.int32()), ("key", pa.bool_())]))
    run = lambda files: pa.array([[vars(p) for p in packets(f)] for f in files], kind)
    return per_text(run, "array<struct<track: int, timestamp_ns: long, begin: long, end: long, lace: int, key: boolean>>")(media)


def cue_rows(media: Column) -> Column:
    kind = pa.list_(pa.struct([("time", pa.int64()), ("track", pa.int32()), ("cluster", pa.int64())]))
    run = lambda files: pa.array([[dict(zip(("time", "track", "cluster"), c, strict=True)) for c in cues(f)] for f in files], kind)
    return per_text(run, "array<struct<time: long, track: int, cluster: long>>")(media)


def packet_table(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet: ``key``, then track, timestamp, byte range, place in its lace and key flag."""
    return files.select(key, F.explode(packet_rows(F.col(media))).alias("p")).select(key, "p.*")


def feature(samples: np.ndarray, found: list[Packet]) -> str:
    """What a decoder would look at: duration, level, zero crossings and energy of halves."""
    wave = samples.astype(np.int64) - 128
    half = len(wave) // 2
    crossings = int(((wave[1:] < 0) != (wave[:-1] < 0)).sum())
    last = found[-1].timestamp_ns // 1_000_000 if found else 0
    return f"packets={len(found)};last_ms={last};sum={int(wave.sum())};crossings={crossings};energy={int((wave[:half] ** 2).sum())}:{int((wave[half:] ** 2).sum())}"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload's figures come from the byte ranges of the stored file's packets.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def read(files: list[bytes | None]) -> pa.Array:
        out = []
        for f in files:
            found = packets(f)
            data = b"".join(f[p.begin : p.end] for p in found)
            out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(np.frombuffer(data, np.uint8), found)))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store(F.col("text")).alias("media"))
    got = per_text(read, "struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, feature: string>")
    return stored.select("doc_id", "n_bytes", got(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")
