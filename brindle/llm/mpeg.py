"""MPEG audio in binary columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import plain

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by the header's version bits
_KBPS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25 (2.5)
    layer: int
    crc: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    extension: int
    size: int  # bytes of the frame, header and padding included
    samples: int
    side: int  # bytes of Layer III side information


_SEEN: dict[int, Header | None] = {}


def parse_header(word: int) -> Header | None:
    """A 32-bit frame header; None if it is none (reserved values and free format count as none)."""
    key = word & 0xFFFFFFF0  # copyright, original and emphasis don't matter
    if key in _SEEN:
        return _SEEN[key]
    out = None
    v, lay, br, sr = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and v != 1 and lay and 0 < br < 15 and sr < 3:
        layer, one = 4 - lay, v == 3
        kbps, rate, mode, pad = _KBPS[one, layer][br - 1], _RATES[v][sr], word >> 6 & 3, word >> 9 & 1
        channels = 1 if mode == 3 else 2
        samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
        size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
        side = ((17 if channels == 1 else 32) if one else (9 if channels == 1 else 17)) if layer == 3 else 0
        if size > 4:
            out = Header({3: 1, 2: 2, 0: 25}[v], layer, not word >> 16 & 1, kbps, rate, channels, mode, word >> 4 & 3, size, samples, side)
    if len(_SEEN) < 1 << 16:
        _SEEN[key] = out
    return out


def _crc_table(poly: int) -> np.ndarray:
    t = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & 0x8000 else c << 1) & 0xFFFF
        t[b] = c
    return t


_CRC = _crc_table(0x8005)
_CRC_LIST = _CRC.tolist()


def crc16(data: np.ndarray) -> np.ndarray:
    """Frame checksums of rows of bytes: polynomial 0x8005, from 0xFFFF, high bits first."""
    crc = np.full(len(data), 0xFFFF, np.uint32)
    for j in range(data.shape[1]):
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ data[:, j]]
    return crc


def crc16_bits(data: bytes, n_bits: int) -> int:
    crc = 0xFFFF
    for b in data[: n_bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC_LIST[crc >> 8 ^ b]
    for i in range(n_bits // 8 * 8, n_bits):
        top = (crc >> 15) ^ (data[i // 8] >> (7 - i % 8) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _layer2_allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if h.rate == 48000 and each >= 56 or 56 <= each <= 80:
        return [4] * 11 + [3] * 12 + [2] * 4
    if each >= 96:
        return [4] * 11 + [3] * 12 + [2] * 7
    return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)


def protected_bits(h: Header, body: bytes) -> int | None:
    """Bits after the checksum that it covers; None if the frame is too short for them."""
    if h.layer == 3:
        bits = h.side * 8
    else:
        bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
        if h.layer == 1:
            bits = 128 if h.channels == 1 else 128 + 4 * bound
        else:
            bits, used, big = 0, 0, int.from_bytes(body, "big")
            for sb, n in enumerate(_layer2_allocation(h)):
                for _ in range(h.channels if sb < bound else 1):
                    if bits + n > len(body) * 8:
                        return None
                    if big >> (len(body) * 8 - bits - n) & ((1 << n) - 1):
                        used += 1 if sb < bound else h.channels
                    bits += n
            bits += 2 * used
    return bits if bits <= len(body) * 8 else None


@dataclass
class Audio:
    version: int | None = None
    layer: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    n_frames: int = 0
    samples: int = 0
    duration_num: int = 0
    duration_den: int = 1
    checked: int = 0
    bad_checksums: int = 0
    skipped_bytes: int = 0
    resyncs: int = 0
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    table_seek: list[int] | None = None
    encoder_delay: int = 0
    encoder_padding: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _text(b: bytes) -> str:
    if not b:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0])
    return (b[1:].decode(kind, "replace") if kind else b.decode("latin-1")).rstrip("\0")


def _id3v2(buf: bytes, at: int, tags: dict[str, str]) -> int:
    """Where the tag at ``at`` ends; ``at`` if there is none."""
    if buf[at : at + 3] != b"ID3" or len(buf) < at + 10 or max(buf[at + 6 : at + 10]) > 127:
        return at
    major, flags, size = buf[at + 3], buf[at + 5], _syncsafe(buf[at + 6 : at + 10])
    end = min(len(buf), at + 10 + size)
    p = at + 10
    if flags & 0x40 and p + 4 <= end:
        p += _syncsafe(buf[p : p + 4]) if major == 4 else 4 + int.from_bytes(buf[p : p + 4], "big")
    id_, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= end and buf[p]:
        name = buf[p : p + id_].decode("latin-1")
        n = int.from_bytes(buf[p + 3 : p + 6], "big") if major == 2 else _syncsafe(buf[p + 4 : p + 8]) if major == 4 else int.from_bytes(buf[p + 4 : p + 8], "big")
        if p + head + n > end:
            break
        if name[0] == "T" and name[:3] != "TXX":
            tags.setdefault(name, _text(buf[p + head : p + head + n]))
        p += head + n
    return min(len(buf), end + (10 if flags & 0x10 else 0))


def _tail(buf: bytes, tags: dict[str, str]) -> int:
    """Where trailing ID3v1 and APE tags begin."""
    end = len(buf)
    while True:
        if end >= 128 and buf[end - 128 : end - 125] == b"TAG":
            end -= 128
            for k, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                if v := buf[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                    tags.setdefault(k, v)
        elif end >= 32 and buf[end - 32 : end - 24] == b"APETAGEX":
            size, flags = int.from_bytes(buf[end - 20 : end - 16], "little"), int.from_bytes(buf[end - 12 : end - 8], "little")
            start = end - size - (32 if flags >> 31 else 0)
            if size < 32 or start < 0:
                return end
            p = end - size
            for _ in range(int.from_bytes(buf[end - 16 : end - 12], "little")):
                n, key = int.from_bytes(buf[p : p + 4], "little"), buf.find(b"\0", p + 8, end - 32)
                if key < 0 or key + 1 + n > end - 32:
                    break
                tags.setdefault("APE:" + buf[p + 8 : key].decode("latin-1"), buf[key + 1 : key + 1 + n].decode("utf-8", "replace"))
                p = key + 1 + n
            end = start
        else:
            return end


def _vbr_table(buf: bytes, at: int, h: Header, out: Audio) -> bool:
    """Whether the frame is a table (Xing, Info, VBRI) rather than sound; fills in what it says."""
    frame = buf[at : at + h.size]
    p = 4 + 2 * h.crc + h.side
    if h.layer != 3 or frame[p : p + 4] not in (b"Xing", b"Info"):
        p = 4 + h.side
    if h.layer == 3 and frame[p : p + 4] in (b"Xing", b"Info") and len(frame) >= p + 8:
        out.table = frame[p : p + 4].decode()
        flags, q = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
        if flags & 1:
            out.table_frames, q = int.from_bytes(frame[q : q + 4], "big"), q + 4
        if flags & 2:
            out.table_bytes, q = int.from_bytes(frame[q : q + 4], "big"), q + 4
        if flags & 4 and len(frame) >= q + 100:
            out.table_seek, q = list(frame[q : q + 100]), q + 100
        q += 4 * (flags >> 3 & 1)
        if len(frame) >= q + 24 and frame[q : q + 4] in (b"LAME", b"Lavf", b"Lavc"):
            both = int.from_bytes(frame[q + 21 : q + 24], "big")
            out.encoder_delay, out.encoder_padding = both >> 12, both & 0xFFF
        return True
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        n, scale, width = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58))
        if 0 < width <= 4 and len(frame) >= 62 + n * width:
            out.table_seek = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(n)]
        return True
    return False


def parse_mpeg(buf: bytes) -> Audio:
    """Everything of one stream. A frame counts if its header fits the stream's (version, layer) and it is whole, and, where the
    reader had lost step, if a header of the same version, layer and sample rate or the end of the data follows it. In step, the
    sample rate may change from frame to frame, as where streams were joined: every frame's time is counted at its own rate, and
    ``sample_rate`` is the first frame's."""
    out = Audio()
    at = 0
    while (after := _id3v2(buf, at, out.tags)) > at:
        at = after
    end = _tail(buf, out.tags)
    rate_samples: dict[int, int] = {}
    offsets: list[int] = []
    heads: list[Header] = []
    locked, first = False, None
    word = int.from_bytes
    while at + 4 <= end:
        h = parse_header(word(buf[at : at + 4], "big")) if buf[at] == 255 else None
        good = h is not None and at + h.size <= end and (first is None or (h.version, h.layer) == (first.version, first.layer))
        if good and not locked:
            nxt = at + h.size
            if nxt + 4 <= end:
                g = parse_header(word(buf[nxt : nxt + 4], "big"))
                good = g is not None and (g.version, g.layer, g.rate) == (h.version, h.layer, h.rate)
            else:
                good = nxt == end
        if good:
            if first is None:
                first = h
                out.version, out.layer, out.sample_rate, out.channels = h.version, h.layer, h.rate, h.channels
                if _vbr_table(buf, at, h, out):
                    at, locked = at + h.size, True
                    continue
            offsets.append(at)
            heads.append(h)
            rate_samples[h.rate] = rate_samples.get(h.rate, 0) + h.samples
            at, locked = at + h.size, True
            continue
        if locked:
            out.resyncs += 1
        locked = False
        nxt = buf.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped_bytes += nxt - at
        at = nxt
    if at < end:
        out.skipped_bytes += end - at
    out.n_frames, out.offsets = len(offsets), np.array(offsets, np.int64)
    _check(buf, offsets, heads, out)
    if first is not None and rate_samples:
        trim = min(out.encoder_delay + out.encoder_padding, rate_samples.get(first.rate, 0))
        rate_samples[first.rate] = rate_samples.get(first.rate, 0) - trim
        out.samples = sum(rate_samples.values())
        den = math.lcm(*rate_samples)
        num = sum(n * (den // r) for r, n in rate_samples.items())
        g = math.gcd(num, den)
        out.duration_num, out.duration_den = num // g, den // g
    return out


def _check(buf: bytes, offsets: list[int], heads: list[Header], out: Audio) -> None:
    raw = np.frombuffer(buf, np.uint8)
    by_length: dict[int, list[int]] = {}
    for at, h in zip(offsets, heads, strict=True):
        if not h.crc:
            continue
        out.checked += 1
        if h.layer == 2:
            body = buf[at + 6 : at + min(h.size, 6 + 64)]
            bits = protected_bits(h, body)
            out.bad_checksums += bits is None or crc16_bits(buf[at + 2 : at + 4] + body, 16 + bits) != int.from_bytes(buf[at + 4 : at + 6], "big")
        else:
            bits = protected_bits(h, buf[at + 6 : at + h.size])
            if bits is None:
                out.bad_checksums += 1
            else:
                by_length.setdefault(bits // 8, []).append(at)
    for n, places in by_length.items():
        p = np.array(places)
        cover = raw[p[:, None] + np.concatenate(([2, 3], np.arange(6, 6 + n)))]
        out.bad_checksums += int((crc16(cover) != raw[p + 4].astype(np.uint32) << 8 | raw[p + 5]).sum())


SCHEMA = pa.schema(
    [
        ("version", pa.int32()), ("layer", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()), ("samples", pa.int64()),
        ("duration_num", pa.int64()), ("duration_den", pa.int64()), ("checked", pa.int64()), ("bad_checksums", pa.int64()), ("skipped_bytes", pa.int64()), ("resyncs", pa.int64()),
        ("vbr_table", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_seek", pa.list_(pa.int64())),
        ("encoder_delay", pa.int32()), ("encoder_padding", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("frame_offsets", pa.list_(pa.int64())),
    ]
)
DDL = (
    "version int, layer int, sample_rate int, channels int, n_frames bigint, samples bigint, duration_num bigint, duration_den bigint, checked bigint, bad_checksums bigint, skipped_bytes bigint, resyncs bigint, "
    "vbr_table string, table_frames bigint, table_bytes bigint, table_seek array<bigint>, encoder_delay int, encoder_padding int, tags map<string,string>, frame_offsets array<bigint>"
)
_FIELDS = ["version", "layer", "sample_rate", "channels", "n_frames", "samples", "duration_num", "duration_den", "checked", "bad_checksums", "skipped_bytes", "resyncs", "table", "table_frames", "table_bytes", "table_seek", "encoder_delay", "encoder_padding", "tags"]
_ROWS = 256


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            audio = [None if m is None else parse_mpeg(m) for m in part.column("media").to_pylist()]
            columns = []
            for f, t in zip(_FIELDS, SCHEMA, strict=False):
                get = (lambda a: list(a.tags.items())) if f == "tags" else (lambda a, f=f: getattr(a, f))
                columns.append(pa.array([None if a is None else get(a) for a in audio], t.type))
            sizes = np.array([0 if a is None else len(a.offsets) for a in audio])
            flat = np.concatenate([np.zeros(0, np.int64), *(a.offsets for a in audio if a is not None)])
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            offsets = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([a is None for a in audio]))
            yield pa.record_batch([part.column("id"), *columns, offsets], names=["id", *SCHEMA.names])


def media_columns(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id_column, ...): what ``parse_mpeg`` finds in each binary of ``media_column``, with the offset of every frame of sound.

    The duration is the fraction duration_num / duration_den seconds, from the samples of the frames there are less the
    encoder's delay and padding where a table states them; frame i of ``frame_offsets`` starts after i times the frame's
    samples. A null binary has nulls throughout; an empty one, or one without frames, has no version and 0 frames. Repeated
    rows give repeated rows, null ids are carried as they are, extra columns are ignored, an empty table gives no rows."""
    rows = plain(df, id_column, media_column).toDF("id", "media").selectExpr("cast(id as bigint) as id", "cast(media as binary) as media")
    return rows.mapInArrow(_parsed, f"id bigint, {DDL}").withColumnRenamed("id", id_column)


# --- streams to read: texts carried as MPEG audio -------------------------------------------------------------------------


def _header_word(version: int, layer: int, crc: bool, kbps: int, rate: int, mode: int, pad: int = 0) -> int:
    v = {1: 3, 2: 2, 25: 0}[version]
    return 0x7FF << 21 | v << 19 | (4 - layer) << 17 | (not crc) << 16 | (_KBPS[version == 1, layer].index(kbps) + 1) << 12 | _RATES[v].index(rate) << 10 | pad << 9 | mode << 6


#: (version, layer, checksum, bitrates in turn, sample rate, mode)
SHAPES = (
    (1, 3, True, (128,), 44100, 0), (1, 3, False, (96, 160, 224, 128), 44100, 1), (2, 3, True, (64, 80), 22050, 3), (25, 3, False, (32,), 11025, 3),
    (1, 1, True, (192,), 48000, 0), (1, 3, True, (320,), 48000, 1), (1, 3, True, (64, 112, 192), 32000, 0), (1, 2, True, (192,), 44100, 0),
)


@dataclass
class Truth:
    offsets: list[int]
    samples: int
    rate: int
    bad: int
    garbage: int


def carried(doc_id: int, text: str) -> tuple[bytes, Truth]:
    """A stream whose frames carry the whole text, XORed so that false frame headers occur, and what a reader must find in it.
    The shape depends on the id: tags, a VBR table, stray bytes after every 50th frame, a wrong checksum in every 97th."""
    version, layer, crc, rates, rate, mode = SHAPES[doc_id % len(SHAPES)]
    data = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) ^ 0xA5).tobytes()
    shapes = []
    for kbps in rates:
        word = _header_word(version, layer, crc, kbps, rate, mode)
        h = parse_header(word)
        room = 0 if layer == 3 else 32 if layer == 1 else 48
        shapes.append((word.to_bytes(4, "big"), h, 2 * crc, h.side + room))
    out = bytearray()
    if doc_id % 3 == 0:
        title = b"\x03" + f"document {doc_id}".encode()
        body = b"TIT2" + bytes([len(title) >> 21 & 127, len(title) >> 14 & 127, len(title) >> 7 & 127, len(title) & 127]) + b"\0\0" + title
        out += b"ID3\x04\0\0" + bytes([0, 0, len(body) >> 7 & 127, len(body) & 127]) + body
    table_at = None
    if layer == 3 and len(rates) > 1:
        head, h, _, _ = shapes[0]
        table_at = len(out) + 4 + 2 * crc + h.side
        frame = bytearray(head + bytes(h.size - 4))
        out += frame
    truth, p, i = Truth([], 0, rate, 0, 0), 0, 0
    while p < len(data) or i == 0:
        head, h, gap, reserved = shapes[i % len(shapes)]
        room = h.size - 4 - gap - reserved
        side = bytes(reserved) if layer != 3 else bytes([(i * 7 + j) & 127 for j in range(4)]) + bytes(reserved - 4)
        body = side + data[p : p + room].ljust(room, b"\0")
        p += room
        truth.offsets.append(len(out))
        truth.samples += h.samples
        check = b""
        if crc:
            c = crc16_bits(head[2:4] + body[:64], 16 + protected_bits(h, body[:64]))
            wrong = i % 97 == 96
            truth.bad += wrong
            check = (c ^ wrong).to_bytes(2, "big")
        out += head + check + body
        i += 1
        if i % 50 == 0 and p < len(data):
            stray = b"\xff\xe0stray bytes" + bytes([doc_id & 127])
            out += stray
            truth.garbage += len(stray)
    if table_at is not None:
        table = b"Xing" + (7).to_bytes(4, "big") + i.to_bytes(4, "big") + len(out).to_bytes(4, "big") + bytes(j * 256 // 100 for j in range(100))
        out[table_at : table_at + len(table)] = table
    if doc_id % 4 == 1:
        out += b"TAG" + f"document {doc_id}".encode().ljust(125, b"\0")
    return bytes(out), truth


def _carrying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            media = [None if t is None else carried(abs(i or 0), t)[0] for i, t in zip(ids, texts, strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as an MPEG audio stream; null texts have null media, empty ones a stream of one frame. A null
    id is carried and shapes the stream like 0; repeated rows give equal streams; extra columns are ignored; an empty table gives
    no rows."""
    return plain(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_carrying, "doc_id bigint, media binary")
