"""Media column in MPEG audio: write payload bytes as frames of a stream, and read any stream back.

The stored form is an MPEG-1 layer III stream at 48 kHz: an ID3v2 tag with the payload's length,
a frame with the variable-bitrate table, then frames whose ancillary data are the payload bytes.
The unit of storage is the byte, so the payload is kept without loss. The last frame takes the
smallest bitrate that holds what is left, which makes the stream a variable-bitrate one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Scratch

# Fixed values of the MPEG audio format: kbit/s by bitrate index and Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of the format's layer II: bits of the allocation of each subband, as (bits, subbands), by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19)),
}
# Names by which encoders sign the table frame; the delay and padding that they leave follow them.
ENCODERS = (b"LAME", b"Lavf", b"Lavc", b"GOGO")

#: Header, checksum and side information (mono) of the frames that are written.
HEAD = 4 + 2 + 17
WRITE_RATE = 48_000


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ (0x8005 if r & 0x8000 else 0)) & 0xFFFF
        table.append(r)
    return table


_CRC = _crc_table()


def crc16(data: bytes, bits: int = 0) -> int:
    """The format's checksum: polynomial 0x8005, first value 0xFFFF. Of the last byte only ``bits`` count, if not 0."""
    r = 0xFFFF
    for b in data[:-1] if bits else data:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ b]
    for i in range(bits):
        over = (r >> 15) ^ (data[-1] >> (7 - i) & 1)
        r = (r << 1 & 0xFFFF) ^ (0x8005 if over else 0)
    return r


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    mono: bool
    bound: int  # subbands whose allocation each channel has for itself

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they aren't one. Free-format streams aren't read."""
    if four in _HEADERS:
        return _HEADERS[four]
    if len(_HEADERS) > 65_536:
        _HEADERS.clear()
    _HEADERS[four] = made = _header(four)
    return made


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate_i, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bits in (0, 15) or rate_i == 3 or four[3] & 3 == 2:
        return None
    kbps, rate = KBPS[1 if version == 3 else 2, layer][bits], RATES[version][rate_i]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, rate, size, samples, four[3] >> 6 == 3, bound)


def subbands(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer II frame."""
    each = h.kbps // (1 if h.mono else 2)
    if h.version != 3:
        table = "low"
    elif each <= 48:
        table = "d" if h.rate == 32000 else "c"
    else:
        table = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)]


def covered_bits(frame: bytes, h: Header) -> int:
    """Bits after the checksum that it covers: allocations (layer I), allocations and scale factor selections (II), side information (III)."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 2 * h.bound + 32 - h.bound)
    number, size, at, chosen = int.from_bytes(frame[6 : 6 + 64], "big"), 8 * len(frame[6 : 6 + 64]), 0, 0
    for band, bits in enumerate(subbands(h)):
        own = channels if band < h.bound else 1
        for _ in range(own):
            if number >> max(0, size - at - bits) & (1 << bits) - 1:
                chosen += channels // own
            at += bits
    return at + 2 * chosen


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether a protected frame of any layer has its checksum."""
    bits = covered_bits(frame, h)
    body = frame[6 : 6 + -(-bits // 8)]
    if 8 * len(body) < bits:
        return False
    return int.from_bytes(frame[4:6], "big") == _checksum(frame[2:4] + body, bits % 8)


def _own_header(bits: int) -> bytes:
    return bytes([0xFF, 0xFA, bits << 4 | 1 << 2, 0xC0])  # MPEG-1 layer III with checksum, 48 kHz, mono


def _own_head(bits: int) -> bytes:
    four, side = _own_header(bits), bytes(17)
    return four + struct.pack(">H", crc16(four[2:] + side)) + side


_HEADS = {bits: _own_head(bits) for bits in range(1, 15)}
_SIZES = {bits: header(_own_header(bits)).size for bits in range(1, 15)}
_FULL = _SIZES[14] - HEAD


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes, own: int | None = None) -> bytes:
    """The stored form of a payload of any length, of which the first ``own`` bytes (default: all) aren't padding."""
    whole, rest = divmod(len(payload), _FULL)
    bits = next(b for b in range(1, 15) if _SIZES[b] - HEAD >= rest)
    body = np.empty((whole, _SIZES[14]), np.uint8)
    body[:, :HEAD] = np.frombuffer(_HEADS[14], np.uint8)
    body[:, HEAD:] = np.frombuffer(payload, np.uint8, whole * _FULL).reshape(whole, _FULL)
    last = (_HEADS[bits] + payload[whole * _FULL :]).ljust(_SIZES[bits], b"\0") if rest else b""
    frames, audio = whole + bool(rest), body.nbytes + len(last)
    table_size = _SIZES[9]  # the table's own frame
    total = table_size + audio
    ends = np.minimum(np.ceil(np.arange(100) * frames / 100), whole) * _SIZES[14] + table_size
    toc = np.minimum(255, 256 * ends // max(total, 1)).astype(np.uint8).tobytes()
    xing = (_HEADS[9] + b"Xing" + struct.pack(">III", 7, frames, total) + toc).ljust(table_size, b"\0")
    private = b"quillforge\0" + struct.pack(">QQ", len(payload) if own is None else own, len(payload))
    frame = b"PRIV" + struct.pack(">I", len(private)) + b"\0\0" + private
    return b"".join((b"ID3\x03\0\0", _syncsafe(len(frame)), frame, xing, body.tobytes(), last))


@dataclass
class Stream:
    """What a stream holds. Frame offsets are bytes from the start; the table frame isn't audio."""

    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    vbr: dict | None = None
    bad_checksums: int = 0
    skipped_bytes: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding, where the table frame tells them."""
        left = (self.vbr or {}).get("delay", 0) + (self.vbr or {}).get("padding", 0)
        return max(0, self.samples - left)

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction: played samples and rate (1 where there is no frame)."""
        return self.played, self.headers[0].rate if self.headers else 1

    def seek(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample."""
        at = 0
        for offset, h in zip(self.offsets, self.headers, strict=True):
            if at <= sample < at + h.samples:
                return offset
            at += h.samples
        return None


def _tags(data: bytes) -> tuple[dict[str, bytes], int]:
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    tags, at, wide = {}, 10, data[3] >= 4
    while at + 10 <= min(end, len(data)) and re.fullmatch(rb"[A-Z0-9]{4}", data[at : at + 4]):
        s = data[at + 4 : at + 8]
        n = s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3] if wide else int.from_bytes(s, "big")
        tags[data[at : at + 4].decode()] = data[at + 10 : at + 10 + n]
        at += 10 + n
    return tags, end + 10 * bool(data[5] & 16)


def _table(data: bytes, at: int, h: Header) -> dict | None:
    start = at + 4 + 2 * h.protected + h.side
    if data[start : start + 4] in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8, {"kind": data[start : start + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = data[p : p + 100]
            p += 100
        p += 4 * bool(flags & 8)
        if data[p : p + 4] in ENCODERS and p + 24 <= at + h.size:
            both = int.from_bytes(data[p + 21 : p + 24], "big")
            out |= {"encoder": data[p : p + 9].rstrip(b"\0").decode("latin-1"), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    start = at + 4 + 32
    if data[start : start + 4] == b"VBRI":
        size, frames = struct.unpack(">II", data[start + 10 : start + 18])
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return None


def parse(data: bytes) -> Stream:
    """Walk a stream's frames.

    Where the next four bytes aren't a header that goes with the first one, the reader looks for the
    next place where one is followed by another (or by the end); what lies between is skipped. A
    frame that the end cuts off is skipped too, as is an ID3v1 tag.
    """
    out, size = Stream(), len(data)
    out.tags, at = _tags(data)
    if size >= at + 128 and data[-128:-125] == b"TAG":
        out.tags["ID3v1"] = data[-128:]
        size -= 128
    like: Header | None = None

    def fits(p: int) -> Header | None:
        h = header(data[p : p + 4])
        if h is None or p + h.size > size or like and (h.version, h.layer, h.rate) != (like.version, like.layer, like.rate):
            return None
        return h

    sure = False
    while at + 4 <= size:
        h = fits(at)
        if h and not sure:
            follow = at + h.size
            if follow < size and fits(follow) is None:
                h = None
        if h is None:
            sure, found = False, data.find(b"\xff", at + 1, size)
            found = size if found < 0 else found
            out.skipped_bytes += found - at
            at = found
            continue
        if h.protected and not checksum_holds(data[at : at + h.size], h):
            out.bad_checksums += 1
        if like is None and (table := _table(data, at, h)):
            out.vbr = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
        like, sure = like or h, True
        at += h.size
    out.skipped_bytes += max(0, size - at)
    return out


_SUMS: dict[tuple[bytes, int], int] = {}


def _checksum(covered: bytes, bits: int) -> int:
    key = covered, bits
    if key not in _SUMS:
        if len(_SUMS) > 4096:
            _SUMS.clear()
        _SUMS[key] = crc16(covered, bits)
    return _SUMS[key]


def decode(data: bytes) -> tuple[bytes, Stream]:
    """The payload and the stream of a stored form; ValueError where it isn't whole."""
    stream = parse(data)
    private = stream.tags.get("PRIV", b"")
    if not private.startswith(b"quillforge\0"):
        raise ValueError("the stream has no payload length")
    n = int.from_bytes(private[-8:], "big")
    payload = b"".join(data[at + HEAD : at + h.size] for at, h in zip(stream.offsets, stream.headers, strict=True))
    if len(payload) < n or stream.bad_checksums or any(payload[n:]):
        raise ValueError("the stream isn't whole")
    return payload[:n], stream


def feature(stream: Stream) -> str:
    """Duration, size and seek table in one line."""
    samples, rate = stream.seconds
    seeks = hashlib.sha1(np.asarray(stream.offsets, "<i8").tobytes()).hexdigest()[:16]
    kinds = ",".join(map(str, sorted({h.kbps for h in stream.headers})))
    toc = zlib.crc32(stream.vbr.get("toc", b"")) if stream.vbr else 0
    return f"samples={samples};rate={rate};frames={len(stream.offsets)};kbps={kinds};table={stream.vbr['frames'] if stream.vbr else '-'}:{toc:08x};seek={seeks};bad={stream.bad_checksums}"


#: The contract's columns, then what the method stores: the exact duration (samples at a rate), and where each frame starts.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("samples", T.LongType()),
    T.StructField("rate", T.LongType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
])
_KINDS = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def describe(doc_id: int | None, media: bytes) -> tuple:
    """A row of ``SCHEMA`` from a stored form alone; ValueError where it isn't whole."""
    payload, stream = decode(media)
    own = int.from_bytes(stream.tags["PRIV"][-16:-8], "big")
    digest = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()
    return doc_id, own, len(payload), *digest, feature(stream), *stream.seconds, stream.offsets


def to_media(docs: DataFrame) -> DataFrame:
    """The stored form of each text: doc_id, media (binary).

    One row per row, repeated rows and null doc_ids too; null is an empty text; padding is all zero, to 64 bytes
    at least. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raws = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(padded(r), len(r)) for r in raws], pa.binary())], names=["doc_id", "media"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for each row of ``stored`` (doc_id, media); a form that isn't whole fails the job.

    Where a duration's encoder delay and padding are told, they aren't counted. Frame offsets are bytes from the
    start of the stored form, so a player can seek without reading what comes before.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [describe(d, m.as_buffer().to_pybytes()) for d, m in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                columns = zip(*made, strict=True) if made else [[] for _ in SCHEMA]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[f.dataType]) for c, f in zip(columns, SCHEMA, strict=True)], names=SCHEMA.names)

    return stored.select("doc_id", "media").mapInArrow(run, SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as MPEG audio in a written table, read the stored bytes back and describe them.

    One row per row of ``docs`` (doc_id, text), repeated rows and null doc_ids too. Null and empty
    texts are 64 zero bytes. Other columns are ignored; an empty table gives no rows. The text and
    its stored form are in memory once per row, so a long text costs twice its size.
    """
    return read_media(Scratch(docs.sparkSession).save(to_media(docs)))
