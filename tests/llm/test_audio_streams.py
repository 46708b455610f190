"""MPEG audio: features computed apart from the module, checksums of all layers, the encoder's delay, stored offsets."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillforge.llm import audio


def plain_crc(bits):
    r = 0xFFFF
    for b in bits:
        top = r >> 15 & 1
        r = (r << 1) & 0xFFFF
        if top ^ b:
            r ^= 0x8005
    return r


def to_bits(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def frame(layer, second, third, body, bits):
    """A protected MPEG-1 frame: its body, of which the first bits are covered by the checksum."""
    head = bytes([0xFF, 0xF8 | (4 - layer) << 1, second, third])
    size = audio.header(head).size
    crc = plain_crc(to_bits(head[2:4]) + to_bits(body)[:bits])
    return (head + struct.pack(">H", crc) + body).ljust(size, b"\0")


@pytest.mark.parametrize("layer, second, third, body, bits", [
    (1, 0x54, 0xC0, bytes(range(1, 17)), 128),  # mono: 32 allocations of 4 bits
    (1, 0x94, 0x00, bytes(range(32)), 256),  # stereo
    (1, 0x94, 0x50, bytes(range(40)), 4 * (2 * 8 + 24)),  # joint from subband 8 on
    # Mono, 48 kHz, 64 kbit/s: table a has 11 * 4 + 12 * 3 + 4 * 2 = 88 bits; all subbands but none are allocated.
    (2, 0x44, 0xC0, bytes(40), 88),
    # The same with the first two subbands allocated: two selections of 2 bits more.
    (2, 0x44, 0xC0, bytes([0x11]) + bytes(40), 92),
    # Mono, 44.1 kHz, 32 kbit/s: table c has 2 * 4 + 6 * 3 = 26 bits.
    (2, 0x10, 0xC0, bytes([0x10]) + bytes(40), 28),
])
def test_checksums_of_layers_one_and_two(layer, second, third, body, bits):
    made = frame(layer, second, third, body, bits)
    h = audio.header(made[:4])
    assert h.protected and h.layer == layer and audio.covered_bits(made, h) == bits
    stream = audio.parse(made * 4)
    assert len(stream.offsets) == 4 and stream.bad_checksums == 0
    broken = bytearray(made * 4)
    broken[len(made) + 6] ^= 0x80
    assert audio.parse(bytes(broken)).bad_checksums == 1


def test_delay_and_padding_of_the_encoder_are_not_played():
    media = bytearray(audio.encode(random.Random(3).randbytes(9000)))
    at = media.index(b"Xing") + 4 + 4 + 4 + 4 + 100
    media[at : at + 9] = b"LAME3.100"
    media[at + 21 : at + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    stream = audio.parse(bytes(media))
    assert stream.vbr["encoder"] == "LAME3.100" and (stream.vbr["delay"], stream.vbr["padding"]) == (576, 1000)
    assert stream.seconds == (1152 * len(stream.offsets) - 1576, 48_000) and stream.bad_checksums == 0


def plain_feature(media):
    """Frames by plain steps from the end of the tag; only streams as ``encode`` writes them."""
    at = 10 + sum((media[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    sizes = {1: 96, 2: 120, 3: 144, 4: 168, 5: 192, 6: 240, 7: 288, 8: 336, 9: 384, 10: 480, 11: 576, 12: 672, 13: 768, 14: 960}
    kbps = dict(zip(range(1, 15), (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)))
    offsets, rates, toc, count = [], set(), b"", None
    while at < len(media):
        assert media[at : at + 2] == b"\xff\xfa"
        index = media[at + 2] >> 4
        if count is None:
            assert media[at + 23 : at + 27] == b"Xing"
            count, toc = int.from_bytes(media[at + 31 : at + 35], "big"), media[at + 39 : at + 139]
        else:
            offsets.append(at)
            rates.add(kbps[index])
        at += sizes[index]
    seek = hashlib.sha1(b"".join(struct.pack("<q", x) for x in offsets)).hexdigest()[:16]
    return offsets, f"samples={1152 * len(offsets)};rate=48000;frames={len(offsets)};kbps={','.join(map(str, sorted(rates)))};table={count}:{zlib.crc32(toc):08x};seek={seek};bad=0"


def test_features_and_offsets_equal_plain_steps(spark):
    rng = random.Random(5)
    texts = [None, "", "é" * 700, *["x" * rng.randint(1, 6000) for _ in range(12)], "\xff\xfa" * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same"), (3, "same"), (3, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("samples", F.lit(2))
    media = [(str(r.doc_id), bytes(r.media)) for r in audio.to_media(df).collect()]
    got = sorted((str(r.doc_id), r.feature, r.samples, r.rate, r.frame_offsets, r.media_bytes) for r in audio.media_features(df).collect())
    want = []
    for doc, m in media:
        offsets, line = plain_feature(m)
        want.append((doc, line, 1152 * len(offsets), 48_000, offsets, len(m)))
    assert got == sorted(want) and len(got) == len(rows)
    assert audio.media_features(df.where("false")).collect() == []
    with pytest.raises(Exception, match="isn't whole"):
        audio.read_media(spark.createDataFrame([(1, bytearray(media[3][1][:-200]))], "doc_id long, media binary")).collect()
