import random

import numpy as np
import pytest

from brindle.llm import mpeg
from brindle.llm.mpeg import SHAPES, as_media, carried, crc16, crc16_bits, media_columns, parse_header, parse_mpeg

from .conftest import DOC, LONG, ODD


def _agrees(media, truth):
    a = parse_mpeg(media)
    assert list(a.offsets) == truth.offsets and a.n_frames == len(truth.offsets)
    assert (a.samples, a.sample_rate, a.bad_checksums, a.skipped_bytes) == (truth.samples, truth.rate, truth.bad, truth.garbage)
    assert a.duration_num * truth.rate == truth.samples * a.duration_den
    return a


@pytest.mark.parametrize("doc_id", range(24))
def test_streams_round_trip(doc_id):
    rng = random.Random(doc_id)
    for size in (0, 1, 700, 60_000):
        text = "".join(rng.choice("abcdeZZ é\n") for _ in range(size))
        a = _agrees(*carried(doc_id, text))
        version, layer, crc, rates, rate, mode = SHAPES[doc_id % 8]
        assert (a.version, a.layer, a.sample_rate, a.channels) == (version, layer, rate, 1 if mode == 3 else 2)
        assert a.checked == (a.n_frames if crc else 0)
        assert (a.tags.get("TIT2") == f"document {doc_id}") == (doc_id % 3 == 0 or doc_id % 4 == 1)
        if layer == 3 and len(rates) > 1:
            assert a.table == "Xing" and a.table_frames == a.n_frames and len(a.table_seek) == 100


def test_long_stream():
    a = _agrees(*carried(1, LONG))
    assert a.n_frames > 500 and a.resyncs == a.n_frames // 50 - (a.n_frames % 50 == 0)


def test_noise_before_between_and_after():
    media, truth = carried(6, "word " * 2000)
    start = 10 + int.from_bytes(media[8:10], "big") if media[:3] == b"ID3" else 0
    noise = bytes(random.Random(0).randrange(255) for _ in range(999))
    a = parse_mpeg(media[:start] + noise + media[start:] + noise)
    assert list(a.offsets) == [o + 999 for o in truth.offsets] and a.samples == truth.samples


def test_cut_off_and_damaged_streams():
    media, truth = carried(7, "word " * 500)
    assert parse_mpeg(media[:-10]).n_frames == len(truth.offsets) - 1
    hurt = bytearray(media)
    hurt[truth.offsets[3] + 3] ^= 0x10  # joint-stereo bits, which the checksum covers
    assert parse_mpeg(bytes(hurt)).bad_checksums == truth.bad + 1
    for junk in (b"", b"\xff", b"\xff" * 5000, b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", bytes(1000), b"TAG" + bytes(125), b"APETAGEX" + b"\xff" * 24):
        assert parse_mpeg(junk).n_frames == 0


def test_checksum_by_bits_and_by_rows():
    data = np.random.default_rng(0).integers(0, 256, (20, 34), dtype=np.uint8)
    assert list(crc16(data)) == [crc16_bits(r.tobytes(), 34 * 8) for r in data]
    # the polynomial's division, bit by bit
    reg = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in b"123456789"):
        top = reg >> 15 ^ int(bit)
        reg = (reg << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    assert crc16_bits(b"123456789", 72) == reg == 0xAEE7


def test_known_headers():
    h = parse_header(0xFFFB9064)
    assert (h.version, h.layer, h.crc, h.kbps, h.rate, h.size, h.samples, h.side) == (1, 3, False, 128, 44100, 417, 1152, 32)
    assert parse_header(0xFFFB9264).size == 418
    assert all(parse_header(w) is None for w in (0xFFFBF064, 0xFFFB0064, 0xFFE99064, 0xFFFB9C64, 0x00FB9064))


def test_encoder_delay_and_vbri():
    media, truth = carried(6, "word " * 3000)
    raw = bytearray(media)
    at = raw.index(b"Xing") + 120
    raw[at - 4 + 0 : at - 4 + 4] = raw[at - 4 : at]
    pos = raw.index(b"Xing") + 8 + 4 + 4 + 100
    raw[pos : pos + 4] = b"LAME"
    raw[pos + 21 : pos + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    a = parse_mpeg(bytes(raw))
    assert (a.encoder_delay, a.encoder_padding, a.samples) == (576, 1000, truth.samples - 1576)
    plain, t = carried(0, "word " * 300)
    plain = bytearray(plain)
    o = t.offsets[0]
    plain[o + 36 : o + 36 + 26 + 4] = b"VBRI" + bytes(6) + (1234).to_bytes(4, "big") + (9).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\0\5\0\7"
    v = parse_mpeg(bytes(plain))
    assert (v.table, v.table_bytes, v.table_frames, v.table_seek) == ("VBRI", 1234, 9, [15, 21]) and list(v.offsets) == t.offsets[1:]


def test_ape_tag():
    media, truth = carried(2, "word " * 300)
    item = (3).to_bytes(4, "little") + bytes(4) + b"Artist\0" + b"abc"
    foot = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    a = parse_mpeg(media + item + foot)
    assert a.tags == {"APE:Artist": "abc"} and a.n_frames == len(truth.offsets)


def test_rows(spark, odd, clashing):
    for df in (odd, clashing):
        rows = media_columns(as_media(df)).collect()
        assert len(rows) == len(ODD) and sum(r["n_frames"] is None for r in rows) == 2
        for r in rows:
            if r["n_frames"] is not None:
                assert len(r["frame_offsets"]) == r["n_frames"] > 0
    other = spark.createDataFrame([(1, bytearray(b""), 5), (None, None, 6), (2, bytearray(carried(2, "x")[0]), 7)], "track int, sound binary, media int")
    got = {r["track"]: r["n_frames"] for r in media_columns(other, "track", "sound").collect()}
    assert got == {1: 0, None: None, 2: 1}
    assert media_columns(as_media(spark.createDataFrame([], DOC))).count() == 0
    assert mpeg.SCHEMA.names[-1] == "frame_offsets"


# --- a reader of its own: tables typed from the standard, one byte at a time ---

KBPS = {  # version 1 layers I, II, III; version 2 layer I, layers II and III
    "V1L1": "32 64 96 128 160 192 224 256 288 320 352 384 416 448", "V1L2": "32 48 56 64 80 96 112 128 160 192 224 256 320 384", "V1L3": "32 40 48 56 64 80 96 112 128 160 192 224 256 320",
    "V2L1": "32 48 56 64 80 96 112 128 144 160 176 192 224 256", "V2L2": "8 16 24 32 40 48 56 64 80 96 112 128 144 160", "V2L3": "8 16 24 32 40 48 56 64 80 96 112 128 144 160",
}
HERTZ = {"11": "44100 48000 32000", "10": "22050 24000 16000", "00": "11025 12000 8000"}


def _naive_header(b):
    bits = "".join(f"{x:08b}" for x in b[:4])
    version, layer, rate, hertz = bits[11:13], bits[13:15], int(bits[16:20], 2), int(bits[20:22], 2)
    if bits[:11] != "1" * 11 or version == "01" or layer == "00" or rate in (0, 15) or hertz == 3:
        return None
    number = {"11": 1, "10": 2, "01": 3}[layer]
    kbps = int(KBPS[f"V{1 if version == '11' else 2}L{number}"].split()[rate - 1])
    hz = int(HERTZ[version].split()[hertz])
    samples = 384 if number == 1 else 576 if number == 3 and version != "11" else 1152
    pad = int(bits[22])
    size = (12 * kbps * 1000 // hz + pad) * 4 if number == 1 else samples * kbps * 125 // hz + pad
    return version, number, hz, samples, size, bits[15] == "0"


def test_headers_against_tables_from_the_standard():
    rng = random.Random(0)
    for _ in range(20_000):
        word = 0xFFE00000 | rng.getrandbits(21)
        h, want = parse_header(word), _naive_header(word.to_bytes(4, "big"))
        assert (h is None) == (want is None)
        if h:
            assert ({1: "11", 2: "10", 25: "00"}[h.version], h.layer, h.rate, h.samples, h.size, h.crc) == want


def test_streams_against_a_naive_scan():
    """Frames of random headers and bodies, alike in version, layer and rate, with stray bytes that hold no sync."""
    rng = random.Random(1)
    for _ in range(60):
        version, layer, hz = rng.choice(["11", "10", "00"]), rng.choice(["11", "10", "01"]), rng.randrange(3)
        data, offsets, samples, stray, cuts = b"", [], 0, 0, 0
        for i in range(rng.randrange(1, 30)):
            if i and rng.random() < 0.2:
                junk = bytes(rng.randrange(255) for _ in range(rng.randrange(1, 40)))
                data, stray, cuts = data + junk, stray + len(junk), cuts + 1
            bits = "1" * 11 + version + layer + "1" + f"{rng.randrange(1, 15):04b}{hz:02b}{rng.randrange(2)}0" + f"{rng.choice([0, 2, 3]):02b}" + "000000"
            head = int(bits, 2).to_bytes(4, "big")
            _, _, rate, each, size, _ = _naive_header(head)
            offsets.append(len(data))
            data += head + bytes(size - 4)
            samples += each
        a = parse_mpeg(data)
        # after stray bytes a frame counts if another follows at once
        ends = {o + _naive_header(data[o : o + 4])[4] for o in offsets}
        counted = [o for k, o in enumerate(offsets) if o in ends or k == 0 and (len(offsets) == 1 or offsets[1] in ends and offsets[1] == o + _naive_header(data[o : o + 4])[4]) or (o + _naive_header(data[o : o + 4])[4]) in (*offsets, len(data))]
        assert list(a.offsets) == counted
        assert a.duration_num * rate == len(counted) * each * a.duration_den


def test_a_stream_whose_sample_rate_changes():
    one, two = bytes.fromhex("fffb9064"), bytes.fromhex("fffb9464")  # 128 kbit/s at 44100 and at 48000 Hz
    data = (one + bytes(413)) * 3 + (two + bytes(380)) * 2
    a = parse_mpeg(data)
    assert (a.n_frames, a.sample_rate, a.samples) == (5, 44100, 5 * 1152)
    assert a.duration_num / a.duration_den == pytest.approx(3 * 1152 / 44100 + 2 * 1152 / 48000)


def test_a_frame_made_by_hand():
    """MPEG 1, layer III, checksum, 32 kbit/s, 48 kHz, mono: 96 bytes; side information 17 bytes; the checksum worked out bit by bit."""
    side = bytes(range(1, 18))
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in bytes([0x14, 0xC0]) + side):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    good = bytes([0xFF, 0xFA, 0x14, 0xC0]) + crc.to_bytes(2, "big") + side + bytes(96 - 23)
    bad = good[:5] + bytes([good[5] ^ 1]) + good[6:]
    a = parse_mpeg(good + bad + good)
    assert (a.n_frames, a.checked, a.bad_checksums, a.channels, list(a.offsets)) == (3, 3, 1, 1, [0, 96, 192])
