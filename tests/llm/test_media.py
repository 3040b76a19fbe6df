"""TIFF: round trips, foreign layouts, damage."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import tiff


def samples():
    rng = random.Random(2)
    yield b""
    yield b"a"
    yield b"\0" * 1000
    yield bytes(range(256)) * 40
    yield bytes(rng.randrange(256) for _ in range(9000))
    yield b"abcabcabd " * 3000
    for n in (1, 2, 3, 127, 128, 129, 130, 4096):
        yield bytes(rng.choice(b"ab") for _ in range(n))


@pytest.mark.parametrize("raw", list(samples()))
def test_codecs_round_trip(raw):
    assert tiff.unlzw(tiff.lzw(raw)) == raw
    assert tiff.unpackbits(tiff.packbits(raw), len(raw)) == raw if raw else True


def test_known_streams():
    # the example rows of the format's description
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpackbits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # codes 256 7 258 8 8 258 6 6 257 at nine bits
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.unlzw(int(bits.ljust(88, "0"), 2).to_bytes(11, "big")) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages(compression, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (h, w), dtype=np.uint8) // 9 for h, w in ((1, 1), (70, 33), (64, 96))]
    found = list(tiff.pages(tiff.write_tiff(images, compression, predictor, tile, rows_per_strip=7)))
    assert [np.array_equal(p[:, :, 0], i) for (p, _), i in zip(found, images)] == [True] * 3
    assert all(f["tiled"] == bool(tile) and f["compression"] == compression for _, f in found)


def test_big_endian_colour_and_damage():
    pixels = bytes(range(24))
    fields = [(256, 4), (257, 2), (259, 1), (273, 8), (277, 3), (278, 2), (279, 24)]
    at = 8 + 24
    out = b"MM" + struct.pack(">HI", 42, at) + pixels + struct.pack(">H", len(fields) + 1)
    rows = [(t, struct.pack(">HHII", t, 4, 1, v)) for t, v in fields] + [(258, struct.pack(">HHII", 258, 3, 3, at + 2 + 12 * 8 + 4))]
    out += b"".join(r for _, r in sorted(rows)) + struct.pack(">I", at) + struct.pack(">HHH", 8, 8, 8)
    found = list(tiff.pages(out))  # its chain returns to the first directory
    assert len(found) == 1 and found[0][0].tobytes() == pixels and found[0][1]["samples"] == 3
    for broken in (b"", b"II*\0", b"PNG.....", out[:40], out.replace(struct.pack(">HHII", 259, 4, 1, 1), struct.pack(">HHII", 259, 4, 1, 99))):
        assert list(tiff.pages(broken))[-1][0] is None


def test_page_rows(spark):
    good = tiff.write_tiff([np.zeros((2, 3), np.uint8), np.ones((1, 4), np.uint8)], tiff.LZW)
    df = spark.createDataFrame([(1, good, 5), (2, None, 5), (3, b"no", 5), (None, good[:30], 5)], "doc_id long, media binary, page int")
    got = Counter((r.doc_id, r.page, r.width, r.pixels is None, r.error is None) for r in tiff.tiff_pages(df).collect())
    assert got == Counter([(1, 0, 3, False, True), (1, 1, 4, False, True), (3, 0, None, True, False), (None, 0, None, True, False)])
    assert tiff.tiff_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["small", "edges", "nothing"])
def test_text_media(request, name):
    df = request.getfixturevalue(name)
    texts = Counter()
    for r in df.collect():
        raw = (r.text or "").encode()
        full = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        texts[(r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    got = tiff.text_media(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == texts
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_damaged_files_give_an_error_row():
    rng = random.Random(4)
    image = (np.arange(64 * 48) % 7).astype(np.uint8).reshape(64, 48)
    files = [tiff.write_tiff([image, image[:20]], c, p, t, rows_per_strip=9) for c in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (None, (16, 32))]
    for _ in range(20_000):
        raw = bytearray(rng.choice(files))
        first = struct.unpack_from("<I", raw, 4)[0]
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(first, len(raw))] = rng.choice((0, 255, rng.randrange(256)))
        for pixels, facts in tiff.pages(bytes(raw)):
            assert "error" in facts if pixels is None else pixels.size <= tiff.MOST_SAMPLES


@pytest.mark.parametrize("tag,tile", [(tiff.ROWS_PER_STRIP, None), (tiff.WIDTH, None), (tiff.HEIGHT, None), (tiff.TILE_WIDTH, (16, 32)), (tiff.TILE_HEIGHT, (16, 32))])
@pytest.mark.parametrize("value", [0, 1 << 31])
def test_sizes_that_cannot_be(tag, tile, value):
    raw = bytearray(tiff.write_tiff([np.full((40, 40), 7, np.uint8)], tiff.PLAIN, 1, tile))
    at = struct.unpack_from("<I", raw, 4)[0]
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        if struct.unpack_from("<H", raw, at + 2 + 12 * k)[0] == tag:
            struct.pack_into("<I", raw, at + 10 + 12 * k, value)
    found = list(tiff.pages(bytes(raw)))
    if tag == tiff.ROWS_PER_STRIP and value:
        assert (found[0][0] == 7).all()  # more rows than there are is one strip
    else:
        assert len(found) == 1 and found[0][0] is None and found[0][1]["error"]


def test_decoders_stop_at_the_size():
    assert tiff.unlzw(tiff.lzw(b"ab" * 90_000), 7) == b"abababa"
    image = np.zeros((4000, 4000), np.uint8)
    raw = tiff.write_tiff([image], tiff.DEFLATE, rows_per_strip=4000)
    assert next(tiff.pages(raw))[0].size == 16_000_000
