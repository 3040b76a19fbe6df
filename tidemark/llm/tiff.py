"""TIFF media columns: a writer of 8-bit grey pages, and a reader that gives one row per page.

The reader walks the chain of image directories in either byte order and decodes strips and tiles that are stored
plain, with PackBits, LZW or deflate, and undoes horizontal differencing.  A quarter of the payloads of
:func:`text_media` is stored with LZW, three eighths with deflate, a quarter with PackBits, the rest plain.  Defined cases: null or empty media has no
pages; what cannot be decoded gives one last row with null pixels and the reason; a chain that returns to a directory
it has been at ends there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_of

#: Fixed values of the format: compression codes, tags, sizes of the field types.
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 284
ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 278, 279, 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i"}
CLEAR, END = 256, 257


def packbits(raw: bytes) -> bytes:
    """One row: runs of three and more become two bytes, the rest literals of at most 128."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    bounds = np.concatenate(([0], edges, [len(codes)]))
    long = np.flatnonzero(np.diff(bounds) >= 3)
    out, at = [], 0
    for begin, end in [*zip(bounds[long].tolist(), bounds[long + 1].tolist()), (len(raw), len(raw))]:
        while at < begin:
            part = raw[at : min(begin, at + 128)]
            out += (bytes((len(part) - 1,)), part)
            at += len(part)
        while at < end:
            n = min(128, end - at)
            out.append(bytes((257 - n if n > 1 else 0, raw[at])))
            at += n
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
            have += n + 1
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
                have += 257 - n
            at += 2 if n > 128 else 1
    return b"".join(out)


def lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early, as the format has it."""
    out, held, bits = bytearray(), CLEAR, 9
    single = {bytes((k,)): k for k in range(256)}
    known, width, n = dict(single), 9, 258
    prefix = b""
    for k in range(len(raw)):
        longer = prefix + raw[k : k + 1]
        if longer in known:
            prefix = longer
            continue
        held = held << width | known[prefix]
        bits += width
        known[longer] = n
        n += 1
        if n == 4094:
            held = held << width | CLEAR
            bits += width
            known, width, n = dict(single), 9, 258
        elif n > (1 << width) - 1:
            width += 1
        if bits > 512:
            out += (held >> (bits % 8)).to_bytes(bits // 8, "big")
            held &= (1 << bits % 8) - 1
            bits %= 8
        prefix = raw[k : k + 1]
    if prefix:
        held, bits, n = held << width | known[prefix], bits + width, n + 1
        if n > (1 << width) - 1 and width < 12:
            width += 1
    held, bits = held << width | END, bits + width
    rest = -bits % 8
    return bytes(out) + (held << rest).to_bytes((bits + rest) // 8, "big")


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """The bytes of an LZW stream, decoding no further than ``most`` of them."""
    out, held, bits, at, size = [], 0, 0, 0, 0
    single = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, last = list(single), 9, b""
    while True:
        while bits < width:
            part = data[at : at + 32]
            if not part:
                return b"".join(out)
            held, bits, at = held << 8 * len(part) | int.from_bytes(part, "big"), bits + 8 * len(part), at + len(part)
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, width, last = list(single), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code is out of range")
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            return b"".join(out)[:most]
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


def _packed(block: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:
        return b"".join(packbits(row.tobytes()) for row in block)
    raw = block.tobytes()
    return zlib.compress(raw, 4) if compression == DEFLATE else lzw(raw) if compression == LZW else raw


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64) -> bytes:
    """Little-endian file of 8-bit grey pages (height x width)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width = page.shape
        if tile:
            th, tw = tile
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            full[:height, :width] = page
            blocks = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        if predictor == 2:
            blocks = [np.concatenate((b[:, :1], np.diff(b, axis=1)), 1) for b in blocks]
        parts = [_packed(np.ascontiguousarray(b), compression) for b in blocks]
        places = []
        for part in parts:
            places.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, [tile[1]]), (TILE_HEIGHT, [tile[0]]), (TILE_OFFSETS, places), (TILE_COUNTS, [len(p) for p in parts])]
        else:
            fields += [(STRIP_OFFSETS, places), (ROWS_PER_STRIP, [rows_per_strip]), (STRIP_COUNTS, [len(p) for p in parts])]
        entries = b""
        for tag, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = TYPES.get(kind)
        if not code:
            continue
        form = f"{order}{many}{code}" if len(code) == 1 else f"{order}{many * 2}I"
        size = struct.calcsize(form)
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        fields[tag] = struct.unpack_from(form, data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


#: Most samples of a page, and of one of its strips or tiles, that are read: what a header says is allocated only below it.
MOST_SAMPLES = 1 << 27


def _page(data: bytes, fields: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    one = lambda tag, default=None: fields[tag][0] if tag in fields else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if set(fields.get(BITS, (1,))) != {8}:
        raise ValueError("only samples of 8 bits are read")
    if samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError("samples in planes of their own are not read")
    tiled = TILE_OFFSETS in fields
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if min(width, height, samples, bh, bw) < 1:
        raise ValueError("a size is zero")
    if max(height * width, bh * bw) * samples > MOST_SAMPLES:
        raise ValueError(f"a page has over {MOST_SAMPLES} samples")
    across, down = -(-width // bw), -(-height // bh)
    offsets, counts = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], fields[TILE_COUNTS if tiled else STRIP_COUNTS]
    if min(len(offsets), len(counts)) < across * down:
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), np.uint8)
    for k, (at, n) in enumerate(zip(offsets[: across * down], counts)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        part, size = data[at : at + n], rows * bw * samples
        if compression == PACKBITS:
            part = unpackbits(part, size)
        elif compression == LZW:
            part = unlzw(part, size)
        elif compression in (DEFLATE, OLD_DEFLATE):
            part = zlib.decompressobj().decompress(part, size)
        elif compression != PLAIN:
            raise ValueError(f"compression {compression} is not read")
        block = np.frombuffer(part, np.uint8, size).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, 1, np.uint8)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not read")
        out[y : y + rows, x : x + bw] = block[: height - y, : width - x]
    return out, {"width": width, "height": height, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled}


def pages(data: bytes) -> Iterator[tuple[np.ndarray | None, dict]]:
    """(pixels, facts) of each page; at damage, one last (None, {"error": reason})."""
    try:
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        order = "<" if data[:2] == b"II" else ">"
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF file")
        seen = set()
        while at and at not in seen:
            seen.add(at)
            fields, at = _fields(data, at, order)
            yield _page(data, fields)
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, OverflowError, MemoryError) as e:
        yield None, {"error": str(e) or type(e).__name__}


PAGE = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each page of each file: the id, the page's facts and its samples, row by row."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in PAGE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ident, media in zip(batch.column(0), batch.column(1)):
                rows = []
                for n, (pixels, facts) in enumerate(pages(media.as_py()) if media.as_py() else ()):
                    rows.append([n, *(facts.get(c) for c in names[2:8]), None if pixels is None else pixels.tobytes(), facts.get("error")])
                if rows:
                    kinds = (*[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(rows), batch.schema.types[0]), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return df.select(f"`{id_col}`", f"`{media_col}`").mapInArrow(run, f"`{id_col}` {kind}, {PAGE}")


ROW, UNIT, PAGE_UNITS = 96, 576, 256


#: The forms that payloads are stored in, dealt out evenly by a digest of the payload.
FORMS = ({"compression": LZW}, {"compression": LZW, "predictor": 2}, {"compression": DEFLATE, "predictor": 2}, {"compression": DEFLATE, "tile": (16, 32)},
         {"compression": DEFLATE, "predictor": 2, "tile": (32, 96)}, {"compression": PACKBITS}, {"compression": PACKBITS, "tile": (32, 48)}, {"compression": PLAIN})


def _store(payload: bytes) -> bytes:
    """The payload as rows of 96 samples on pages of at most 147,456; the form follows from the payload's content."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    step = PAGE_UNITS * UNIT // ROW
    return write_tiff([grid[k : k + step] for k in range(0, len(grid), step)], **FORMS[zlib.crc32(payload) % len(FORMS)])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a TIFF file, read back, with digests and features of what was read."""

    def run(batches: Iterator[pa.RecordBatch]):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().encode("utf-8", "replace")
                media = _store(raw + b"\xff" * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT))
                read = list(pages(media))
                back = b"".join(p.tobytes() for p, _ in read)
                hist = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                mean, facts = float(hist @ np.arange(256)) / len(back), read[0][1]
                feature = f"pages={len(read)};compression={facts['compression']};predictor={facts['predictor']};tiled={int(facts['tiled'])};mean={mean:.3f};levels={int((hist > 0).sum())}"
                rows.append((ident, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
