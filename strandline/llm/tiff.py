"""TIFF media columns: one row for each page of each file.

`pages` walks the chain of image directories, decodes strips or tiles (none, PackBits,
LZW, deflate), undoes the horizontal predictor and gives 8- or 16-bit samples back.
`encoded` writes such files. Baseline layout: one or more 8- or 16-bit samples a pixel,
interleaved, either byte order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import rows_by_python

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
# Fixed values of the format: tag numbers, and the size and struct letter of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}


class TiffError(ValueError):
    """The file breaks the format or uses a part of it that isn't decoded here."""


@dataclass(frozen=True)
class Page:
    number: int
    width: int
    height: int
    channels: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    samples: bytes


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits_encode(row: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(row)
    literal = 0
    while i < n:
        run = 1
        while i + run < n and run < 128 and row[i + run] == row[i]:
            run += 1
        if run >= 3 or i + run == n:
            for k in range(literal, i, 128):
                part = row[k : min(i, k + 128)]
                out.append(len(part) - 1)
                out += part
            out += bytes([257 - run if run > 1 else 0, row[i]])
            i += run
            literal = i
        else:
            i += run
    for k in range(literal, n, 128):
        part = row[k : k + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


CLEAR, END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, have, bits, last = 9, 0, 0, b""
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == END:
            break
        if not table:
            raise TiffError("LZW data doesn't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    following, width, held = 258, 9, b""
    put(CLEAR, width)
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held], width)
        table[longer] = following
        following += 1
        if following == 4094:
            put(CLEAR, 12)
            table = {bytes([k]): k for k in range(256)}
            following, width = 258, 9
        elif following > (1 << width) - 1:
            width += 1
        held = data[i : i + 1]
    if held:
        put(table[held], width)
        # the reader has added one more entry by then
        if following + 1 > (1 << width) - 1 and width < 12:
            width += 1
    put(END, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


#: Bytes that one byte of a file can stand for at most: the longest entry of an LZW table for a code of 12 bits.
MOST_EXPANDED = 3000


def decompress(data: bytes, compression: int, need: int) -> bytes:
    """`need` bytes or more of a strip or tile, or as many as there are."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, need))
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    raise TiffError(f"compression {compression}")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and fields of each image directory, along the chain; a chain that turns back on itself ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (count,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in TYPES:
                    size, letter = TYPES[kind]
                    place = at + 10 + 12 * i
                    if size * n > 4:
                        (place,) = struct.unpack_from(order + "I", data, place)
                    fields[tag] = struct.unpack_from(f"{order}{n}{letter}", data, place)
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        except struct.error as e:
            raise TiffError("truncated directory") from e
        yield order, fields
        at = following


def pages(data: bytes) -> Iterator[Page]:
    """Every page of a file, with decoded samples in row order."""
    for number, (order, f) in enumerate(directories(data)):
        try:
            width, height = f[WIDTH][0], f[LENGTH][0]
        except KeyError as e:
            raise TiffError("a directory without image size") from e
        channels, bits = f.get(SAMPLES, (1,))[0], f.get(BITS, (1,))[0]
        compression, predictor = f.get(COMPRESSION, (NONE,))[0], f.get(PREDICTOR, (1,))[0]
        if bits not in (8, 16) or f.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
            raise TiffError(f"{bits} bits, planar {f.get(PLANAR, (1,))[0]}, predictor {predictor}")
        if min(width, height, channels) < 1:
            raise TiffError(f"{width} by {height} pixels of {channels} samples")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        if width * height * channels * kind.itemsize > MOST_EXPANDED * len(data):
            raise TiffError("an image larger than its file can hold")
        tiled = TILE_OFFSETS in f
        if tiled:
            across, down = f[TILE_WIDTH][0], f[TILE_LENGTH][0]
            offsets, sizes = f[TILE_OFFSETS], f[TILE_BYTES]
        else:
            across, down = width, min(f.get(ROWS_PER_STRIP, (height,))[0], height) or 1
            offsets, sizes = f.get(STRIP_OFFSETS, ()), f.get(STRIP_BYTES, ())
        if min(across, down) < 1 or across * down * channels * kind.itemsize > MOST_EXPANDED * len(data):
            raise TiffError(f"strips or tiles of {across} by {down} pixels")
        image = np.zeros((height, width, channels), dtype=kind)
        per_row = -(-width // across)
        if len(offsets) != len(sizes) or len(offsets) < per_row * -(-height // down):
            raise TiffError("strips or tiles are missing")
        for i in range(per_row * -(-height // down)):
            top, left = i // per_row * down, i % per_row * across
            rows = down if tiled else min(down, height - top)
            need = rows * across * channels * kind.itemsize
            raw = decompress(data[offsets[i] : offsets[i] + sizes[i]], compression, need)
            if len(raw) < need:
                raise TiffError("a strip or tile is too short")
            block = np.frombuffer(raw, dtype=kind, count=rows * across * channels).reshape(rows, across, channels)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            high, wide = min(rows, height - top), min(across, width - left)
            image[top : top + high, left : left + wide] = block[:high, :wide]
        yield Page(number, width, height, channels, bits, NAMES[compression], predictor, tiled, image.tobytes())


def encoded(
    images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 1024, tile: int | None = None, order: str = "<"
) -> bytes:
    """A TIFF file of 8-bit images (height x width [x channels]), one page each, in strips of `rows` rows or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, channels = image.shape
        down, across = (tile, tile) if tile else (rows, width)
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = image[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                raw = block.tobytes()
                if compression in (DEFLATE, OLD_DEFLATE):
                    raw = zlib.compress(raw, 6)
                elif compression == PACKBITS:
                    step = block.shape[1] * channels
                    raw = b"".join(packbits_encode(raw[k : k + step]) for k in range(0, len(raw), step))
                elif compression == LZW:
                    raw = lzw_encode(raw)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * channels), (COMPRESSION, 3, [compression])]
        fields += [(PHOTOMETRIC, 3, [1 if channels < 3 else 2]), (SAMPLES, 3, [channels]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind][1]}", *values)
            if len(packed) > 4:
                packed, at = struct.pack(order + "I", len(out)), packed
                out += at + b"\0" * (len(at) % 2)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Samples in a row of a page that holds plain bytes.
ROW = 64


def stored_bytes(payload: bytes) -> bytes:
    """Bytes as a page of 8-bit samples, ROW across; the payload is a positive multiple of ROW long."""
    return encoded([np.frombuffer(payload, np.uint8).reshape(-1, ROW)])


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def store_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A media table of texts: (id, n_bytes, media). A null text is stored as an empty one."""

    def rows(key, value):
        raw = (value or "").encode()
        yield key, len(raw), stored_bytes(padded(raw))

    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, n_bytes long, media binary"
    return rows_by_python(df, [id_column, text], schema, rows, weigh=2)


PAGE_FIELDS = (
    "page int, width int, height int, channels int, bits int, compression string, predictor int, tiled boolean, "
    "samples binary, feature string, error string"
)


def feature_of(page: Page) -> str:
    """Mean, deviation and entropy of the samples and the mean step between neighbours in a row."""
    values = np.frombuffer(page.samples, np.uint8)
    shares = np.bincount(values, minlength=256) / max(1, len(values))
    levels = np.arange(256)
    mean = float(shares @ levels)
    deviation = float(np.sqrt(max(0.0, shares @ (levels * levels) - mean * mean)))
    some = shares[shares > 0]
    entropy = float(-(some * np.log2(some)).sum()) + 0.0
    grid = values.reshape(max(1, page.height), -1).astype(np.int16)
    step = float(np.abs(np.diff(grid, axis=1)).mean()) if grid.shape[1] > 1 else 0.0
    return f"{mean:.4f},{deviation:.4f},{entropy:.4f},{step:.4f}"


def page_rows(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each file in the binary column `media`, beside the columns `keep` of its row.

    A null or empty file has no pages. A file that can't be decoded gives the pages before the
    fault and then one row with `error` set and no samples. Columns of `keep` that clash with a
    page's field are refused. A page is held whole by one worker, and is no larger than MOST_EXPANDED times its file.
    """
    keep = [c for c in df.columns if c != media] if keep is None else keep
    fields = [x.split()[0] for x in PAGE_FIELDS.split(", ")]
    if clash := {c.lower() for c in keep} & set(fields):
        raise ValueError(f"columns named like fields of a page: {sorted(clash)}")

    def rows(data, *kept):
        number = -1
        try:
            for p in pages(data) if data else ():
                number = p.number
                yield (*kept, p.number, p.width, p.height, p.channels, p.bits, p.compression, p.predictor, p.tiled, p.samples, feature_of(p), None)
        except (ValueError, ArithmeticError, LookupError, struct.error, zlib.error) as e:
            yield (*kept, number + 1, *[None] * 9, str(e) or type(e).__name__)

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), PAGE_FIELDS])
    return rows_by_python(df, [media, *keep], schema, rows, weigh=len(keep) + 8)


def text_media(documents: DataFrame) -> DataFrame:
    """Whole texts stored as TIFF pages and read back: digests of the stored form and of what comes out of it.

    The media table is written out of the row stream and decoded by `page_rows`; texts share one page each,
    so a document's row never has to be put together from several.
    """
    stored = store_texts(documents)
    read = page_rows(stored.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256)))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "compression",
    )
