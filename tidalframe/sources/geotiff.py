"""Raster files as pixel tables: the first band of strips or tiles, of little or big endian.

Blocks may be plain, deflated, packed or LZW-coded, with or without a predictor. This module knows the format; ``raster_blocks`` reads
files by ranges, a task some blocks, so neither the driver nor a task holds a raster. Other codings raise.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag numbers and type sizes of the file format.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "rows", 279: "counts", 284: "planes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "format", 33550: "scale", 33922: "tie", 34264: "matrix", 42113: "nodata"}
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
DEFAULT_TRANSFORM = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def header(data: bytes) -> dict:
    """The tags of the first image, by name, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out: dict = {"order": order}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if tag not in TAGS or kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            place = struct.unpack(order + "I", data[place : place + 4])[0]
        raw = data[place : place + size * count]
        out[TAGS[tag]] = raw.rstrip(b"\0 ").decode("ascii") if kind == 2 else struct.unpack(order + code * count if len(code) == 1 else order + code * count, raw)
    if out.get("compression", (1,))[0] not in DECODERS or out.get("predictor", (1,))[0] not in (1, 2, 3):
        raise ValueError(f"compression {out.get('compression')} with predictor {out.get('predictor')} is not read")
    return out


def unpacked(raw: bytes) -> bytes:
    """PackBits: runs of literal bytes and of repeats."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, last = list(first), 9, 0, 0, b""
    out = bytearray()
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


#: Decoders by the format's number of the compression.
DECODERS = {1: bytes, 5: unlzw, 8: zlib.decompress, 32773: unpacked, 32946: zlib.decompress}


def transform(head: dict) -> tuple[float, ...]:
    """The six terms from pixel to world."""
    if "matrix" in head:
        m = head["matrix"]
        return (m[3], m[0], m[1], m[7], m[4], m[5])
    if "scale" in head and "tie" in head:
        i, j, _, x, y, _ = head["tie"][:6]
        sx, sy = head["scale"][:2]
        return (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    return DEFAULT_TRANSFORM


def block(raw: bytes, head: dict, rows: int, width: int) -> np.ndarray:
    """The first band of one strip or tile."""
    kind = np.dtype(head["order"] + KINDS[(head.get("format", (1,))[0], head["bits"][0])])
    bands = 1 if head.get("planes", (1,))[0] == 2 else head.get("bands", (1,))[0]
    raw = DECODERS[head.get("compression", (1,))[0]](raw)
    predictor = head.get("predictor", (1,))[0]
    if predictor == 3:  # bytes of the values by significance, each the difference to the one before
        size = kind.itemsize
        planes = np.frombuffer(raw, np.uint8, rows * width * bands * size).reshape(rows, size, width * bands)
        whole = np.cumsum(planes.reshape(rows, size * width * bands // bands, bands), axis=1, dtype=np.uint8).reshape(rows, size, width * bands)
        values = np.ascontiguousarray(whole.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, bands)
    else:
        values = np.frombuffer(raw, dtype=kind, count=rows * width * bands).reshape(rows, width, bands)
        if predictor == 2:
            values = np.cumsum(values.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return values[:, :, 0]


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(raster, px, py, val) of all files under a path or glob."""
    from tidalframe.sources import raster_blocks

    return raster_blocks.read_blocks(raster_blocks.block_index(spark, path)).drop("block")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: size, transform, missing value and bounds; only its header is read."""
    from tidalframe.sources import raster_blocks

    return raster_blocks.rasters_of(raster_blocks.block_index(spark, path)).select("raster", "sx", "sy", "gt", "nodata", "xmin", "xmax", "ymin", "ymax")


def depth_sign(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """(raster, depth_positive): whether a raster holds depths, as nothing in it is negative."""
    found = pixels.join(headers.select("raster", "nodata"), "raster").where(F.col("nodata").isNull() | (F.abs(F.col("val") - F.col("nodata")) > 1e-6))
    return found.groupBy("raster").agg(((F.min("val") >= 0) & (F.max("val") > 0)).alias("depth_positive"))
