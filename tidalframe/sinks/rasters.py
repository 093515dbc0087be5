"""Rasters written by the executors: a deflated single-band file of strips or tiles for each raster."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.sinks.grids import put

#: Rows of a strip, and most pixels of one raster, which a task holds as a whole.
STRIP, MOST_PIXELS = 64, 1 << 28


def _tiles(values: np.ndarray, side: int) -> list[np.ndarray]:
    """Square tiles by rows, those at the far edges filled up with their last pixels."""
    height, width = (-(-n // side) * side for n in values.shape)
    whole = np.pad(values, ((0, height - values.shape[0]), (0, width - values.shape[1])), mode="edge")
    return [whole[y : y + side, x : x + side] for y in range(0, height, side) for x in range(0, width, side)]


def encoded(values: np.ndarray, transform: tuple[float, ...], nodata: float | None, tile: int | None = None) -> bytes:
    """A file of single-precision values in strips, or in square tiles, with its transform and missing value."""
    height, width = values.shape
    pieces = _tiles(values, tile) if tile else [values[k : k + STRIP] for k in range(0, height, STRIP)]
    strips = [zlib.compress(np.ascontiguousarray(p, dtype="<f4").tobytes()) for p in pieces]
    body, offsets = b"", []
    for strip in strips:
        offsets.append(8 + len(body))
        body += strip
    body += b"\0" * (len(body) % 2)
    x0, dx, rx, y0, ry, dy = transform
    sizes = [len(s) for s in strips]
    cut = [(322, "I", [tile]), (323, "I", [tile]), (324, "I", offsets), (325, "I", sizes)] if tile else [(273, "I", offsets), (278, "I", [STRIP]), (279, "I", sizes)]
    tags = sorted([
        (256, "I", [width]), (257, "I", [height]), (258, "H", [32]), (259, "H", [8]), (262, "H", [1]), (277, "H", [1]), *cut,
        (339, "H", [3]), (34264, "d", [dx, rx, 0.0, x0, ry, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
    ], key=lambda t: t[0])
    if nodata is not None:
        tags.append((42113, "s", [f"{nodata:g}".encode() + b"\0"]))
    at = 8 + len(body)
    start, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, data in tags:
        raw = data[0] if code == "s" else struct.pack("<" + code * len(data), *data)
        count = len(raw) if code == "s" else len(data)
        head = struct.pack("<HHI", tag, {"s": 2, "H": 3, "I": 4, "d": 12}[code], count)
        if len(raw) > 4:
            entries += head + struct.pack("<I", start + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += head + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def write_rasters(pixels: DataFrame, headers: DataFrame, folder: str, tile: int | None = None) -> int:
    """Write ``pixels`` (raster, px, py, val) as a file each, named by the raster; the number of files.

    ``headers``: raster, sx, sy, gt, nodata. Pixels without a row hold the missing value.
    """

    def write(key: tuple, cells: pa.Table, head: pa.Table) -> pa.Table:
        h = head.to_pylist()[0] if head.num_rows else None
        if h is None:
            return pa.table({"files": pa.array([], pa.int64())})
        if h["sx"] * h["sy"] > MOST_PIXELS:
            raise ValueError(f"{h['sx']} x {h['sy']} pixels; one raster has at most {MOST_PIXELS}")
        grid = np.full((h["sy"], h["sx"]), np.nan if h["nodata"] is None else h["nodata"], dtype="<f4")
        grid[cells.column("py").to_numpy(), cells.column("px").to_numpy()] = cells.column("val").to_numpy()
        put(f"{folder}/{key[0].as_py()}.tif", encoded(grid, tuple(h["gt"]), h["nodata"], tile))
        return pa.table({"files": pa.array([1], pa.int64())})

    rows = pixels.select("raster", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("val").cast("float").alias("val"))
    heads = headers.select("raster", "sx", "sy", "gt", F.col("nodata").cast("double").alias("nodata"))
    return rows.groupBy("raster").cogroup(heads.groupBy("raster")).applyInArrow(write, "files long").count()
