"""Rasters by ranges: what is read, and what comes out."""

from __future__ import annotations

import io
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidalframe.plans import registry
from tidalframe.sinks import rasters
from tidalframe.sources import geotiff, raster_blocks

POINTS = "id long, x double, y double, raster string, depth string"
RANKS = "raster string, priority int, depth_positive boolean"


class Counting(io.BytesIO):
    """A file that notes which bytes were read."""

    def __init__(self, data):
        super().__init__(data)
        self.spans = []

    def read(self, n=-1):
        at = self.tell()
        out = super().read(n)
        self.spans.append((at, at + len(out)))
        return out

    def close(self):
        pass


def picture(height=100, width=70):
    y, x = np.mgrid[:height, :width]
    return (x + 1000.0 * y).astype("f4")


def written(tmp_path, name, values, gt=(0.0, 1.0, 0.0, 0.0, 0.0, -1.0), nodata=-9999.0, tile=16):
    (tmp_path / name).write_bytes(rasters.encoded(values, gt, nodata, tile))
    return str(tmp_path / name)


@pytest.mark.parametrize("tile", [None, 16, 32])
def test_every_pixel_comes_back(spark, tmp_path, tile):
    values = picture()
    written(tmp_path, "a.tif", values, tile=tile)
    got = {(r.px, r.py): r.val for r in geotiff.read_pixels(spark, str(tmp_path / "*.tif")).collect()}
    assert got == {(x, y): values[y, x] for y in range(100) for x in range(70)}


def test_one_tile_costs_its_bytes_only(spark, tmp_path):
    rng = np.random.default_rng(1)
    path = written(tmp_path, "a.tif", rng.normal(size=(640, 640)).astype("f4"), tile=64)
    index = raster_blocks.block_index(spark, path)
    assert index.count() == 100
    chosen = raster_blocks.in_window(index, 130, 70, 140, 100)
    (row,) = chosen.collect()
    assert (row.left, row.top, row.cols, row.rows, row.block) == (128, 64, 64, 64, 12)
    data = open(path, "rb").read()
    file = Counting(data)
    batch = pa.RecordBatch.from_pylist([row.asDict()])
    assert sum(b.num_rows for b in raster_blocks._pixels(iter([batch]), lambda _: file)) == 4096
    assert file.spans == [(row["at"], row["at"] + row["size"])]
    assert row["size"] < len(data) / 50
    told = raster_blocks.loading(index, chosen).first()
    assert (told.blocks, told.blocks_read, told.bytes_read) == (100, 1, row["size"])
    keep = bytearray(os.urandom(len(data)))  # all but the header and the tile is rubbish
    first = min(r["at"] for r in index.collect())
    last = max(r["at"] + r["size"] for r in index.collect())
    keep[:first], keep[last:] = data[:first], data[last:]
    keep[row["at"] : row["at"] + row["size"]] = data[row["at"] : row["at"] + row["size"]]
    (tmp_path / "b.tif").write_bytes(bytes(keep))
    got = raster_blocks.read_blocks(raster_blocks.in_window(raster_blocks.block_index(spark, str(tmp_path / "b.tif")), 130, 70, 140, 100)).agg(F.sum(F.col("val").cast("double"))).first()[0]
    want = raster_blocks.read_blocks(chosen).agg(F.sum(F.col("val").cast("double"))).first()[0]
    assert got == want


def test_headers_are_read_by_pages(tmp_path):
    data = rasters.encoded(np.random.default_rng(2).normal(size=(2000, 500)).astype("f4"), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), None, 128)
    file = Counting(data)
    view = raster_blocks.Ranged(file)
    head = geotiff.header(view)
    assert head["width"] == (500,) and len(head["tile_offsets"]) == 64 and view.taken <= 3 * raster_blocks.PAGE < len(data) / 50


def test_samples_take_the_first_raster_and_its_gaps(spark, tmp_path):
    one, two = np.full((20, 20), 5.0, "f4"), np.full((40, 40), -7.0, "f4")
    one[3, 3] = -9999.0
    two[0, 0] = 3.0
    a = written(tmp_path, "a.tif", one, (100.0, 1.0, 0.0, 200.0, 0.0, -1.0))
    b = written(tmp_path, "b.tif", two, (90.0, 1.0, 0.0, 210.0, 0.0, -1.0))
    index = raster_blocks.block_index(spark, str(tmp_path / "*.tif"))
    name = {r.raster: r.raster[-5:] for r in index.select("raster").distinct().collect()}
    ranks = spark.createDataFrame([(r, 0 if n == "a.tif" else 1, n == "a.tif") for r, n in name.items()], RANKS)
    at = [(1, 110.5, 190.5), (2, 102.5, 197.5), (3, 95.0, 205.0), (4, 90.0, 210.0), (5, 0.0, 0.0), (6, 119.5, 190.5), (7, 129.9, 175.0), (8, None, 1.0)]
    points = spark.createDataFrame([(i, x, y, "r", "d") for i, x, y in at], POINTS)
    got = {r.id: (name.get(r.raster), r.depth) for r in raster_blocks.sample(points, index, ranks, ("id",)).collect()}
    assert got == {1: ("a.tif", 5.0), 2: ("a.tif", 0.0), 3: ("b.tif", 7.0), 4: ("b.tif", 0.0), 5: (None, None), 6: ("a.tif", 0.0), 7: ("b.tif", 0.0), 8: (None, None)}
    assert a != b
    assert raster_blocks.sample(points.where("id > 99"), index, ranks, ("id",)).collect() == []


def test_bilinear_weights(spark, tmp_path):
    written(tmp_path, "a.tif", picture(), (0.0, 2.0, 0.0, 0.0, 0.0, -4.0))
    index = raster_blocks.block_index(spark, str(tmp_path / "a.tif"))
    ranks = index.select("raster").distinct().selectExpr("raster", "1 AS priority", "true AS depth_positive")
    at = [(k, 0.37 * k, -2.9 * k) for k in range(120)]
    got = {r.id: r.depth for r in raster_blocks.sample(spark.createDataFrame([(*p, "", "") for p in at], POINTS), index, ranks, ("id",)).collect()}
    assert all(abs(got[k] - (x / 2 + 1000 * (-y / 4))) <= 1e-6 * max(1.0, abs(got[k])) for k, x, y in at)


def test_headers_tell_rasters_with_missing_pixels(spark, tmp_path):
    full = [(k, n, float(1000 + k + n)) for k in range(120) for n in range(70)]
    spark.createDataFrame([r for r in full if r[0] % 3 == 0 or r[:2] != (4, 33)], "o_custkey long, o_orderkey long, o_totalprice double").where("o_custkey % 3 < 2").toPandas().to_parquet(tmp_path / "orders.parquet")
    got, want = same(registry.QUERIES["raster_headers"](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLE_SQL["raster_headers"])
    frame = registry.QUERIES["raster_headers"](spark, str(tmp_path))
    assert {r.raster: r.gaps for r in frame.where("raster < 'r2'").collect()} == {"r0": None, "r1": True}
    assert [r for r in got if "r2" not in r] == want
