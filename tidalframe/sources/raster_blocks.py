"""Large rasters read by byte ranges: an index of strips and tiles first, then only the blocks that are asked for.

Spark lists the files without their contents. A task opens each of its files, reads its header by ranges and emits a row for each
block: where its bytes lie and which pixels it holds. Windows and joins on that table choose blocks, as partition pruning would; the chosen
ones are dealt out evenly and each task reads and decodes the byte ranges of its blocks alone. A raster of any size is thus read by
as many tasks as it has blocks, and a block that nothing asks for is never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators import spatial
from tidalframe.sources import geotiff

INDEX = "raster string, block int, at bigint, size bigint, left int, top int, cols int, rows int, wide int, high int, sx int, sy int, gt array<double>, nodata double, head string"
#: Bytes read at once where headers are looked up, and bytes of blocks in a task.
PAGE, TASK_BYTES = 1 << 14, 32 << 20
#: What a block needs of its header to be decoded.
CODING = ("order", "bits", "compression", "bands", "planes", "predictor", "format")


class Ranged:
    """A file as a sequence of bytes that are read when asked for, in pages; ``taken`` counts them."""

    def __init__(self, file, page: int = PAGE):
        self.file, self.page, self.held, self.taken = file, page, (0, b""), 0

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, part.stop
        first, data = self.held
        if not first <= start <= stop <= first + len(data):
            self.file.seek(start)
            data = self.file.read(max(stop - start, self.page))
            self.taken += len(data)
            first, self.held = start, (start, data)
        return data[start - first : stop - first]


def opened(path: str):
    """A file to read from, local or of a remote store."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return files.open_input_file(name)


def layout(head: dict) -> tuple[int, int, Sequence[int], Sequence[int]]:
    """Width and height of the blocks of the first band, and their places and sizes."""
    width, height = head["width"][0], head["height"][0]
    wide, high = (head["tile_width"][0], head["tile_height"][0]) if "tile_width" in head else (width, min(head.get("rows", (height,))[0], height))
    count = -(-width // wide) * -(-height // high)
    names = ("tile_offsets", "tile_counts") if "tile_width" in head else ("offsets", "counts")
    return wide, high, head[names[0]][:count], head[names[1]][:count]


def blocks_of(path: str, head: dict) -> Iterator[pa.RecordBatch]:
    """The rows of the index for one file."""
    wide, high, at, size = layout(head)
    width, height = head["width"][0], head["height"][0]
    coding = json.dumps({k: head[k] for k in CODING if k in head} | {"tiled": "tile_width" in head})
    nodata = float(head["nodata"]) if head.get("nodata") else None
    across = -(-width // wide)
    names = [x.split()[0] for x in INDEX.split(", ")]
    for lo in range(0, len(at), 1 << 14):
        k = np.arange(lo, min(lo + (1 << 14), len(at)), dtype=np.int32)
        left, top = k % across * wide, k // across * high
        n = len(k)
        same = lambda value, kind: pa.array([value] * n, kind)  # noqa: B023, E731
        columns = [same(path, pa.string()), pa.array(k), pa.array(at[lo : lo + n], pa.int64()), pa.array(size[lo : lo + n], pa.int64()), pa.array(left), pa.array(top), pa.array(np.minimum(wide, width - left).astype(np.int32)), pa.array(np.minimum(high, height - top).astype(np.int32))]
        columns += [same(x, pa.int32()) for x in (wide, high, width, height)] + [same(list(map(float, geotiff.transform(head))), pa.list_(pa.float64())), same(nodata, pa.float64()), same(coding, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for path in part.column("path").to_pylist():
            with opened(path) as file:
                head = geotiff.header(Ranged(file))
            yield from blocks_of(path, head)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block of all rasters under a path or glob; no pixel is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.repartition("path").mapInArrow(_index, INDEX)


def in_window(index: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The blocks that hold pixels of columns x0 to x1 and rows y0 to y1, both included."""
    return index.where((F.col("left") <= x1) & (F.col("left") + F.col("cols") > x0) & (F.col("top") <= y1) & (F.col("top") + F.col("rows") > y0))


def decoded(raw: bytes, row: dict) -> np.ndarray:
    """The pixels of one block, cut to the image; tiles are stored whole, the last strip is not."""
    head = json.loads(row["head"])
    return geotiff.block(raw, head, row["high"] if head["tiled"] else row["rows"], row["wide"])[: row["rows"], : row["cols"]]


def _pixels(batches: Iterator[pa.RecordBatch], open_file=opened) -> Iterator[pa.RecordBatch]:
    for part in batches:
        held, file = None, None
        for row in part.to_pylist():
            if row["raster"] != held:
                if file is not None:
                    file.close()
                held, file = row["raster"], open_file(row["raster"])
            file.seek(row["at"])
            values = decoded(file.read(row["size"]), row)
            py, px = np.divmod(np.arange(values.size, dtype=np.int32), values.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([held] * values.size), pa.array(np.full(values.size, row["block"], dtype=np.int32)), pa.array((px + row["left"]).astype(np.int32)), pa.array((py + row["top"]).astype(np.int32)), pa.array(np.ascontiguousarray(values).ravel().astype(np.float32))], names=["raster", "block", "px", "py", "val"])
        if file is not None:
            file.close()


def read_blocks(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """(raster, block, px, py, val) of the blocks of ``index``: their bytes alone are read, ``TASK_BYTES`` or so a task."""
    spark = index.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = index.repartition(tasks, "raster", F.floor(F.col("at") / TASK_BYTES)).sortWithinPartitions("raster", "at")  # neighbours in a file stay together
    return dealt.mapInArrow(_pixels, "raster string, block int, px int, py int, val float")


def rasters_of(index: DataFrame) -> DataFrame:
    """One row for each raster: size, blocks, transform and bounds of its corners."""
    first = index.where("block = 0").select("raster", "wide", "high", "sx", "sy", "gt", "nodata")
    g = lambda k: F.col("gt")[k]
    corner = lambda o, i, j: g(o) + i * F.col("sx") * g(o + 1) + j * F.col("sy") * g(o + 2)
    ends = {f"{n}{e}": of(*[corner(o, i, j) for i in (0, 1) for j in (0, 1)]) for o, n in ((0, "x"), (3, "y")) for e, of in (("min", F.least), ("max", F.greatest))}
    return first.withColumns(ends)


def sample(points: DataFrame, index: DataFrame, ranks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Points (``key``, x, y) with ``raster``, the one of least ``priority`` (``ranks``: raster, priority, depth_positive) whose closed bounds hold
    the point, and ``depth``, positive downward: bilinear between four pixels, 0 where one is missing or land; null outside of all rasters.

    Only the blocks in which some point has a corner are read. The raster is chosen before its values are looked at, so a missing value
    hides rasters of later rank.
    """
    key = list(key)
    tiles = rasters_of(index).join(ranks.select("raster", "priority", "depth_positive"), "raster")
    boxes = tiles.select(F.col("raster").alias("tile"), "priority", "xmin", "xmax", "ymin", "ymax")
    width = boxes.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0]
    found = spatial.first_tile(points, boxes, key, float(width) if width else 1.0)
    at = points.join(found.where("tile IS NOT NULL"), key).join(tiles.withColumnRenamed("raster", "tile"), "tile")
    g = lambda k: F.col("gt")[k]
    det = g(1) * g(5) - g(2) * g(4)
    dx, dy = F.col("x") - g(0), F.col("y") - g(3)
    at = at.withColumns({"px": (dx * g(5) - dy * g(2)) / det, "py": (dy * g(1) - dx * g(4)) / det})
    at = at.withColumns({"x0": F.floor("px"), "y0": F.floor("py")})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    asks = at.where((F.col("x0") >= 0) & (F.col("x0") + 1 < F.col("sx")) & (F.col("y0") >= 0) & (F.col("y0") + 1 < F.col("sy"))).withColumn("c", corners)
    cx, cy = F.col("x0") + F.col("c.a"), F.col("y0") + F.col("c.b")
    weight: Column = F.abs(1 - F.col("c.a") - (F.col("px") - F.col("x0"))) * F.abs(1 - F.col("c.b") - (F.col("py") - F.col("y0")))
    block = (F.floor(cy / F.col("high")) * F.ceil(F.col("sx") / F.col("wide")) + F.floor(cx / F.col("wide"))).cast("int")
    asks = asks.select(*key, F.col("tile").alias("raster"), block.alias("block"), cx.cast("int").alias("px"), cy.cast("int").alias("py"), weight.alias("w"))
    pixels = read_blocks(index.join(asks.select("raster", "block").distinct(), ["raster", "block"], "left_semi"))
    held = asks.join(pixels, ["raster", "block", "px", "py"]).join(tiles.select("raster", "nodata", "depth_positive"), "raster")
    good = held.where((F.col("nodata").isNull() | (F.abs(F.col("val") - F.col("nodata")) >= 1e-6)) & ~(F.col("val") > 1e30))
    value = F.sum(F.col("w") * F.col("val").cast("double"))
    values = good.groupBy(*key).agg(F.when(F.count("w") == 4, F.when(F.max("depth_positive"), value).otherwise(-value)).alias("v"))
    depth = F.when(F.col("tile").isNotNull(), F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    return found.join(values, key, "left").select(*key, F.col("tile").alias("raster"), depth.cast("float").alias("depth"))


def loading(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each raster: its blocks and bytes, and those of the ``chosen`` blocks."""
    took = chosen.groupBy("raster").agg(F.count("block").alias("blocks_read"), F.sum("size").alias("bytes_read"))
    every = index.groupBy("raster").agg(F.count("block").alias("blocks"), F.sum("size").alias("bytes"))
    return every.join(took, "raster", "left").select("raster", "blocks", "bytes", F.coalesce("blocks_read", F.lit(0)).alias("blocks_read"), F.coalesce("bytes_read", F.lit(0)).alias("bytes_read"))
