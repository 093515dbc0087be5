"""Job: a graded quadtree mesh with depths, made of soundings.

    python -m jobs.depth_mesh --soundings /data/lineitem.parquet --output /data/mesh [--config jobs/depth_mesh.json]

What a model run needs before it starts: elements that are small where the sea bed varies, neighbours that differ by one level at
most, and a depth for each.

1. Soundings (expressions of the configuration) are checked: missing, infinite or outside of the box, they are counted and left out.
2. They are summed per cell of the deepest level, which is the only pass over them; coarser cells are sums of finer ones.
3. A cell is split if it holds ``few`` soundings or more and their range exceeds ``tolerance``. Both grow from a cell to its parent, so
   the parent of a split cell is split.
4. The mesh is graded: where a cell is split, the parents of its edge neighbours must be split.
5. A leaf without soundings takes the depth of its nearest ancestor that has some.

The output is partitioned by tile; every tile is written by each run and replaces the one before.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators import mesh
from tidalframe.sources.tables import materialise

log = logging.getLogger("jobs.depth_mesh")

CONFIG = Path(__file__).with_suffix(".json")
SUMS = ("n", "weight", "low", "high")


def config_of(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def checked(rows: DataFrame, config: Mapping) -> DataFrame:
    """x, y, z and ``why``, the reason against a sounding (null: none)."""
    x0, x1, y0, y1 = (float(v) for v in config["box"])
    at = rows.select(*[F.expr(config[c]).cast("double").alias(c) for c in ("x", "y", "z")])
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("x", "y", "z")])
    infinite = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in ("x", "y", "z")])
    outside = ~(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return at.withColumn("why", F.when(missing, "missing").when(infinite, "not finite").when(outside, "outside"))


def _cells(soundings: DataFrame, config: Mapping) -> DataFrame:
    """Sums per cell of the deepest level, and counts per reason against the others: the only pass over the soundings.

    The far edges of the box belong to the last cells.
    """
    x0, x1, y0, y1 = (float(v) for v in config["box"])
    side = 1 << config["deepest"]
    index = lambda c, lo, hi: F.when(F.col("why").isNull(), F.least(F.floor((F.col(c) - lo) / (hi - lo) * side), F.lit(side - 1))).cast("long")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("z").alias("weight"), F.min("z").alias("low"), F.max("z").alias("high")]
    return soundings.groupBy("why", index("x", x0, x1).alias("ix"), index("y", y0, y1).alias("iy")).agg(*sums).select("why", F.lit(config["deepest"]).alias("lx"), "ix", "iy", *SUMS)


def _coarser(cells: DataFrame) -> DataFrame:
    half = [F.shiftright(c, 1).alias(c) for c in ("ix", "iy")]
    sums = [F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")]
    return cells.select((F.col("lx") - 1).alias("lx"), *half, *SUMS).groupBy("lx", "ix", "iy").agg(*sums)


def all_levels(deepest_cells: DataFrame, config: Mapping) -> DataFrame:
    """Sums of every cell with soundings, from the base level to the deepest."""
    levels = [deepest_cells]
    for _ in range(config["deepest"] - config["base"]):
        levels.append(materialise(_coarser(levels[-1]), "level"))
    return reduce(DataFrame.unionByName, levels)


def splits(cells: DataFrame, config: Mapping) -> DataFrame:
    """(level, ix, iy) of the cells whose soundings ask for a split."""
    wanted = (F.col("n") >= config["few"]) & (F.col("high") - F.col("low") > config["tolerance"]) & (F.col("lx") < config["deepest"])
    return cells.where(wanted).select(F.col("lx").alias("level"), "ix", "iy")


def depth_mesh(spark: SparkSession, deepest_cells: DataFrame, config: Mapping) -> DataFrame:
    """One row for each leaf: its number, box, soundings, depth and where that comes from."""
    cells = materialise(all_levels(deepest_cells, config), "sums")
    leaves = materialise(mesh.leaves_of(spark, mesh.graded_splits(splits(cells, config), config["base"]), config["base"]), "leaves")
    known = cells.select("lx", F.col("lx").alias("ly"), "ix", "iy", *SUMS)
    own = leaves.join(known, mesh.KEY, "left")
    above = mesh.nearest_ancestor(own.where("n IS NULL"), known.select(*mesh.KEY, (F.col("weight") / F.col("n")).alias("mean")), "mean", float("nan"))
    filled = own.join(above.select(*mesh.KEY, "mean", "from_level"), mesh.KEY, "left")
    depth = F.coalesce(F.col("weight") / F.col("n"), F.when(~F.isnan("mean"), F.col("mean")))
    level = F.when(F.col("n").isNotNull(), F.col("lx")).otherwise(F.col("from_level"))
    boxed = mesh.with_boxes(mesh.numbered(filled, config["deepest"]), config["box"])
    up = config["tile_level"]
    corner = lambda c: F.expr(f"shiftright({c}, CAST(lx - {up} AS INT))")
    tile = (corner("iy") * (1 << up) + corner("ix")).cast("int")
    return boxed.select("leaf", "lx", "ix", "iy", "xmin", "xmax", "ymin", "ymax", F.coalesce("n", F.lit(0)).alias("soundings"), "low", "high", depth.alias("depth"), level.cast("int").alias("from_level"), tile.alias("tile"))


def run(spark: SparkSession, soundings: str, output: str, config: Mapping) -> dict[str, int]:
    """Read the soundings, write the mesh partitioned by tile; how much was read, left out and written."""
    if not 0 <= config["tile_level"] <= config["base"] <= config["deepest"] <= mesh.BITS:
        raise ValueError("tile_level, base and deepest must rise")
    cells = materialise(_cells(checked(spark.read.parquet(soundings), config), config), "cells")
    told = {(r.why or "kept"): r.n for r in cells.groupBy("why").agg(F.sum("n").alias("n")).collect()}  # a row a reason
    log.info("read %s soundings from %s: %s", sum(told.values()), soundings, told)
    out = depth_mesh(spark, cells.where("why IS NULL").drop("why"), config)
    out.repartitionByRange("tile", "leaf").sortWithinPartitions("tile", "leaf").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(output)
    back = spark.read.parquet(output).agg(F.count("leaf"), F.count_if(F.col("soundings") == 0)).first()
    log.info("wrote %s leaves, %s of them without soundings, to %s", back[0], back[1], output)
    return {**told, "leaves": back[0], "empty": back[1]}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=(__doc__ or "").partition("\n")[0])
    parser.add_argument("--soundings", required=True, help="Parquet table of soundings")
    parser.add_argument("--output", required=True, help="folder of the mesh")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("depth_mesh").getOrCreate()
    try:
        run(spark, given.soundings, given.output, config_of(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
