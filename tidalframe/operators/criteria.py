"""Which elements to refine, keep or leave out: land tests, refinement criteria, vetoes, flags.

Criteria work on sample tables: an element's points are generated in closed form, meet the raster or field by an
equi-join of the caller's, and are reduced per element, so nothing larger than samples is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depths of less than this are none.
NO_DEPTH = 1e-6


def grid_samples(elements: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """(key, s, x, y): n x n points of each element's box, corners included; row by row."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("s")
    rows = elements.select(*key, "xmin", "xmax", "ymin", "ymax", at)
    u, v = (F.col("s") % n) / float(n - 1), F.floor(F.col("s") / n) / float(n - 1)
    return rows.select(*key, "s", (F.col("xmin") + u * (F.col("xmax") - F.col("xmin"))).alias("x"), (F.col("ymin") + v * (F.col("ymax") - F.col("ymin"))).alias("y"))


def five_samples(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, s, x, y): the four corners (s 0 to 3) and the centre (4) of each element's box."""
    x0, x1, y0, y1 = (F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    spots = [(x0, y0), (x1, y0), (x0, y1), (x1, y1), (0.5 * (x0 + x1), 0.5 * (y0 + y1))]
    at = F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in spots])).alias("s", "p")
    return elements.select(*key, at).select(*key, "s", "p.x", "p.y")


def all_land(samples: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, land): whether every sample's ``land`` holds; a null is no land."""
    return samples.groupBy(*key).agg(F.min(F.coalesce("land", F.lit(False))).alias("land"))


def no_depth(samples: DataFrame, key: Sequence[str], most: float = NO_DEPTH) -> DataFrame:
    """(key, dry): whether every sample's ``depth`` is at most ``most`` in magnitude; a null is not."""
    return samples.groupBy(*key).agg(F.min(F.coalesce(F.abs("depth") <= most, F.lit(False))).alias("dry"))


def land_or_no_depth(corners: DataFrame, inner: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, land): all corners and the centre are land, or all inner samples have no depth."""
    both = all_land(corners, key).join(no_depth(inner, key), list(key))
    return both.select(*key, (F.col("land") | F.col("dry")).alias("land"))


def value_range(samples: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, low, high) of the samples."""
    return samples.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def steep(low: Column, high: Column, size: Column, threshold: float) -> Column:
    """Whether the range over the element's least size exceeds the threshold."""
    return (high - low) / size > threshold


def mixed(samples: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, coast): whether samples are wet and dry (``land``) both."""
    wet, dry = F.count_if(~F.col("land")), F.count_if(F.col("land"))
    return samples.groupBy(*key).agg(((wet > 0) & (dry > 0)).alias("coast"))


def any_of(*tests: Column) -> Column:
    """Whether some criterion holds; a null one doesn't."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def generator_wants(size: Column, coast: Column, dx: Column, dy: Column, smallest: float, threshold: float) -> Column:
    """A mesh generator's wish: not below the smallest size; near the coast or on steep ground."""
    return F.when(size < smallest, F.lit(False)).otherwise(any_of(coast, F.sqrt(dx * dx + dy * dy) > threshold))


def water_cells(samples: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, water): whether the centre (s 4) or else some corner is no land."""
    centre = F.max(F.when(F.col("s") == 4, ~F.col("land")))
    return samples.groupBy(*key).agg(F.coalesce(centre | F.max(~F.col("land")), F.lit(False)).alias("water"))


def coast_masks(elements: DataFrame, touched: DataFrame, key: Sequence[str], deepest: int) -> DataFrame:
    """(key, mask): both horizontal axes (1 | 2) for elements that a coast segment meets below the deepest level, else 0."""
    hit = touched.select(*key).distinct().withColumn("hit__", F.lit(True))
    rows = elements.join(hit, list(key), "left")
    return rows.select(*key, F.when(F.col("hit__") & (F.greatest("lx", "ly") < deepest), 3).otherwise(0).alias("mask"))


def constrained_actions(actions: DataFrame, inside: Column, least: int, deepest: int, shallowest: int = 0, land: Column | None = None) -> DataFrame:
    """``actions`` (key, lx, ly, action: 1 refine, -1 coarsen, 0 none) under level limits, land and an area of interest.

    Inside the area, elements above level ``least`` are refined where the deepest level allows, the others aren't coarsened. Land
    is not refined.
    """
    level = F.greatest("lx", "ly")
    can_refine = (F.col("lx") < deepest) & (F.col("ly") < deepest)
    can_coarsen = (F.col("lx") > shallowest) | (F.col("ly") > shallowest)
    own = F.when((F.col("action") == 1) & ~can_refine, 0).when((F.col("action") == -1) & ~can_coarsen, 0).otherwise(F.col("action"))
    own = own if land is None else F.when(land & (F.col("action") == 1), 0).otherwise(own)
    out = F.when(inside & (level < least) & can_refine, 1).when(inside & (level >= least) & (F.col("action") == -1), 0).otherwise(own)
    return actions.withColumn("action", out.cast("int"))


def with_flag(rows: DataFrame, marked: DataFrame, key: Sequence[str], flag: str = "marked") -> DataFrame:
    """``rows`` with 1 where their key is among ``marked``, else 0."""
    found = marked.select(*key).distinct().withColumn(flag, F.lit(1))
    return rows.join(found, list(key), "left").fillna(0, [flag])


def loading_stats(registered: DataFrame, used: DataFrame, tile: str, size: Column) -> DataFrame:
    """One row: tiles registered, tiles that some row of ``used`` needed, and bytes of those."""
    loaded = registered.join(used.select(tile).distinct(), tile, "left_semi")
    totals = registered.agg(F.count(tile).alias("registered"))
    return totals.crossJoin(loaded.agg(F.count(tile).alias("loaded"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")))  # one row each


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the first in ``order``; partial aggregation keeps one candidate a task."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r__"))
    return best.select(*key, "r__.*")

