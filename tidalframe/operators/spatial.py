"""Spatial joins: nearest points, segments and boxes, polygons, prioritised tiles, rasters.

Candidate pairs come from equal grid cells, or from a tree of boxes for the nearest sites; exact tests follow. Nothing is
compared with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions import dual, morton
from tidalframe.sources.tables import materialise, ranked


#: Sites or nodes that a node of the site tree holds.
FAN = 16
#: Most nodes of a level that every worker is sent, some 6 MB.
MOST_SENT = 1 << 16


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _finite(*names: str) -> Column:
    held = F.lit(True)
    for name in names:
        held = held & (F.abs(F.col(name).cast("double")) < F.lit(float("inf")))
    return held


def site_tree(sites: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sites packed along a Z-order curve: (node, site, sx, sy, sz) with ``FAN`` positions a node, the nodes' boxes, and how many there are.

    A position goes to its smallest id. Nodes are runs of the numbering, so crowded corners and empty plains make nodes of
    one size, and node ``n`` of a level lies in node ``n // FAN`` of the next.
    """
    held = sites.select(F.col("id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")).where(_finite("sx", "sy"))
    spots = held.groupBy("sx", "sy").agg(F.min(F.struct("site", "sz")).alias("s")).select("sx", "sy", "s.*")
    *box, total = spots.agg(*[f(c) for c in ("sx", "sy") for f in (F.min, F.max)], F.count(F.lit(1))).first()

    def steps(c: str, low: float | None, high: float | None) -> Column:
        return F.floor((F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0) * (2**morton.BITS - 1)).cast("long") if low is not None else F.lit(0).cast("long")

    coded = spots.withColumn("z__", morton.encode(dual.COLUMN, steps("sx", *box[:2]), steps("sy", *box[2:])))
    held = materialise(ranked(coded, ["z__", "sx", "sy"], "place__").withColumn("node", F.expr(f"place__ div {FAN}")).select("node", "site", "sx", "sy", "sz"), "sites")
    bounds = materialise(held.groupBy("node").agg(*[f(c).alias(n) for c, n, f in (("sx", "xmin", F.min), ("sx", "xmax", F.max), ("sy", "ymin", F.min), ("sy", "ymax", F.max))]), "nodes")
    return held, bounds, -(-total // FAN)


def nearest(points: DataFrame, sites: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each point with the nearest site (id, x, y, z) as d2, site, sz; equal distances go to the smallest id.

    Points descend the site tree level by level. Of its candidate nodes a point keeps those whose nearest corner is no further than
    the farthest corner of the best, so what a point carries doesn't depend on how far from all sites it lies or how
    crowded they are. Bounds are rounded like the distances, so no tie is lost. Small levels are broadcast, larger ones
    met by node. Points and sites without finite coordinates take no part.
    """
    key = list(key)
    held, bounds, count = site_tree(sites)
    open_ = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_finite("x", "y")).withColumn("node", F.lit(0).cast("long"))
    depth = 0
    while count > FAN**depth:
        depth += 1
    for level in reversed(range(depth)):  # the root holds all of the level below
        wide = FAN**level
        boxes = bounds.groupBy(F.expr(f"node div {wide}").alias("child__")).agg(*[f(c).alias(c) for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))])
        boxes = boxes.withColumn("parent__", F.expr(f"child__ div {FAN}"))
        if -(-count // wide) <= MOST_SENT:
            boxes = F.broadcast(boxes)
        met = open_.join(boxes, open_["node"] == boxes["parent__"])
        near, far = [], []
        for c in ("x", "y"):
            below, above = F.col(f"{c}min") - F.col(c), F.col(c) - F.col(f"{c}max")
            near.append(F.greatest(below, above, F.lit(0.0)))
            far.append(F.greatest(F.abs(below), F.abs(above)))
        met = met.withColumns({"near__": near[0] * near[0] + near[1] * near[1], "far__": far[0] * far[0] + far[1] * far[1]})
        met = met.withColumn("best__", F.min("far__").over(Window.partitionBy(*key)))
        open_ = met.where("near__ <= best__").select(*key, "x", "y", F.col("child__").alias("node"))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    return open_.join(held, "node").groupBy(*key).agg(F.min(F.struct(d2.alias("d2"), "site", "sz")).alias("s")).select(*key, "s.*")


def segments(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, seg, x0, y0, x1, y1) of the sides of closed rings of (x, y) structs."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    return rings.select(key, F.posexplode(pairs).alias("seg", "s")).select(key, "seg", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))


def segment_meets_box() -> Column:
    """Liang-Barsky clipping of (x0, y0)-(x1, y1) against the closed box (xmin, xmax, ymin, ymax)."""
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, low, high in (("x0", "x1", "xmin", "xmax"), ("y0", "y1", "ymin", "ymax")):
        d = F.col(b) - F.col(a)
        safe = F.when(d == 0, 1.0).otherwise(d)
        t0, t1 = (F.col(low) - F.col(a)) / safe, (F.col(high) - F.col(a)) / safe
        lo = F.when(d == 0, lo).otherwise(F.greatest(lo, F.least(t0, t1)))
        hi = F.when(d == 0, hi).otherwise(F.least(hi, F.greatest(t0, t1)))
        ok = ok & ((d != 0) | ((F.col(a) >= F.col(low)) & (F.col(a) <= F.col(high))))
    return ok & (lo <= hi)


def boxes_on_segments(boxes: DataFrame, lines: DataFrame, key: Sequence[str], cell: float) -> DataFrame:
    """The boxes that some segment meets: a spatial semi-join through grid cells.

    A segment takes the cells along its way, column by column, so their number grows with its length and not with its bounding box.
    """
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), cell), _cell(F.col(hi), cell)))
    left = boxes.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    walked = lines.withColumns({"lx__": F.least("x0", "x1"), "hx__": F.greatest("x0", "x1")}).withColumn("cx", span("lx__", "hx__"))
    slope = (F.col("y1") - F.col("y0")) / F.when(F.col("x1") != F.col("x0"), F.col("x1") - F.col("x0"))
    at = lambda x: F.coalesce(F.col("y0") + (x - F.col("x0")) * slope, F.col("y0"))
    enter, leave = at(F.greatest("lx__", F.col("cx") * cell)), F.when(F.col("x1") == F.col("x0"), F.col("y1")).otherwise(at(F.least("hx__", (F.col("cx") + 1) * cell)))
    pad = F.lit(1e-6 * cell)  # rounding must not miss a cell
    walked = walked.withColumns({"ly__": F.least(enter, leave) - pad, "hy__": F.greatest(enter, leave) + pad}).withColumn("cy", span("ly__", "hy__"))
    right = walked.select("cx", "cy", "x0", "y0", "x1", "y1")
    return left.join(right, ["cx", "cy"]).where(segment_meets_box()).select(*key).distinct()


def strictly_inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a closed ring, by the parity of crossings; its border is outside."""
    n = F.size(ring)
    sides = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def across(s: Column) -> Column:
        p, q = s["p"], s["q"]
        at = p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    def on(s: Column) -> Column:
        p, q = s["p"], s["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        within = (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
        return (cross == 0) & within

    return (F.size(F.filter(sides, across)) % 2 == 1) & ~F.exists(sides, on)


def region_flags(points: DataFrame, regions: Sequence[tuple[str, Sequence[tuple[float, float]]]], key: Sequence[str]) -> DataFrame:
    """Points with a bit for each region that holds them (``flags``), up to 62 regions.

    Regions are few literals, so no join is needed; a bounding box is tested first.
    """
    if len(regions) > 62:
        raise ValueError("at most 62 regions fit the flags")
    flags = F.lit(0).cast("long")
    for bit, (_, ring) in enumerate(regions):
        closed = list(ring) + ([ring[0]] if tuple(ring[0]) != tuple(ring[-1]) else [])
        xs, ys = [p[0] for p in closed], [p[1] for p in closed]
        box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
        shape = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in closed])
        flags = flags + F.when(box & strictly_inside(shape, F.col("x"), F.col("y")), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return points.select(*key, "x", "y", flags.alias("flags"))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring by the shoelace sum."""
    n = F.size(ring)
    terms = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2.0


def bilinear(points: DataFrame, pixels: DataFrame, key: Sequence[str], nodata: float) -> DataFrame:
    """Points (px, py fractional) with the raster's interpolated value in single precision.

    A corner that is missing from ``pixels`` (px, py, val) or has the missing value leaves
    the result missing. Each point asks for its four corners; one equi-join answers.
    """
    key = list(key)
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for b in (0, 1) for a in (0, 1)]))
    asks = points.select(*key, "px", "py", F.floor("px").cast("long").alias("x0"), F.floor("py").cast("long").alias("y0"), corner.alias("c"))
    asks = asks.select(*key, (F.col("x0") + F.col("c.a")).alias("cx"), (F.col("y0") + F.col("c.b")).alias("cy"), F.when(F.col("c.a") == 1, F.col("px") - F.col("x0")).otherwise(1.0 - (F.col("px") - F.col("x0"))).alias("wx"), F.when(F.col("c.b") == 1, F.col("py") - F.col("y0")).otherwise(1.0 - (F.col("py") - F.col("y0"))).alias("wy"))
    held = pixels.select(F.col("px").cast("long").alias("cx"), F.col("py").cast("long").alias("cy"), F.col("val").cast("double").alias("val")).where(F.col("val") != nodata)
    summed = asks.join(held, ["cx", "cy"]).groupBy(*key).agg(F.count("val").alias("n"), F.sum(F.col("wx") * F.col("wy") * F.col("val")).alias("v")).where("n = 4")
    return points.select(*key).join(summed, key, "left").select(*key, F.coalesce(F.col("v"), F.lit(nodata)).cast("float").alias("value"))


def box_filter(points: DataFrame, pixels: DataFrame, key: Sequence[str], radius: int) -> DataFrame:
    """Mean of the pixels within ``radius`` of each point's pixel (px, py), and their number.

    Pixels are first summed along rows, once for each row a point needs, then over the rows.
    """
    key = list(key)
    reach = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    asks = points.select(*key, F.col("px").alias("x0"), F.col("py").alias("y0")).withColumn("d", reach).withColumn("py", F.col("y0") + F.col("d"))
    rows = asks.select("x0", "py").distinct().withColumn("e", reach).withColumn("px", F.col("x0") + F.col("e"))
    sums = rows.join(pixels.select("px", "py", "val"), ["px", "py"]).groupBy("x0", "py").agg(F.sum("val").alias("s"), F.count("val").alias("c"))
    return asks.join(sums, ["x0", "py"]).groupBy(*key).agg(F.sum("s").alias("s"), F.sum("c").alias("n")).select(*key, (F.col("s") / F.col("n")).alias("mean"), "n")


def box_filter_or_point(points: DataFrame, pixels: DataFrame, valid: DataFrame, key: Sequence[str], radius: int) -> DataFrame:
    """(key, value): the mean of the valid pixels within ``radius``; where there is none, the pixel at the point."""
    means = box_filter(points, valid, key, radius).select(*key, "mean")
    here = points.join(pixels.select("px", "py", "val"), ["px", "py"], "left")
    return here.join(means, list(key), "left").select(*key, F.coalesce("mean", "val").alias("value"))


def first_tile(points: DataFrame, tiles: DataFrame, key: Sequence[str], cell: float) -> DataFrame:
    """Points with the tile of least priority whose closed box holds them; none: null.

    The tile wins before its values are looked at, so a missing value in it hides later tiles.
    """
    key = list(key)
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), cell), _cell(F.col(hi), cell)))
    spread = tiles.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))
    asks = points.select(*key, "x", "y", _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    hit = asks.join(spread, ["cx", "cy"]).where(inside).groupBy(*key).agg(F.min(F.struct("priority", "tile")).alias("t"))
    return points.select(*key).join(hit, key, "left").select(*key, F.col("t.tile").alias("tile"))
