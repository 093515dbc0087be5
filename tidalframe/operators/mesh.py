"""Quadtree meshes as relations: building, locating, adjacency, refinement, partitions.

An element is (lx, ly, ix, iy): its level and cell on each axis; boxes and the depth-first
``leaf`` number follow from these. Neighbours and points meet by equal cell keys, so every join here is an
equi-join, and none needs the mesh on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.functions import morton
from tidalframe.functions.dual import COLUMN
from tidalframe.sources.tables import materialise, ranked

KEY = ["lx", "ly", "ix", "iy"]
BITS = 16


def _power(level: str) -> Column:
    return F.pow(F.lit(2.0), F.col(level))


def with_boxes(cells: DataFrame, box: Sequence[float]) -> DataFrame:
    """Add xmin, xmax, ymin, ymax."""
    x0, x1, y0, y1 = (float(v) for v in box)
    dx, dy = (x1 - x0) / _power("lx"), (y1 - y0) / _power("ly")
    return cells.withColumns({"xmin": x0 + F.col("ix") * dx, "xmax": x0 + (F.col("ix") + 1) * dx, "ymin": y0 + F.col("iy") * dy, "ymax": y0 + (F.col("iy") + 1) * dy})


def path(deepest: int) -> Column:
    """Morton code of the lower corner at the deepest level: the depth-first order of leaves."""
    up = lambda c, level: F.expr(f"shiftleft(CAST({c} AS BIGINT), CAST({deepest} - {level} AS INT))")
    return morton.encode(COLUMN, up("ix", "lx"), up("iy", "ly"), bits=BITS)


def _placed(cells: DataFrame, deepest: int) -> DataFrame:
    """Add ``leaf``, the depth-first number, and ``total``; a mesh refined in one corner is numbered in as many tasks as any."""
    return ranked(cells.withColumn("path__", path(deepest)), ["path__", "lx", "ly"], "leaf").drop("path__")


def numbered(cells: DataFrame, deepest: int) -> DataFrame:
    """Add ``leaf``, the depth-first number of each leaf."""
    return _placed(cells, deepest).drop("total")


def uniform(spark: SparkSession, lx: int, ly: int) -> DataFrame:
    """All cells of one level, in closed form from a range."""
    nx = 1 << lx
    at = spark.range(nx << ly)
    return at.select(F.lit(lx).alias("lx"), F.lit(ly).alias("ly"), (F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).cast("long").alias("iy"))


def levels_for(n: int) -> int:
    """Quadtree levels for a wanted number of cells: the nearest power of two."""
    from math import log2

    return max(0, round(log2(n)))


def counts_by_level(points: DataFrame, box: Sequence[float], base: int, deepest: int, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """(level, i and axis of each cell, n): points of each cell with any, from ``base`` to ``deepest``.

    Points are counted per deepest cell first; every level sums those counts. Points outside of the box or without a position don't
    count, those on its far sides are in the last cells.
    """
    side, ends = 1 << deepest, [(float(box[2 * k]), float(box[2 * k + 1])) for k in range(len(axes))]
    inside = F.lit(True)
    for c, (lo, hi) in zip(axes, ends, strict=True):
        inside = inside & F.col(c).between(lo, hi)
    index = [F.least(F.floor((F.col(c) - lo) / (hi - lo) * side), F.lit(side - 1)).cast("long").alias(f"i{c}") for c, (lo, hi) in zip(axes, ends, strict=True)]
    names = [f"i{c}" for c in axes]
    fine = points.where(inside).groupBy(*index).agg(F.count(F.lit(1)).alias("n"))
    each = fine.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(deepest))))
    return each.groupBy("level", *[F.expr(f"shiftright({c}, CAST({deepest} - level AS INT))").alias(c) for c in names]).agg(F.sum("n").alias("n"))


def graded_splits(splits: DataFrame, base: int) -> DataFrame:
    """The cells (level, ix, iy) to split so that edge neighbours among the leaves differ by one level at most.

    Where a cell is split, the parents of its edge neighbours must be split, and so on up to the base level. Each cell works out its
    own consequences, at most a few cells a level, so one distinct closes the set.
    """
    by = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]

    def up(cells: Column, level: Column) -> Column:
        last = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int")) - 1
        near = F.flatten(F.transform(cells, lambda c: F.transform(F.array(*by), lambda d: F.struct((c["ix"] + d["a"]).alias("ix"), (c["iy"] + d["b"]).alias("iy")))))
        held = F.filter(near, lambda c: (c["ix"] >= 0) & (c["ix"] <= last) & (c["iy"] >= 0) & (c["iy"] <= last))
        return F.array_distinct(F.transform(held, lambda c: F.struct(F.shiftright(c["ix"], 1).alias("ix"), F.shiftright(c["iy"], 1).alias("iy"))))

    own = F.struct(F.col("level").cast("int").alias("level"), F.array(F.struct(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))).alias("cells"))
    chain = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("level").cast("int") - base, F.lit(1))), F.array(own),
        lambda done, _: F.when(F.element_at(done, -1)["level"] > base, F.concat(done, F.array(F.struct((F.element_at(done, -1)["level"] - 1).alias("level"), up(F.element_at(done, -1)["cells"], F.element_at(done, -1)["level"]).alias("cells"))))).otherwise(done),
    )
    rows = splits.select(F.explode(chain).alias("s")).select("s.level", F.explode("s.cells").alias("c"))
    return rows.select("level", "c.ix", "c.iy").distinct()


def leaves_of(spark: SparkSession, splits: DataFrame, base: int) -> DataFrame:
    """The base cells and the children of split cells (level, ix, iy) that aren't split themselves."""
    square = splits.select(F.col("level").cast("int").alias("lx"), F.col("level").cast("int").alias("ly"), "ix", "iy")
    return uniform(spark, base, base).unionByName(children(square)).join(square, KEY, "left_anti")


def from_points(points: DataFrame, box: Sequence[float], base: int, deepest: int, most: int, graded: bool = True) -> DataFrame:
    """The mesh whose cells hold at most ``most`` points (x, y), as far as ``deepest`` allows, graded unless told otherwise."""
    wanted = counts_by_level(points, box, base, deepest).where((F.col("n") > most) & (F.col("level") < deepest)).select("level", "ix", "iy")
    return leaves_of(points.sparkSession, graded_splits(wanted, base) if graded else wanted, base)


def octree_from_points(points: DataFrame, box: Sequence[float], base: int, deepest: int, most: int) -> DataFrame:
    """(leaf, level, ix, iy, iz): the octree whose cells hold at most ``most`` points (x, y, z), as far as ``deepest`` allows, down to level
    ``base`` everywhere; ``leaf`` names a cell by level and place."""
    spark, axes = points.sparkSession, ["ix", "iy", "iz"]
    split = counts_by_level(points, box, base, deepest, ("x", "y", "z")).where((F.col("n") > most) & (F.col("level") < deepest)).select(F.col("level").cast("int").alias("level"), *axes)
    side = 1 << base
    first = spark.range(side**3).select(F.lit(base).alias("level"), (F.col("id") % side).alias("ix"), (F.floor(F.col("id") / side) % side).cast("long").alias("iy"), F.floor(F.col("id") / side**2).cast("long").alias("iz"))
    both = lambda: F.explode(F.array(F.lit(0), F.lit(1)))
    born = split.withColumn("a__", both()).withColumn("b__", both()).withColumn("c__", both())
    born = born.select((F.col("level") + 1).alias("level"), *[(F.col(c) * 2 + F.col(h)).alias(c) for c, h in zip(axes, ("a__", "b__", "c__"), strict=True)])
    cells = first.unionByName(born).join(split, ["level", *axes], "left_anti")
    width = 1 << deepest
    return cells.withColumn("leaf", ((F.col("level") * width + F.col("iz")) * width + F.col("iy")) * width + F.col("ix"))


def children(cells: DataFrame, mask: int | Column = 3) -> DataFrame:
    """The cells that replace each cell when the masked axes are halved."""
    mask = F.lit(mask) if isinstance(mask, int) else mask
    x, y = mask.bitwiseAND(F.lit(1)), F.shiftright(mask.bitwiseAND(F.lit(2)), 1)
    rows = cells.withColumns({"a__": x, "b__": y})
    rows = rows.withColumn("i__", F.explode(F.sequence(F.lit(0), F.col("a__")))).withColumn("j__", F.explode(F.sequence(F.lit(0), F.col("b__"))))
    return rows.select((F.col("lx") + F.col("a__")).alias("lx"), (F.col("ly") + F.col("b__")).alias("ly"), (F.col("ix") * (1 + F.col("a__")) + F.col("i__")).alias("ix"), (F.col("iy") * (1 + F.col("b__")) + F.col("j__")).alias("iy"))


def refine(cells: DataFrame, marked: DataFrame, mask: int = 3) -> DataFrame:
    """The mesh with the marked cells replaced by their children."""
    cells = cells.select(*KEY)
    return cells.join(marked.select(*KEY), KEY, "left_anti").unionByName(children(cells.join(marked.select(*KEY), KEY, "left_semi"), mask))


def coarsen(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """The mesh with four marked siblings replaced by their parent where all four are leaves."""
    up = marked.select(*KEY).distinct().join(cells.select(*KEY), KEY, "left_semi").select(*KEY, *[F.floor(F.col(c) / 2).cast("long").alias(f"p{c}") for c in ("ix", "iy")])
    full = up.groupBy("lx", "ly", "pix", "piy").agg(F.count("ix").alias("n")).where("n = 4 AND lx > 0 AND ly > 0")
    gone = up.join(full, ["lx", "ly", "pix", "piy"], "left_semi").select(*KEY)
    parents = full.select((F.col("lx") - 1).alias("lx"), (F.col("ly") - 1).alias("ly"), F.col("pix").alias("ix"), F.col("piy").alias("iy"))
    return cells.select(*KEY).join(gone, KEY, "left_anti").unionByName(parents)


def ancestors(cells: DataFrame) -> DataFrame:
    """Every proper ancestor (alx, aly, aix, aiy) of isotropic cells, ``up`` steps above."""
    step = F.explode(F.sequence(F.lit(1), F.least("lx", "ly"))).alias("up")
    rows = cells.where("lx > 0 AND ly > 0").select("*", step)
    shift = lambda c: F.expr(f"shiftright({c}, up)")
    return rows.withColumns({"alx": F.col("lx") - F.col("up"), "aly": F.col("ly") - F.col("up"), "aix": shift("ix"), "aiy": shift("iy")})


def nearest_ancestor(cells: DataFrame, stored: DataFrame, value: str = "coef", default: float = 0.0) -> DataFrame:
    """Each cell with the value of its nearest stored ancestor, or the default: an as-of join by level."""
    up = ancestors(cells.select(*KEY))
    found = up.join(stored.select(F.col("lx").alias("alx"), F.col("ly").alias("aly"), F.col("ix").alias("aix"), F.col("iy").alias("aiy"), value), ["alx", "aly", "aix", "aiy"])
    best = found.groupBy(*KEY).agg(F.max_by(value, "alx").alias("v__"), F.max("alx").alias("from_level"))
    return cells.select(*KEY).join(best, KEY, "left").select(*KEY, F.coalesce("v__", F.lit(default)).alias(value), "from_level")


def candidates(points: DataFrame, box: Sequence[float], levels: Sequence[int], key: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """(key, axes, lx, i and axis ...): the cells of each level whose closed boxes hold a point, both sides of an edge it lies on."""
    sides = lambda e, n: F.array_distinct(F.filter(F.array(F.floor(e).cast("long"), (F.ceil(e) - 1).cast("long")), lambda i: ~F.isnan(e) & (i >= 0) & (i < n)))
    count = F.expr("shiftleft(CAST(1 AS BIGINT), lx)")
    asks = points.select(*key, *axes, F.explode(F.array(*[F.lit(k) for k in levels])).alias("lx"))
    for k, c in enumerate(axes):
        lo, hi = float(box[2 * k]), float(box[2 * k + 1])
        asks = asks.withColumn(f"i{c}", F.explode(sides((F.col(c) - lo) / (hi - lo) * F.pow(F.lit(2.0), F.col("lx")), count)))
    return asks


def locate(points: DataFrame, cells: DataFrame, box: Sequence[float], levels: Sequence[int], key: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points (``key``, x, y) with the leaf that holds them (-1: none); on shared edges the lowest leaf.

    A point names its candidate cells at each level and meets the leaves by an equi-join. With three ``axes`` cells are cubes
    (lx, ix, iy, iz, leaf).
    """
    names = ["lx", *[f"i{c}" for c in axes]]
    hits = candidates(points, box, levels, key, axes).join(cells.select(*names, "leaf"), names).groupBy(*key).agg(F.min("leaf").alias("leaf"))
    return points.select(*key).join(hits, list(key), "left").select(*key, F.coalesce("leaf", F.lit(-1)).alias("leaf"))


def edges(cells: DataFrame, finest: int) -> DataFrame:
    """Four edges a leaf, in units of the finest cell: edge 0 left, 1 right, 2 bottom, 3 top.

    ``level`` and ``index`` name the edge's dyadic interval along its line.
    """
    unit = lambda level: F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({finest} - {level} AS INT))")
    w, h = unit("lx"), unit("ly")
    x, y = F.col("ix") * w, F.col("iy") * h
    one = lambda e, at, lo, size, level, index: F.struct(F.lit(e).alias("edge"), at.alias("at"), lo.alias("lo"), (lo + size).alias("hi"), F.col(level).cast("int").alias("level"), F.col(index).cast("long").alias("index"))
    sides = F.array(one(0, x, y, h, "ly", "iy"), one(1, x + w, y, h, "ly", "iy"), one(2, y, x, w, "lx", "ix"), one(3, y + h, x, w, "lx", "ix"))
    return cells.select("leaf", F.explode(sides).alias("e")).select("leaf", "e.*")


def _opposite(edge: str) -> Column:
    return F.col(edge) + F.when(F.col(edge) % 2 == 0, 1).otherwise(-1)


def adjacency(cells: DataFrame, finest: int) -> DataFrame:
    """(leaf, edge, kind, neighbour, neighbour_edge, sub): one row for each neighbour, one for a boundary.

    Of two dyadic intervals that overlap one contains the other, so every edge names its interval
    and all that contain it, and meets the opposite edges by equal names: no pair is formed that
    isn't a neighbourhood. Kinds: boundary, conforming, coarse_to_fine (sub: order along the
    edge), fine_to_coarse (sub: which half).
    """
    mine = edges(cells, finest)
    other = mine.select(F.col("leaf").alias("neighbour"), F.col("edge").alias("neighbour_edge"), _opposite("edge").alias("edge"), "at", F.col("lo").alias("nlo"), F.col("hi").alias("nhi"), "level", "index")
    up = mine.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumns({"index": F.expr("shiftright(index, up)"), "level": F.col("level") - F.col("up")})
    inside = up.join(other.hint("merge"), ["edge", "at", "level", "index"]).select("leaf", "edge", "lo", "hi", "neighbour", "neighbour_edge", "nlo", "nhi", "up")
    around = inside.where("up > 0").select(F.col("neighbour").alias("leaf"), F.col("neighbour_edge").alias("edge"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), F.col("leaf").alias("neighbour"), F.col("edge").alias("neighbour_edge"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    holds = inside.drop("up").unionByName(around)
    side = Window.partitionBy("leaf", "edge")
    ranked = holds.withColumns({"n": F.count("neighbour").over(side), "order": F.row_number().over(side.orderBy("nlo")) - 1})
    size, other_size = F.col("hi") - F.col("lo"), F.col("nhi") - F.col("nlo")
    kind = F.when(F.col("n") > 1, "coarse_to_fine").when(other_size > size * 1.5, "fine_to_coarse").otherwise("conforming")
    half = F.when(F.col("lo") + F.col("hi") < F.col("nlo") + F.col("nhi"), 0).otherwise(1)
    sub = F.when(F.col("n") > 1, F.col("order")).when(other_size > size * 1.5, half)
    met = ranked.select("leaf", "edge", kind.alias("kind"), "neighbour", "neighbour_edge", sub.cast("int").alias("sub"))
    rim = boundary(mine, met).select("leaf", "edge", F.lit("boundary").alias("kind"), F.lit(None).cast("long").alias("neighbour"), F.lit(None).cast("int").alias("neighbour_edge"), F.lit(None).cast("int").alias("sub"))
    return met.unionByName(rim)


def face_adjacency(cells: DataFrame, finest: int) -> DataFrame:
    """(leaf, face, kind, neighbour) of isotropic cells (leaf, level, ix, iy, iz): faces 0 to 5 are low and high x, y, z.

    As in two dimensions: faces meet by the names of their squares and of all squares that contain
    them. Kinds: same_level, coarse_to_fine, fine_to_coarse, boundary.
    """
    unit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({finest} - level AS INT))")
    one = lambda f, at, a, b: F.struct(F.lit(f).alias("face"), at.alias("at"), F.col(a).alias("a"), F.col(b).alias("b"))
    sides = [one(2 * d + end, (F.col(axis) + end) * unit, *rest) for d, (axis, rest) in enumerate((("ix", ("iy", "iz")), ("iy", ("ix", "iz")), ("iz", ("ix", "iy")))) for end in (0, 1)]
    mine = cells.select("leaf", "level", F.explode(F.array(*sides)).alias("s")).select("leaf", "level", "s.*")
    other = mine.select(F.col("leaf").alias("neighbour"), F.col("face").alias("its"), _opposite("face").alias("face"), "at", "level", "a", "b")
    up = mine.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level").cast("int")))).withColumns({"a": F.expr("shiftright(a, up)"), "b": F.expr("shiftright(b, up)"), "level": F.col("level") - F.col("up")})
    inside = up.join(other, ["face", "at", "level", "a", "b"]).select("leaf", "face", "neighbour", "its", "up")
    met = inside.select("leaf", "face", F.when(F.col("up") == 0, "same_level").otherwise("fine_to_coarse").alias("kind"), "neighbour")
    met = met.unionByName(inside.where("up > 0").select(F.col("neighbour").alias("leaf"), F.col("its").alias("face"), F.lit("coarse_to_fine").alias("kind"), F.col("leaf").alias("neighbour")))
    rim = mine.select("leaf", "face").join(met.select("leaf", "face"), ["leaf", "face"], "left_anti")
    return met.unionByName(rim.select("leaf", "face", F.lit("boundary").alias("kind"), F.lit(None).cast("long").alias("neighbour")))


def bottom_links(cells: DataFrame, quads: DataFrame) -> DataFrame:
    """(leaf, quad): the lowest layer of isotropic octree cells and the quadtree cells below them."""
    low = cells.where("iz = 0").select("leaf", F.col("level").alias("lx"), "ix", "iy")
    return low.join(quads.select(F.col("leaf").alias("quad"), "lx", "ix", "iy"), ["lx", "ix", "iy"]).select("leaf", "quad")


def graded(spark: SparkSession, levels: int, box: Sequence[float]) -> DataFrame:
    """A mesh refined towards the centre: each level splits the cells whose closed box holds it."""
    x, y = (box[0] + box[1]) / 2, (box[2] + box[3]) / 2
    holds = (F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y)
    return grow(uniform(spark, 0, 0), holds, levels, box)


def boundary(all_edges: DataFrame, met: DataFrame) -> DataFrame:
    """Edges without a neighbour."""
    return all_edges.join(met.select("leaf", "edge").hint("merge"), ["leaf", "edge"], "left_anti").select("leaf", "edge")


def balance(cells: DataFrame, finest: int, most_rounds: int = 32) -> DataFrame:
    """Split cells until edge neighbours differ by one level at most.

    Every round splits the coarse sides of all violations at once; the lineage is cut by a table
    in the shared folder, so lost executors cost one round.
    """
    cells = cells.select(*KEY)
    for _ in range(most_rounds):
        leaves = numbered(cells, finest)
        level = leaves.select(F.col("leaf").alias("neighbour"), F.col("lx").alias("nlx"))
        pairs = adjacency(leaves, finest).where("neighbour IS NOT NULL").join(level, "neighbour").join(leaves, "leaf")
        coarse = materialise(pairs.where("nlx > lx + 1").select(*KEY).distinct(), "unbalanced")
        if coarse.isEmpty():
            return cells
        cells = materialise(refine(cells, coarse), "mesh")
    raise RuntimeError(f"the mesh is not balanced after {most_rounds} rounds")


def grow(cells: DataFrame, wanted: Column, deepest: int, box: Sequence[float]) -> DataFrame:
    """Refine cells for which ``wanted`` holds over their boxes, level by level, to ``deepest``.

    Each level is a table of its own: a plan over all levels would double with every one.
    """
    for _ in range(deepest):
        marks = with_boxes(cells, box).where(wanted & (F.col("lx") < deepest)).select(*KEY)
        if marks.isEmpty():
            break
        cells = materialise(refine(cells, marks), "mesh")
    return cells


def grow_axes(cells: DataFrame, wanted_x: Column, wanted_y: Column, deepest: Sequence[int], box: Sequence[float]) -> DataFrame:
    """Halve cells along the axes that want it, level by level, each axis to a depth of its own; a table a level."""
    cells = cells.select(*KEY)
    for _ in range(max(deepest)):
        boxes = with_boxes(cells, box)
        along = lambda wanted, level, most, bit: F.when(F.coalesce(wanted, F.lit(False)) & (F.col(level) < most), bit).otherwise(0)
        masked = boxes.select(*KEY, (along(wanted_x, "lx", deepest[0], 1) + along(wanted_y, "ly", deepest[1], 2)).cast("int").alias("mask__"))
        if masked.where("mask__ > 0").isEmpty():
            break
        cells = materialise(children(masked, F.col("mask__")), "mesh")
    return cells


def balance_axes(cells: DataFrame, finest: int, most_rounds: int = 64) -> DataFrame:
    """Halve cells, along one axis or both, until edge neighbours differ by one level at most on either axis."""
    cells = cells.select(*KEY)
    for _ in range(most_rounds):
        leaves = numbered(cells, finest)
        level = leaves.select(F.col("leaf").alias("neighbour"), F.col("lx").alias("nlx"), F.col("ly").alias("nly"))
        pairs = adjacency(leaves, finest).where("neighbour IS NOT NULL").join(level, "neighbour").join(leaves, "leaf")
        wanted = pairs.groupBy(*KEY).agg((F.max(F.when(F.col("nlx") > F.col("lx") + 1, 1).otherwise(0)) + F.max(F.when(F.col("nly") > F.col("ly") + 1, 2).otherwise(0))).cast("int").alias("mask__"))
        wanted = materialise(wanted.where("mask__ > 0"), "unbalanced")
        if wanted.isEmpty():
            return cells
        masked = cells.join(wanted, KEY, "left").withColumn("mask__", F.coalesce("mask__", F.lit(0)))
        cells = materialise(children(masked, F.col("mask__")), "mesh")
    raise RuntimeError(f"the mesh is not balanced after {most_rounds} rounds")


def tree_nodes(cells: DataFrame) -> DataFrame:
    """All nodes of the tree, internal ones too."""
    up = ancestors(cells.select(*KEY)).select(F.col("alx").alias("lx"), F.col("aly").alias("ly"), F.col("aix").alias("ix"), F.col("aiy").alias("iy"))
    return up.distinct().withColumn("is_leaf", F.lit(False)).unionByName(cells.select(*KEY).withColumn("is_leaf", F.lit(True)))


def morton_parts(cells: DataFrame, parts: int, deepest: int) -> DataFrame:
    """Leaves in Morton order, dealt to parts of equal count (first parts take the remainder)."""
    rows = _placed(cells.drop("leaf"), deepest)
    each, rest = F.floor(F.col("total") / parts), F.col("total") % parts
    wide = rest * (each + 1)
    part = F.when(F.col("leaf") < wide, F.floor(F.col("leaf") / (each + 1))).otherwise(rest + F.floor((F.col("leaf") - wide) / F.greatest(each, F.lit(1))))
    return rows.withColumn("part", part.cast("int")).drop("total")


def ghosts(near: DataFrame, owners: DataFrame) -> DataFrame:
    """(part, leaf): leaves of other parts that a part's leaves touch."""
    mine = near.where("neighbour IS NOT NULL").join(owners.select("leaf", "part"), "leaf")
    theirs = owners.select(F.col("leaf").alias("neighbour"), F.col("part").alias("owner"))
    return mine.join(theirs, "neighbour").where("part <> owner").select("part", F.col("neighbour").alias("leaf"), "owner").distinct()


def imbalance(owners: DataFrame) -> DataFrame:
    """Largest over mean part size, and whether that calls for a new partition."""
    sizes = owners.groupBy("part").agg(F.count("leaf").alias("n"))
    return sizes.agg(F.max("n").alias("largest"), (F.max("n") / F.avg("n")).alias("ratio")).withColumn("rebalance", F.when(F.col("ratio") > 1.2, 1).otherwise(0))


def diffuse(owners: DataFrame, near: DataFrame, tolerance: float = 0.1, most_rounds: int = 16) -> DataFrame:
    """(leaf, part) after parts above the mean have given leaves to touching parts below it, without a global partition.

    A round moves half of what the pair lacks, min(surplus, deficit), in leaves on the pair's border, lowest first; a leaf that touches
    several takers goes to the lowest part. It ends when the largest part is within ``tolerance`` of the mean, or nothing moves. Parts are few, so
    sizes and flows are small tables; owners are written once a round.
    """
    touch = near.where("neighbour IS NOT NULL").select("leaf", "neighbour").distinct()
    owners = owners.select("leaf", "part")
    for _ in range(most_rounds):
        sizes = owners.groupBy("part").agg(F.count("leaf").alias("n"))
        every = sizes.agg(F.floor(F.sum("n") / F.count("part")).alias("mean"), F.max("n").alias("largest"), F.avg("n").alias("exact")).first()
        if every.largest is None or every.largest <= (1 + tolerance) * every.exact:
            break
        border = touch.join(owners, "leaf").join(owners.select(F.col("leaf").alias("neighbour"), F.col("part").alias("other")), "neighbour").where("part <> other").select("leaf", "part", "other").distinct()
        flows = border.join(F.broadcast(sizes), "part").join(F.broadcast(sizes.select(F.col("part").alias("other"), F.col("n").alias("m"))), "other")  # a row a part
        flows = flows.where((F.col("n") > every.mean + 1) & (F.col("m") < every.mean - 1)).withColumn("most", F.floor(F.least(F.col("n") - every.mean, every.mean - F.col("m")) / 2))
        given = flows.where("most > 0").groupBy("leaf", "part").agg(F.min(F.struct("other", "most")).alias("to")).select("leaf", "part", "to.other", "to.most")
        order = Window.partitionBy("part", "other").orderBy("leaf")
        moved = given.withColumn("r", F.row_number().over(order)).where("r <= most").select("leaf", F.col("other").alias("taker"))
        after = materialise(owners.join(moved, "leaf", "left").select("leaf", F.coalesce("taker", "part").alias("part"), F.col("taker").isNotNull().alias("moved")), "owners")
        stuck = after.where("moved").isEmpty()
        owners = after.select("leaf", "part")
        if stuck:
            break
    return owners


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves whose owner changes."""
    return old.select("leaf", F.col("part").alias("source")).join(new.select("leaf", F.col("part").alias("target")), "leaf").where("source <> target")


def adapt_cycle(cells: DataFrame, actions: DataFrame, deepest: int) -> DataFrame:
    """One adaptive cycle over isotropic cells with values (KEY, v): the new mesh with its values.

    ``actions`` (KEY, action): 1 splits a cell, whose children take its value; -1 lets four
    siblings that are all marked so become their parent, with their mean. Cells of the deepest level aren't split.
    """
    from tidalframe.operators.fit import children_mean

    marked = cells.join(actions.select(*KEY, "action"), KEY)
    split = marked.where((F.col("action") == 1) & (F.col("lx") < deepest))
    born = children(split.select(*KEY)).withColumns({"px": F.floor(F.col("ix") / 2).cast("long"), "py": F.floor(F.col("iy") / 2).cast("long"), "pl": F.col("lx") - 1})
    parents = split.select(F.col("lx").alias("pl"), F.col("ix").alias("px"), F.col("iy").alias("py"), "v")
    born = born.join(parents, ["pl", "px", "py"]).select(*KEY, "v")
    fold = marked.where((F.col("action") == -1) & (F.col("lx") > 0)).withColumns({"px": F.floor(F.col("ix") / 2).cast("long"), "py": F.floor(F.col("iy") / 2).cast("long")})
    full = fold.groupBy("lx", "px", "py").agg(F.count("v").alias("n")).where("n = 4")
    gone = fold.join(full, ["lx", "px", "py"], "left_semi").select(*KEY, "v")
    kept = cells.select(*KEY, "v").join(split.select(*KEY), KEY, "left_anti").join(gone.select(*KEY), KEY, "left_anti")
    return kept.unionByName(born).unionByName(children_mean(gone).select(*KEY, "v"))
