"""The seabed under a mesh: which patch lies under a point, its depth and slope there, and patches that agree across hanging edges.

Patches are the leaves of a quadtree with a box and an array of Bernstein coefficients, x fastest. A point meets all patches whose closed
boxes hold it: one, two at an edge, up to four at a corner. The rules there: the element and the depth are those of the lowest leaf; a
slope across an edge is the mean of the slopes on both sides, each of the lowest leaf there, and at the rim of the mesh that of the only
side. Outside of all patches the element is -1, depth and slopes are 0 and ``found`` is false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.functions import basis
from tidalframe.functions.dual import COLUMN
from tidalframe.operators import mesh
from tidalframe.operators.fit import literal_rows
from tidalframe.sources.tables import materialise


def _touching(points: DataFrame, patches: DataFrame, box: Sequence[float], levels: Sequence[int], key: Sequence[str], more: Sequence[str]) -> DataFrame:
    """A row for each point and patch whose closed box holds it."""
    held = patches.select("lx", "ix", "iy", "leaf", "xmin", "xmax", "ymin", "ymax", *more)
    return mesh.candidates(points, box, levels, key).join(held, ["lx", "ix", "iy"])


def _value(degree: int, values: str, along_x, along_y) -> Column:
    """A tensor-product sum over an array of coefficients; ``along_x(i)`` and ``along_y(j)`` are the factors."""
    n = degree + 1
    rows = []
    for j in range(n):
        row = F.col(values)[n * j] * along_x(0)
        for i in range(1, n):
            row = row + F.col(values)[n * j + i] * along_x(i)
        rows.append(row * along_y(j))
    out = rows[0]
    for row in rows[1:]:
        out = out + row
    return out


def evaluate(points: DataFrame, patches: DataFrame, box: Sequence[float], levels: Sequence[int], key: Sequence[str], degree: int, values: str = "coefficients") -> DataFrame:
    """(key, element, found, depth, dh_dx, dh_dy) of points (``key``, x, y) on patches of one degree."""
    key = list(key)
    met = _touching(points, patches, box, levels, key, (values,))
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col(f"{c}min")) / (F.col(f"{c}max") - F.col(f"{c}min"))))
    met = met.withColumns({"u": part("x"), "v": part("y")})
    for of, name in ((basis.bernstein, "b"), (basis.bernstein_slope, "d")):
        met = met.withColumns({f"{name}{c}{k}": of(COLUMN, degree, k, F.col(c)) for c in "uv" for k in range(degree + 1)})
    at = lambda name: lambda k: F.col(f"{name}{k}")
    met = met.select(
        *key, "leaf", _value(degree, values, at("bu"), at("bv")).alias("h"),
        (_value(degree, values, at("du"), at("bv")) / (F.col("xmax") - F.col("xmin"))).alias("sx"), (_value(degree, values, at("bu"), at("dv")) / (F.col("ymax") - F.col("ymin"))).alias("sy"),
        (F.col("x") < F.col("xmax")).alias("on_right"), (F.col("x") > F.col("xmin")).alias("on_left"), (F.col("y") < F.col("ymax")).alias("on_top"), (F.col("y") > F.col("ymin")).alias("on_bottom"),
    )
    side = lambda slope, where: F.min(F.when(F.col(where), F.struct("leaf", slope)))[slope]
    found = met.groupBy(*key).agg(F.min(F.struct("leaf", "h")).alias("low"), *[side(s, w).alias(w) for s, w in (("sx", "on_right"), ("sx", "on_left"), ("sy", "on_top"), ("sy", "on_bottom"))])
    mean = lambda a, b: F.coalesce((F.col(a) + F.col(b)) / 2, a, b, F.lit(0.0))
    out = points.select(*key).join(found, key, "left")
    return out.select(*key, F.coalesce("low.leaf", F.lit(-1)).alias("element"), F.col("low").isNotNull().alias("found"), F.coalesce("low.h", F.lit(0.0)).alias("depth"), mean("on_right", "on_left").alias("dh_dx"), mean("on_top", "on_bottom").alias("dh_dy"))


def find(points: DataFrame, bottom: DataFrame, box: Sequence[float], levels: Sequence[int], key: Sequence[str]) -> DataFrame:
    """(key, element, cell): the lowest seabed element whose closed box holds each point, and the mesh cell that stands on it; -1 for both outside.

    ``bottom``: element, cell, lx, ix, iy of the lowest layer of a mesh.
    """
    key = list(key)
    met = mesh.candidates(points, box, levels, key).join(bottom, ["lx", "ix", "iy"]).groupBy(*key).agg(F.min(F.struct("element", "cell")).alias("s"))
    return points.select(*key).join(met, key, "left").select(*key, F.coalesce("s.element", F.lit(-1)).alias("element"), F.coalesce("s.cell", F.lit(-1)).alias("cell"))


def _edge_place(edge: str, at: str, degree: int) -> Column:
    """Index of the ``at``-th coefficient of an edge: 0 left, 1 right, 2 bottom, 3 top."""
    n = degree + 1
    k = F.col(at)
    return F.when(F.col(edge) == 0, k * n).when(F.col(edge) == 1, k * n + degree).when(F.col(edge) == 2, k).otherwise(k + n * degree)


def conform(coefficients: DataFrame, leaves: DataFrame, near: DataFrame, levels: Sequence[int], degree: int) -> DataFrame:
    """(leaf, k, z) after the coefficients on the edges of finer cells are set to what the coarser neighbour has there.

    Level by level from the coarsest, as a cell may be finer than one neighbour and coarser than another; each level is a table. A corner
    that two coarser neighbours claim goes to the later edge. ``near`` is the adjacency of a graded mesh.
    """
    terms: dict[str, list] = {"half": [], "r": [], "c": [], "w": []}
    for half in (0, 1):
        matrix = basis.extraction(degree, half)
        for r in range(degree + 1):
            for c in range(degree + 1):
                if matrix[r, c]:
                    for name, value in zip(terms, (half, r, c, float(matrix[r, c])), strict=True):
                        terms[name].append(value)
    level_of = leaves.select("leaf", F.col("lx").alias("level"))
    fine = near.where("kind = 'fine_to_coarse'").select("leaf", "edge", "neighbour", "neighbour_edge", "sub", F.inline(literal_rows(terms))).where("sub = half").join(level_of, "leaf")
    asks = materialise(fine.select("leaf", "edge", "level", F.col("neighbour").alias("coarse"), _edge_place("edge", "r", degree).cast("int").alias("k"), _edge_place("neighbour_edge", "c", degree).cast("int").alias("from_k"), "w"), "asks")
    rows = materialise(coefficients.select("leaf", F.col("k").cast("int").alias("k"), "z").join(level_of, "leaf"), "coefficients")
    out = above = rows.where(F.col("level") == levels[0])
    for level in levels[1:]:
        held = above.select(F.col("leaf").alias("coarse"), F.col("k").alias("from_k"), "z")
        sums = asks.where(F.col("level") == level).join(held, ["coarse", "from_k"]).groupBy("leaf", "k", "edge").agg(F.sum(F.col("w") * F.col("z")).alias("new"))
        new = sums.groupBy("leaf", "k").agg(F.max(F.struct("edge", "new"))["new"].alias("new"))
        above = materialise(rows.where(F.col("level") == level).join(new, ["leaf", "k"], "left").select("leaf", "k", F.coalesce("new", "z").alias("z"), "level"), "level")
        out = out.unionByName(above)
    return out.select("leaf", "k", "z")
