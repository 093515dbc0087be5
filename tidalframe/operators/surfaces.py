"""Surfaces of tensor-product patches: samples, vertices that cells share, control points, nodal values.

Patches are rows with a box and an array of coefficients, x fastest. Small matrices are literals in the plan, so every
conversion is one projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.functions.basis import bernstein_table
from tidalframe.operators.fit import STRIPS, numbered


def _times(matrix: np.ndarray, values: str) -> Column:
    """The product of a constant matrix and an array column, as an array."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, F.col(values), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def bezier(patches: DataFrame, degree: int, n: int, key: str = "leaf", values: str = "coefficients") -> DataFrame:
    """(key, s, x, y, z): n x n points of each patch, corners included, row by row."""
    one = bernstein_table(degree, np.linspace(0, 1, n))
    rows = patches.select(key, "xmin", "xmax", "ymin", "ymax", F.posexplode(_times(np.kron(one, one), values)).alias("s", "z"))
    u, v = (F.col("s") % n) / float(n - 1), F.floor(F.col("s") / n) / float(n - 1)
    return rows.select(key, "s", (F.col("xmin") + u * (F.col("xmax") - F.col("xmin"))).alias("x"), (F.col("ymin") + v * (F.col("ymax") - F.col("ymin"))).alias("y"), "z", F.lit(n).alias("n"))


def welded(samples: DataFrame, tolerance: float, key: str = "leaf") -> tuple[DataFrame, DataFrame]:
    """(vertex, x, y, z) with points within the tolerance as one, and (key, quad, corners) of the samples' grids."""
    spot = samples.withColumns({"qx": F.round(F.col("x") / tolerance).cast("long"), "qy": F.round(F.col("y") / tolerance).cast("long")})
    ends = spot.agg(F.min("qy").alias("y0__"), F.max("qy").alias("y1__"))
    merged = spot.groupBy("qx", "qy").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.avg("z").alias("z")).crossJoin(F.broadcast(ends))  # one row
    strip = F.floor((F.col("qy") - F.col("y0__")) * STRIPS / (F.col("y1__") - F.col("y0__") + 1))
    vertices = numbered(merged, ["qy", "qx"], strip, "vertex")
    named = spot.join(vertices.select("qx", "qy", "vertex"), ["qx", "qy"]).groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("s", "vertex"))), lambda x: x["vertex"]).alias("v"))
    quad = F.posexplode(F.sequence(F.lit(0), (F.col("n") - 1) * (F.col("n") - 1) - 1)).alias("quad", "unused")
    low = (F.col("quad") % (F.col("n") - 1) + F.floor(F.col("quad") / (F.col("n") - 1)) * F.col("n")).cast("int")
    at = lambda k: F.element_at("v", (low + k + 1).cast("int"))
    cells = named.select(key, "n", "v", quad).select(key, "quad", F.array(at(F.lit(0)), at(F.lit(1)), at(F.col("n") + 1), at(F.col("n"))).alias("corners"))
    return vertices.select("vertex", "x", "y", "z"), cells


def control_points(patches: DataFrame, degree: int, key: str = "leaf", values: str = "coefficients") -> DataFrame:
    """(key, k, x, y, z) of each patch's control net."""
    n = degree + 1
    rows = patches.select(key, "xmin", "xmax", "ymin", "ymax", F.posexplode(values).alias("k", "z"))
    u, v = (F.col("k") % n) / float(degree), F.floor(F.col("k") / n) / float(degree)
    return rows.select(key, "k", (F.col("xmin") + u * (F.col("xmax") - F.col("xmin"))).alias("x"), (F.col("ymin") + v * (F.col("ymax") - F.col("ymin"))).alias("y"), "z")


def to_nodes(patches: DataFrame, degree: int, values: str = "coefficients") -> DataFrame:
    """``patches`` with ``values``: what they take at equidistant nodes."""
    one = bernstein_table(degree, np.linspace(0, 1, degree + 1))
    return patches.withColumn("values", _times(np.kron(one, one), values))


def from_nodes(patches: DataFrame, degree: int, values: str = "values") -> DataFrame:
    """``patches`` with ``values``: Bernstein coefficients from those at equidistant nodes."""
    one = np.linalg.inv(bernstein_table(degree, np.linspace(0, 1, degree + 1)))
    return patches.withColumn("values", _times(np.kron(one, one), values))


def hull_range(patches: DataFrame, key: str = "leaf", values: str = "coefficients") -> DataFrame:
    """(key, low, high): bounds of each patch by the convex hull of its coefficients."""
    return patches.select(key, F.array_min(values).alias("low"), F.array_max(values).alias("high"))
