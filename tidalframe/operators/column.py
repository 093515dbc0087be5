"""Vertical columns and element-local fields.

Fields are long relations (elem, i, j, k, value); a column is (elem, i, j), its order k from the
bottom. Windows never span columns, so they partition by them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions.basis import derivative_matrix, lagrange_table, lobatto

KEY = ["elem", "i", "j"]


def field(vectors: DataFrame, elem: str, values: str, order: int = 3) -> DataFrame:
    """(elem, i, j, k, v) from one array of (order + 1)**3 values per element, i fastest."""
    n = order + 1
    rows = vectors.select(F.col(elem).alias("elem"), F.posexplode(values).alias("p", "v"))
    return rows.select("elem", (F.col("p") % n).alias("i"), (F.floor(F.col("p") / n) % n).cast("int").alias("j"), F.floor(F.col("p") / (n * n)).cast("int").alias("k"), F.col("v").cast("double").alias("v"))


def by_k(values: Sequence[float]) -> Column:
    """A constant per level as an expression of k."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("k") + 1)


def depth_average(cells: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Weighted mean and sum of v over each column."""
    w = by_k(weights)
    return cells.groupBy(*KEY).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("mean"), F.sum(w * F.col("v")).alias("total"))


def deviation(cells: DataFrame, weights: Sequence[float]) -> DataFrame:
    """v less its column's mean, without a join: one window per column."""
    w, column = by_k(weights), Window.partitionBy(*KEY)
    return cells.select(*KEY, "k", (F.col("v") - F.sum(w * F.col("v")).over(column) / F.sum(w).over(column)).alias("v"))


def running_integral(cells: DataFrame, steps: Sequence[float]) -> DataFrame:
    """Trapezoid integral of v from the bottom up to each level; ``steps[k]`` leads from k - 1 to k."""
    up = Window.partitionBy(*KEY).orderBy("k")
    part = F.coalesce((F.col("v") + F.lag("v").over(up)) / 2.0 * by_k(steps), F.lit(0.0))
    rows = cells.select(*KEY, "k", "v", part.alias("part"))
    return rows.withColumn("integral", F.sum("part").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("part")


def omega(cells: DataFrame, steps: Sequence[float], depth: str | float, dry: float = 1e-10) -> DataFrame:
    """Velocity through sigma surfaces from the divergence v: minus its integral per depth, 0 at the bottom."""
    h = F.col(depth) if isinstance(depth, str) else F.lit(float(depth))
    return running_integral(cells, steps).select(*KEY, "k", F.when(h > dry, -F.col("integral") / h).otherwise(0.0).alias("omega"))


def pressure(cells: DataFrame, steps: Sequence[float], depth: float, gravity: float = 9.81) -> DataFrame:
    """Hydrostatic pressure of density v: its integral from each level up to the surface."""
    down = Window.partitionBy(*KEY).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*KEY).orderBy("k")
    step = F.lead(by_k(steps)).over(up)
    part = F.coalesce((F.col("v") + F.lead("v").over(up)) / 2.0 * step, F.lit(0.0))
    rows = cells.select(*KEY, "k", part.alias("part"))
    return rows.select(*KEY, "k", (gravity * depth * F.sum("part").over(down)).alias("p"))


def buoyancy(cells: DataFrame, height: Sequence[float], gravity: float = 9.81) -> DataFrame:
    """Squared buoyancy frequency of density v: central differences, the ends take their neighbour's."""
    up = Window.partitionBy(*KEY).orderBy("k")
    z = by_k(height)
    dz = F.lead(z).over(up) - F.lag(z).over(up)
    slope = F.when(F.abs(dz) < 1e-10, 0.0).otherwise((F.lead("v").over(up) - F.lag("v").over(up)) / dz)
    inner = cells.select(*KEY, "k", F.when(dz.isNotNull(), F.when(F.abs(dz) < 1e-10, 0.0).otherwise(-gravity * slope / F.col("v"))).alias("n2"))
    return inner.select(*KEY, "k", F.coalesce("n2", F.lead("n2").over(up), F.lag("n2").over(up)).alias("n2"))


def gradient(cells: DataFrame, order: int = 3) -> DataFrame:
    """Reference derivatives of v along i, j and k at every node: three partial sums, no join."""
    d = derivative_matrix(lobatto(order + 1)[0])
    out = None
    for axis, name in (("i", "di"), ("j", "dj"), ("k", "dk")):
        rest = ["elem", *[c for c in ("i", "j", "k") if c != axis]]
        line = cells.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("a"), "v"))), lambda s: s["v"]).alias("line"))
        rows = F.array(*[F.struct(F.lit(r).alias(axis), sum((F.lit(float(d[r, c])) * F.element_at("line", c + 1) for c in range(order + 1)), F.lit(0.0)).alias("s")) for r in range(order + 1)])
        part = line.select(*rest, F.explode(rows).alias("x")).select(*rest, f"x.{axis}", F.col("x.s").alias(name))
        out = part if out is None else out.join(part, ["elem", "i", "j", "k"])
    return out


def directional_mask(cells: DataFrame, factor: float = 0.5) -> DataFrame:
    """(elem, gx, gy, gz, mask): per axis the widest range along a line; axes above ``factor`` of the widest."""
    parts = None
    for axis, name in (("i", "gx"), ("j", "gy"), ("k", "gz")):
        rest = [c for c in ("i", "j", "k") if c != axis]
        lines = cells.groupBy("elem", *rest).agg((F.max("v") - F.min("v")).alias("r")).groupBy("elem").agg(F.max("r").alias(name))
        parts = lines if parts is None else parts.join(lines, "elem")
    top = F.greatest("gx", "gy", "gz")
    bits = sum((F.when(F.col(c) > factor * top, b).otherwise(0) for c, b in (("gx", 1), ("gy", 2), ("gz", 4))), F.lit(0))
    return parts.select("elem", "gx", "gy", "gz", bits.alias("mask"))


def diagnostics(state: DataFrame, gravity: float = 9.81) -> DataFrame:
    """One row over a state (elem, h, u, v, eta): mass, energy, fastest velocity, range of eta, wave speed.

    The fastest velocity joins the largest components of one element.
    """
    per = state.groupBy("elem").agg(
        F.sum("h").alias("mass"), F.sum(0.5 * F.col("h") * (F.col("u") ** 2 + F.col("v") ** 2) + 0.5 * gravity * F.col("eta") ** 2).alias("energy"),
        F.sqrt(F.max(F.col("u") * F.col("u")) + F.max(F.col("v") * F.col("v"))).alias("speed"), F.min("eta").alias("lo"), F.max("eta").alias("hi"),
        (F.sqrt(gravity * F.greatest(F.max("h"), F.lit(0.0))) + F.greatest(F.max(F.abs("u")), F.max(F.abs("v")))).alias("wave"),
    )
    return per.agg(F.sum("mass").alias("mass"), F.sum("energy").alias("energy"), F.max("speed").alias("max_velocity"), F.min("lo").alias("eta_min"), F.max("hi").alias("eta_max"), F.max("wave").alias("wave_speed"))


def child_nodes(order: int = 3) -> np.ndarray:
    """(2, order + 1, order + 1): values at each half's nodes from those of the whole interval."""
    x = lobatto(order + 1)[0]
    return np.stack([lagrange_table(x, (x - 1) / 2), lagrange_table(x, (x + 1) / 2)])


def refine_field(cells: DataFrame, axis: str, order: int = 3) -> DataFrame:
    """Both halves (``half`` 0 and 1) of every element along one axis, by interpolation."""
    table = child_nodes(order)
    rest = ["elem", *[c for c in ("i", "j", "k") if c != axis]]
    line = cells.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("a"), "v"))), lambda s: s["v"]).alias("line"))
    rows = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(r).alias(axis), sum((F.lit(float(table[h, r, c])) * F.element_at("line", c + 1) for c in range(order + 1)), F.lit(0.0)).alias("v")) for h in (0, 1) for r in range(order + 1)])
    return line.select(*rest, F.explode(rows).alias("x")).select("elem", "x.half", *[F.col(f"x.{c}") if c == axis else F.col(c) for c in ("i", "j", "k")], F.col("x.v").alias("v"))


def parent_nodes(order: int = 3) -> np.ndarray:
    """(2, order + 1, order + 1): a parent's nodes from each half's; a node belongs to the half that holds it, the middle to the upper one."""
    x = lobatto(order + 1)[0]
    upper = (x >= 0)[:, None]
    return np.stack([np.where(~upper, lagrange_table(x, 2 * x + 1), 0.0), np.where(upper, lagrange_table(x, 2 * x - 1), 0.0)])


def coarsen_field(cells: DataFrame, axis: str, order: int = 3) -> DataFrame:
    """(parent, i, j, k, v) from both halves (parent, half, i, j, k, v) along one axis, by injection; one partial sum, no join."""
    t = parent_nodes(order)
    at = {(h, c): [(r, float(t[h, r, c])) for r in range(order + 1) if t[h, r, c]] for h in (0, 1) for c in range(order + 1)}
    kind = "array<struct<r: int, w: double>>"
    parts = F.array().cast(kind)
    for (h, c), to in at.items():
        parts = F.when((F.col("half") == h) & (F.col(axis) == c), F.array(*[F.struct(F.lit(r).alias("r"), F.lit(w).alias("w")) for r, w in to]).cast(kind)).otherwise(parts)
    rest = [x for x in ("i", "j", "k") if x != axis]
    rows = cells.select("parent", *rest, "v", F.explode(parts).alias("x"))
    return rows.groupBy("parent", *rest, F.col("x.r").alias(axis)).agg(F.sum(F.col("x.w") * F.col("v")).alias("v"))


def linear_omega(columns: DataFrame, divergence: str, levels: int, depth: float, dry: float = 1e-10) -> DataFrame:
    """(elem, i, j, k, omega): a linear profile from 0 at the bottom to minus the divergence per depth at the top."""
    scale = -F.col(divergence) / depth if depth > dry else F.lit(0.0)
    at = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k")
    return columns.select("elem", "i", "j", at, scale.alias("s")).select("elem", "i", "j", "k", (F.col("k") / float(levels - 1) * F.col("s")).alias("omega"))


def cycle_mean(cycles: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, mean, n) of a value over the sub-cycles of a step."""
    return cycles.groupBy(*key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def mass(cells: DataFrame, order: int = 3, inverse: bool = False) -> DataFrame:
    """v times (or over) the quadrature weight of its node."""
    w = lobatto(order + 1)[1]
    at = lambda axis: F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(axis) + 1)
    weight = at("i") * at("j") * at("k")
    return cells.select("elem", "i", "j", "k", (F.col("v") / weight if inverse else F.col("v") * weight).alias("v"))


def face_values(cells: DataFrame, order: int = 3) -> DataFrame:
    """(elem, face, a, b, v): node values on the six faces, 0 and 1 across i, 2 and 3 across j, 4 and 5 across k."""
    sides = []
    for axis, (a, b), face in (("i", ("j", "k"), 0), ("j", ("i", "k"), 2), ("k", ("i", "j"), 4)):
        for end, f in ((0, face), (order, face + 1)):
            sides.append(F.when(F.col(axis) == end, F.struct(F.lit(f).alias("face"), F.col(a).alias("a"), F.col(b).alias("b"))))
    return cells.select("elem", F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull())).alias("s"), "v").select("elem", "s.*", "v")


def face_integral(faces: DataFrame, order: int = 3) -> DataFrame:
    """(elem, face, value): integrals of face values (elem, face, a, b, v) by the rule of their nodes."""
    w = [float(x) for x in lobatto(order + 1)[1]]
    return faces.groupBy("elem", "face").agg(F.sum(by_index("a", w) * by_index("b", w) * F.col("v")).alias("value"))


def by_index(name: str, values: Sequence[float]) -> Column:
    """A constant per value of an index column."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(name) + 1).cast("int"))


def mortar(face: DataFrame, half: int, along: str = "a", order: int = 3) -> DataFrame:
    """Values of a face at the nodes of one of its halves along an axis."""
    table = child_nodes(order)[half]
    other = "b" if along == "a" else "a"
    line = face.groupBy("elem", "face", other).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(along).alias("at"), "v"))), lambda s: s["v"]).alias("line"))
    rows = F.array(*[F.struct(F.lit(r).alias(along), sum((F.lit(float(table[r, c])) * F.element_at("line", c + 1) for c in range(order + 1)), F.lit(0.0)).alias("v")) for r in range(order + 1)])
    return line.select("elem", "face", other, F.explode(rows).alias("x")).select("elem", "face", F.col("x.a" if along == "a" else "a").alias("a"), F.col("x.b" if along == "b" else "b").alias("b"), F.col("x.v").alias("v"))


def interface_jumps(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(elem, face, a, b, inner, outer) of faces that meet: pairs are (elem, face, neighbour, neighbour_face)."""
    other = faces.select(F.col("elem").alias("neighbour"), F.col("face").alias("neighbour_face"), "a", "b", F.col("v").alias("outer"))
    return faces.join(pairs, ["elem", "face"]).join(other, ["neighbour", "neighbour_face", "a", "b"]).select("elem", "face", "a", "b", F.col("v").alias("inner"), "outer")


def lift(jumps: DataFrame, flux: Column, order: int = 3) -> DataFrame:
    """(elem, i, j, k, v): face contributions ``flux`` weighted and put on the face's nodes."""
    w = lobatto(order + 1)[1]
    at = lambda axis: F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(axis) + 1)
    end = F.when(F.col("face") % 2 == 1, order).otherwise(0)
    across = F.floor(F.col("face") / 2)
    i, j = F.when(across == 0, end).otherwise(F.col("a")), F.when(across == 1, end).when(across == 0, F.col("a")).otherwise(F.col("b"))
    k = F.when(across == 2, end).otherwise(F.col("b"))
    rows = jumps.select("elem", i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), (flux * at("a") * at("b")).alias("v"))
    return rows.groupBy("elem", "i", "j", "k").agg(F.sum("v").alias("v"))
