"""Fields on moving terrain-following elements: metrics, gradients at fixed height, divergence, mesh motion, boundary faces.

Node tables are (elem, i, j, k, ...); sigma is -1 at the bottom (k = 0) and 0 at the top. Derivatives come from
``column.gradient``; everything else is one projection over its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.functions.basis import derivative_matrix, lagrange_table, lobatto
from tidalframe.operators import column

DRY = 1e-10
NODE = ("elem", "i", "j", "k")
#: What lies beyond a boundary face, by kind; fixed values.
KINDS = ("dirichlet", "neumann", "periodic", "outflow", "inflow", "no_slip", "free_slip")


def levels(order: int = 3) -> list[float]:
    """Sigma at the nodes of a column, from the bottom up."""
    return [float(x - 1) / 2 for x in lobatto(order + 1)[0]]


def metrics(nodes: DataFrame, order: int = 3) -> DataFrame:
    """``nodes`` (..., eta, h, eta_x, eta_y, h_x, h_y, eta_t) with sigma, depth, its inverse (0 where dry) and the derivatives of sigma at fixed height."""
    s, depth = column.by_index("k", levels(order)), F.col("eta") + F.col("h")
    inverse = F.when(depth > DRY, 1.0 / depth).otherwise(0.0)
    rows = nodes.withColumns({"sigma": s, "depth": depth, "inverse": inverse})
    slope = lambda a: (F.col("sigma") * (F.col(f"eta_{a}") + F.col(f"h_{a}")) - F.col(f"eta_{a}")) * F.col("inverse")
    return rows.withColumns({"sigma_x": slope("x"), "sigma_y": slope("y"), "sigma_t": -(1.0 + F.col("sigma")) * F.col("eta_t") * F.col("inverse")})


def at_fixed_height(slopes: DataFrame, order: int = 3) -> DataFrame:
    """Adds ux, uy and uz to rows with reference derivatives di, dj, dk and ``metrics``."""
    return slopes.withColumns({"ux": F.col("di") - F.col("sigma_x") * F.col("dk"), "uy": F.col("dj") - F.col("sigma_y") * F.col("dk"), "uz": F.col("inverse") * F.col("dk")})


def divergence(flow: DataFrame, order: int = 3) -> DataFrame:
    """(node, divergence) of depth-weighted velocities hu, hv and the velocity omega through sigma surfaces."""
    parts = []
    for name, axis in (("hu", "di"), ("hv", "dj"), ("omega", "dk")):
        parts.append(column.gradient(flow.select(*NODE, F.col(name).alias("v")), order).select(*NODE, F.col(axis).alias(f"d_{name}")))
    joined = parts[0].join(parts[1], list(NODE)).join(parts[2], list(NODE))
    return joined.select(*NODE, (F.col("d_hu") + F.col("d_hv") + F.col("d_omega")).alias("divergence"))


def mesh_velocity(eta_t: Column, h_t: Column, sigma: Column) -> Column:
    """Vertical speed of the nodes as the surface and the bed move."""
    return eta_t + sigma * (eta_t + h_t)


def ale_correction(w_mesh: Column) -> Column:
    """What the motion of the mesh adds to the rate of change."""
    return -w_mesh * F.col("uz")


def material_rate(rate: Column, u: Column, v: Column, omega: Column, w_mesh: Column) -> Column:
    """The rate of change along the flow, with the mesh's motion taken off the velocity through sigma surfaces."""
    return rate + u * F.col("ux") + v * F.col("uy") + (omega - w_mesh * F.col("inverse")) * F.col("dk")


def heights(columns: DataFrame, stretched: Sequence[float]) -> DataFrame:
    """(elem, i, j, k, z): nodes between bed and surface, at the given sigma levels."""
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in stretched])).alias("k", "s")
    return columns.select("elem", "i", "j", "eta", "h", at).select(*NODE, (F.col("eta") + F.col("s") * (F.col("eta") + F.col("h"))).alias("z"))


def jacobian(z: DataFrame, dx: float, dy: float, order: int = 3) -> DataFrame:
    """(node, det) of the map from the reference cube to a box of dx by dy under nodes at heights z."""
    slopes = column.gradient(z.select(*NODE, F.col("z").alias("v")), order)
    return slopes.select(*NODE, (dx / 2 * (dy / 2) * F.col("dk")).alias("det"))


def geometry(nodes: DataFrame, order: int = 3) -> DataFrame:
    """(node, det, g00 .. g22) of the map from the reference cube to nodes (elem, i, j, k, x, y, z).

    Row r of the matrix is the derivative of x, y, z along reference axis r; g is its inverse, null where the map is singular. An element's
    nodes meet in one array, so there is one shuffle and no join.
    """
    n = order + 1
    d = derivative_matrix(lobatto(n)[0])
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in d])
    place = (F.col("k") * n + F.col("j")) * n + F.col("i")
    held = nodes.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "x", "y", "z"))).alias("line"))
    at = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in ((p % n, "i"), (p // n % n, "j"), (p // n**2, "k"))]) for p in range(n**3)])).alias("s")
    rows = held.select("elem", "line", at).select("elem", "s.*", "line")

    def slope(axis: str, stride: int, coordinate: str) -> Column:
        base = (F.col("k") * n + F.col("j")) * n + F.col("i") - F.col(axis) * stride
        out = F.lit(0.0)
        for c in range(n):
            out = out + F.get(F.get(table, F.col(axis)), F.lit(c)) * F.get("line", base + c * stride)[coordinate]
        return out

    j = {(r, c): f"j{r}{c}" for r in range(3) for c in range(3)}
    rows = rows.select(*NODE, *[slope("ijk"[r], n**r, "xyz"[c]).alias(name) for (r, c), name in j.items()])
    m = lambda r, c: F.col(j[(r % 3, c % 3)])
    cofactor = lambda r, c: m(r + 1, c + 1) * m(r + 2, c + 2) - m(r + 1, c + 2) * m(r + 2, c + 1)
    rows = rows.withColumn("det", m(0, 0) * cofactor(0, 0) + m(0, 1) * cofactor(0, 1) + m(0, 2) * cofactor(0, 2))
    return rows.select(*NODE, "det", *[F.when(F.col("det") != 0, cofactor(c, r) / F.col("det")).alias(f"g{r}{c}") for r in range(3) for c in range(3)])


def height_slopes(columns: DataFrame, stretched: Sequence[float]) -> DataFrame:
    """(elem, i, j, k, z_x, z_y): slopes of sigma surfaces from those of the surface and the bed (eta_x, eta_y, h_x, h_y)."""
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in stretched])).alias("k", "s")
    rows = columns.select("elem", "i", "j", "eta_x", "eta_y", "h_x", "h_y", at)
    return rows.select(*NODE, *[(F.col(f"eta_{a}") + F.col("s") * (F.col(f"eta_{a}") + F.col(f"h_{a}"))).alias(f"z_{a}") for a in "xy"])


def beyond(kind: Column, inner: Column, given: Column, momentum: bool = False) -> Column:
    """The state outside a boundary face: what is given, the inner state, or, for a velocity at a no-slip wall, its opposite."""
    out = F.when(kind.isin("dirichlet", "inflow"), F.coalesce(given, inner))
    return out.when(kind == "no_slip", -inner if momentum else inner).otherwise(inner) if momentum else out.otherwise(inner)


def boundary_lift(faces: DataFrame, kind: Column, given: Column, speed: Column, order: int = 3) -> DataFrame:
    """(elem, i, j, k, v): upwind flux through boundary faces (elem, face, a, b, v) put on their nodes."""
    outer = beyond(kind, F.col("v"), given, momentum=True)
    return column.lift(faces, speed * F.when(speed >= 0, F.col("v")).otherwise(outer), order)


def quarter(faces: DataFrame, order: int = 3) -> DataFrame:
    """(elem, face, part, a, b, v): values of a face at the nodes of its four quarters (part = lower or upper half along a, then b)."""
    out = None
    for one in (0, 1):
        half = column.mortar(faces, one, "a", order)
        for two in (0, 1):
            part = column.mortar(half, two, "b", order).withColumn("part", F.lit(one + 2 * two))
            out = part if out is None else out.unionByName(part)
    return out


def from_quarters(parts: DataFrame, order: int = 3) -> DataFrame:
    """(elem, face, a, b, v): the face values closest to those of its quarters, by integrals against the face's basis."""
    table, mass = column.child_nodes(order), nodal_mass(order)
    back = [np.linalg.solve(mass, table[h].T @ mass / 2).T.tolist() for h in (0, 1)]  # from node c of a half to node r of the face
    along = lambda bit, at: F.element_at(F.element_at(F.array(*[F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows]) for rows in back]), (bit + 1).cast("int")), (F.col(at) + 1).cast("int"))
    rows = parts.select("elem", "face", "v", along(F.col("part") % 2, "a").alias("wa"), along(F.floor(F.col("part") / 2), "b").alias("wb"))
    spread = rows.select("elem", "face", "v", F.posexplode("wa").alias("a", "x"), "wb").select("elem", "face", "v", "a", "x", F.posexplode("wb").alias("b", "y"))
    return spread.groupBy("elem", "face", "a", "b").agg(F.sum(F.col("x") * F.col("y") * F.col("v")).alias("v"))


def nodal_mass(order: int = 3) -> np.ndarray:
    """Integrals of products of two Lagrange polynomials on the nodes over [-1, 1], by a rule that is exact."""
    at, weight = np.polynomial.legendre.leggauss(order + 1)
    values = lagrange_table(lobatto(order + 1)[0], at)
    return values.T @ (weight[:, None] * values)
