"""Element-local tendencies of the hydrostatic equations in flux form.

Each element is one row with an array per field, (order + 1)**3 nodes, i fastest, k from the bottom. A derivative is an
array expression over constants, so the whole right side is one projection: no join, no
shuffle, no Python. Interface fluxes are added by ``column.interface_jumps`` and ``column.lift``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.functions.basis import derivative_matrix, lobatto

FIELDS = ("h", "u", "v", "omega", "eta", "t", "s", "f")


def derivative(values: str | Column, axis: int, order: int = 3) -> Column:
    """Derivative of a nodal array along axis 0 (i), 1 (j) or 2 (k), in reference coordinates."""
    n, stride = order + 1, (order + 1) ** axis
    flat = F.array(*[F.lit(float(x)) for x in derivative_matrix(lobatto(n)[0]).ravel()])
    a = F.col(values) if isinstance(values, str) else values

    def at(p: Column) -> Column:
        r = (F.floor(p / stride) % n).cast("int")
        out = None
        for c in range(n):
            term = F.element_at(flat, r * n + (c + 1)) * F.element_at(a, (p - r * stride + (c * stride + 1)).cast("int"))
            out = term if out is None else out + term
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), at)


def pointwise(combine, *arrays: str | Column) -> Column:
    """``combine`` of the values at each node."""
    columns = [F.col(a) if isinstance(a, str) else a for a in arrays]
    zipped = F.arrays_zip(*[c.alias(f"x{k}") for k, c in enumerate(columns)])
    return F.transform(zipped, lambda x: combine(*[x[f"x{k}"] for k in range(len(columns))]))


def _named(rows: DataFrame, **new: Column) -> DataFrame:
    return rows.withColumns(new)


def primitive(states: DataFrame, key: str, order: int = 3, gravity: float = 9.81, nu_h: float = 0.0, nu_v: float = 0.0, kappa: float = 0.0, weights: Sequence[float] | None = None) -> DataFrame:
    """(key, dhu, dhv, dht, dhs, deta) of states with an array for each of ``FIELDS``.

    Momentum: advection by (u, v, omega), rotation, surface slope, horizontal and vertical
    diffusion. Tracers: advection and vertical diffusion. Surface: divergence of the transport
    summed over the column with ``weights`` (those of the nodes by default), the same at all levels.
    """
    n = order + 1
    w = list(lobatto(n)[1] / 2) if weights is None else list(weights)
    times = lambda *x: pointwise(lambda *y: _product(y), *x)
    rows = _named(states, hu=times("h", "u"), hv=times("h", "v"), ht=times("h", "t"), hs=times("h", "s"))
    rows = _named(rows, **{f"{q}_{a}": times(q, a) for q in ("hu", "hv", "ht", "hs") for a in ("u", "v", "omega")})
    rows = _named(rows, **{f"d_{q}": pointwise(lambda x, y, z: x + y + z, derivative(f"{q}_u", 0, order), derivative(f"{q}_v", 1, order), derivative(f"{q}_omega", 2, order)) for q in ("hu", "hv", "ht", "hs")})
    rows = _named(rows, ex=derivative("eta", 0, order), ey=derivative("eta", 1, order))
    for q in ("u", "v", "t", "s"):
        first = {f"{q}_z": derivative(q, 2, order)} | ({f"{q}_x": derivative(q, 0, order), f"{q}_y": derivative(q, 1, order)} if q in "uv" else {})
        rows = _named(rows, **first)
        second = {f"{q}_zz": derivative(f"{q}_z", 2, order)} | ({f"{q}_xx": derivative(f"{q}_x", 0, order), f"{q}_yy": derivative(f"{q}_y", 1, order)} if q in "uv" else {})
        rows = _named(rows, **second)
    thin = lambda h, x: F.when(h > 1e-10, x / h).otherwise(0.0)

    def momentum(q: str, turn: Column, slope: str, name: str) -> Column:
        return pointwise(lambda d, r, h, e, xx, yy, zz: -d + r - gravity * h * e + nu_h * h * (xx + yy) + nu_v * thin(h, zz), f"d_{q}", turn, "h", slope, f"{name}_xx", f"{name}_yy", f"{name}_zz")

    column = lambda q, p: sum((F.lit(float(w[k])) * F.element_at(F.col(q), (p % (n * n) + (k * n * n + 1)).cast("int")) for k in range(n)), F.lit(0.0))
    nodes = F.sequence(F.lit(0), F.lit(n**3 - 1))
    rows = _named(rows, hu_bar=F.transform(nodes, lambda p: column("hu", p)), hv_bar=F.transform(nodes, lambda p: column("hv", p)))
    return rows.select(
        key,
        momentum("hu", times("f", "hv"), "ex", "u").alias("dhu"),
        momentum("hv", pointwise(lambda f, q: -f * q, "f", "hu"), "ey", "v").alias("dhv"),
        *[pointwise(lambda d, h, zz: -d + kappa * thin(h, zz), f"d_h{q}", "h", f"{q}_zz").alias(f"dh{q}") for q in ("t", "s")],
        pointwise(lambda x, y: -(x + y), derivative("hu_bar", 0, order), derivative("hv_bar", 1, order)).alias("deta"),
    )


def _product(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out * v
    return out
