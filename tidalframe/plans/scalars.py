"""Queries of pointwise formulas: each is one projection over one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidalframe.functions import basis, dynamics, flux, morton, raster, seawater, sigma
from tidalframe.functions.dual import COLUMN, SQL, Text
from tidalframe.plans import published

#: Inputs as (table, select list); the list is valid in both engines.
WATER = ("part", ["p_partkey AS id", "p_size * 0.5e0 AS t", "30e0 + p_retailprice / 500e0 AS s", "CAST(p_partkey % 5000 AS DOUBLE) AS p"])
SIGMA = ("orders", ["o_orderkey AS id", "-CAST(o_orderkey % 101 AS DOUBLE) / 100e0 AS s", "CAST(o_custkey % 7 AS DOUBLE) / 11e0 - 0.3e0 AS eta", "CAST(o_custkey % 400 AS DOUBLE) / 7e0 AS h", "CAST(o_orderkey % 13 AS DOUBLE) / 103e0 AS de", "CAST(o_orderkey % 17 AS DOUBLE) / 50e0 AS dh"])
GRID = ("lineitem", ["l_orderkey AS id", "l_partkey AS ix", "l_suppkey AS iy", "CAST(l_linenumber AS BIGINT) AS iz", "CAST(l_partkey AS DOUBLE) AS x", "CAST(l_suppkey AS DOUBLE) AS y", "l_quantity AS u", "l_discount * 10e0 AS v", "l_extendedprice / 1000e0 AS depth"])
FACE = ("lineitem", ["l_orderkey AS id", "l_quantity / 10e0 AS hl", "l_tax * 10e0 AS hul", "l_discount * 5e0 AS hvl", "l_extendedprice / 20000e0 AS hr", "l_discount * 20e0 - 1e0 AS hur", "l_tax * 5e0 AS hvr", "0.6e0 AS nx", "0.8e0 AS ny"])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, source: tuple[str, list[str]], keys: list[str], outputs: Callable, digits: int = 9, stages: tuple[Callable, ...] = ()) -> None:
    """Register a projection: ``outputs(m)`` maps names to expressions over the source's columns.

    ``stages`` name intermediate columns first, so that large formulas don't repeat them.
    """
    table, columns = source

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
        for stage in stages:
            rows = rows.withColumns(stage(COLUMN))
        return rows.select(*keys, *[(COLUMN.round(e, digits) if d else e).alias(n) for n, (e, d) in outputs(COLUMN).items()])

    QUERIES[name] = run
    fields = ", ".join([*keys, *[f"{SQL.round(e, digits) if d else Text.of(e)} AS {n}" for n, (e, d) in outputs(SQL).items()]])
    inner = f"SELECT {', '.join(columns)} FROM {table}"
    for stage in stages:
        inner = f"SELECT *, {', '.join(f'{Text.of(e)} AS {n}' for n, e in stage(SQL).items())} FROM ({inner}) AS source"
    ORACLE_SQL[name] = f"SELECT {fields} FROM ({inner}) AS source"


def _water(m):
    return m.col("t"), m.col("s"), m.col("p")


for _law in ("linear", "unesco", "jackett"):
    _add(f"eos_{_law}", WATER, ["id"], lambda m, law=_law: {"rho": (seawater.LAWS[law](m, *_water(m)), True), "anomaly": (seawater.anomaly(m, law, *_water(m)), True), "potential": (seawater.potential_density(m, law, m.col("t"), m.col("s")), True)}, 6)
_add("eos_derivatives", WATER, ["id"], lambda m: {"alpha": (seawater.thermal_expansion(m, "unesco", *_water(m)), True), "beta": (seawater.haline_contraction(m, "unesco", *_water(m)), True), "kappa": (seawater.compressibility(m, "unesco", *_water(m)), True)}, 8)
_add("sound_speed", WATER, ["id"], lambda m: {"c": (seawater.sound_speed(m, *_water(m)), True)}, 6)


def _sigma(m):
    s, eta, h, de, dh = (m.col(c) for c in ("s", "eta", "h", "de", "dh"))
    z = sigma.to_z(m, s, eta, h)
    return {
        "z": (z, True), "back": (sigma.to_sigma(m, z, eta, h), True), "ds_dz": (sigma.dsigma_dz(m, eta, h), True), "ds_dx": (sigma.slope(m, s, eta, h, de, dh), True),
        "ds_dt": (sigma.tendency(m, s, eta, h, de), True), "dz_dx": (sigma.z_slope(m, s, de, dh), True), "dz_dt": (sigma.z_tendency(m, s, de), True),
    }


_add("sigma_transform", SIGMA, ["id"], _sigma, 8)
_add("sigma_stretch", SIGMA, ["id"], lambda m: {k: (sigma.stretch(m, k, m.col("s"), 5.0, 0.4), True) for k in ("uniform", "surface", "bottom", "surface_bottom", "roms")}, 8)
_add("sigma_stretch_derivative", SIGMA, ["id"], lambda m: {k: (sigma.stretch_derivative(m, k, m.col("s"), 3.0, 0.4), True) for k in ("surface", "bottom", "roms")}, 4)
_add("morton_encode", GRID, ["id", "ix", "iy", "iz"], lambda m: {"code": (morton.encode(m, m.col("ix"), m.col("iy"), m.col("iz")), False)})
_add("morton_decode", GRID, ["id", "ix", "iy"], lambda m: {"x": (morton.decode(m, m.col("ix") * 512 + m.col("iy"), 0), False), "y": (morton.decode(m, m.col("ix") * 512 + m.col("iy"), 1), False)})
_add("morton_parent", GRID, ["id", "ix"], lambda m: {"up": (morton.parent(m, m.col("ix")), False), "first": (morton.child(m, m.col("ix"), 0), False), "last": (morton.child(m, m.col("ix"), 7), False)})
_add("refine_mask_bits", GRID, ["id", "ix", "iy", "iz"], lambda m: {"mask": (morton.mask_to_reach(m, (m.bit_and(m.col("ix"), 7), m.bit_and(m.col("iy"), 7), m.col("iz")), (m.col("iz"), m.bit_and(m.col("ix"), 3), m.bit_and(m.col("iy"), 3))), False), "children": (morton.children_of_mask(m, m.bit_and(m.col("ix"), 7)), False)})
_add("level_balance", GRID, ["id", "ix", "iy", "iz"], lambda m: {"balanced": (m.when(morton.balanced(m, (m.bit_and(m.col("ix"), 3), m.bit_and(m.col("iy"), 3), m.col("iz")), (m.col("iz"), m.col("iz"), m.bit_and(m.col("ix"), 3))), 1, 0), False), "top": (m.greatest(m.bit_and(m.col("ix"), 3), m.bit_and(m.col("iy"), 3), m.col("iz")), False), "low": (m.least(m.bit_and(m.col("ix"), 3), m.bit_and(m.col("iy"), 3), m.col("iz")), False)})
_add("smoothstep_relax", GRID, ["id", "x", "y"], lambda m: {"factor": (dynamics.relaxation(m, m.col("x"), m.col("y"), (0.0, 2000.0, 0.0, 100.0), 40.0, 0.1), True)})
_add("coriolis_beta", GRID, ["id", "y"], lambda m: {"f": (dynamics.coriolis(m, m.col("y"), 1.0e-2, 2.0e-4, 50.0), True)})


def _friction(m):
    out = {}
    for kind, cd in (("linear", 0.5), ("quadratic", 0.25), ("manning", 0.25)):
        tx, ty = dynamics.friction(m, kind, m.col("u"), m.col("v"), m.col("depth"), cd)
        out |= {f"{kind}_x": (tx, True), f"{kind}_y": (ty, True)}
    return out | {"wind": (dynamics.wind_forcing(m, m.col("u"), m.col("depth"), 1.0), True)}


_add("friction_laws", GRID, ["id"], _friction, 6)
_add("derived_velocity", GRID, ["id"], lambda m: {"velocity": (dynamics.velocity(m, m.col("u"), m.col("depth")), True), "w": (dynamics.vertical_velocity(m, m.col("v"), m.col("v") - 1.0, m.col("depth"), m.col("u"), m.col("v"), m.col("x"), m.col("y"), m.col("v")), True)}, 6)
_add("cfl_dt", GRID, ["id"], lambda m: {"dt": (dynamics.cfl_step(m, dynamics.wave_speed(m, m.col("u"), m.col("depth")), m.col("x"), 0.5, 0.01, 60.0), True), "next": (dynamics.error_step(m, m.col("v"), m.col("depth") / 100.0, 0.05, 0.01, 60.0), True)}, 6)
_add("unit_parameter", GRID, ["id"], lambda m: {"s": (dynamics.unit_parameter(m, m.col("x"), 100.0, 500.0), True)})


def _flux(law):
    def outputs(m):
        left, right = ([m.col(f"{c}{side}") for c in ("h", "hu", "hv")] for side in "lr")
        return {f"f{k}": (e, True) for k, e in enumerate(law(m, left, right, m.col("nx"), m.col("ny")))}

    return outputs


for _name, _law in (("central", flux.central), ("llf", flux.lax_friedrichs), ("roe", flux.roe)):
    _add(f"flux_{_name}", FACE, ["id"], _flux(_law), 7)


def _primitives(m):
    out = {}
    for at in "lr":
        found = flux.primitives(m, *(m.col(f"{c}{at}") for c in ("h", "hu", "hv")), m.col("nx"), m.col("ny"))
        out |= {f"{k}_{at}": e for k, e in found.items()}
    return out


def _both(m):
    return [flux.side({k: m.col(f"{k}_{at}") for k in ("h", "u", "v", "un", "c")}, m.col(f"hu{at}"), m.col(f"hv{at}"), m.col("nx"), m.col("ny")) for at in "lr"]


_add(
    "flux_hllc", FACE, ["id"],
    lambda m: {f"f{k}": (e, True) for k, e in enumerate(flux.hllc_flux(m, *_both(m), m.col("low"), m.col("high"), m.col("mid"), m.col("nx"), m.col("ny")))}, 7,
    stages=(_primitives, lambda m: dict(zip(("low", "high", "mid"), flux.hllc_speeds(m, *_both(m)), strict=True))),
)
_add("flux_upwind", FACE, ["id"], lambda m: {"f": (flux.upwind(m, m.col("hl"), m.col("hr"), m.col("hur"), m.col("hvl"), m.col("nx"), m.col("ny")), True)}, 7)

_CUBIC = ("lineitem", ["l_orderkey AS id", "l_discount * 67e0 / 7e0 AS u", "l_tax * 86e0 / 7e0 AS v", "l_quantity / 3e0 AS q", "l_extendedprice / 1013e0 AS z"])


def _bezier(m):
    u, v = m.col("u"), m.col("v")
    value = slope = None
    for k in range(16):
        c = m.col("q") + m.col("z") * float(k % 5) - float(k // 4)
        one, two = c * basis.tensor(m, 3, k, u, v), c * (basis.bernstein_slope(m, 3, k % 4, u) * basis.bernstein(m, 3, k // 4, v))
        value, slope = (one, two) if value is None else (value + one, slope + two)
    return {"value": (value, True), "slope": (slope, True)}


_add("bezier_surface", _CUBIC, ["id"], _bezier)
_add("bernstein_linear", _CUBIC, ["id"], lambda m: {f"b{k}": (basis.tensor(m, 1, k, m.col("u"), m.col("v")), True) for k in range(4)})
_add("bernstein_quintic", _CUBIC, ["id"], lambda m: {f"b{k}": (basis.bernstein(m, 5, k, m.col("u")), True) for k in range(6)} | {f"d{k}": (basis.bernstein_slope(m, 5, k, m.col("u")), True) for k in range(6)}, 7)

_GT = (100.0, 2.0, 0.25, 400.0, -0.5, -3.0)


def _georef(m):
    x, y = raster.pixel_to_world(m, m.col("x"), m.col("y"), _GT)
    px, py = raster.world_to_pixel(m, x, y, _GT)
    return {"wx": (x, True), "wy": (y, True), "px": (px, True), "py": (py, True)}


_add("georeference", GRID, ["id"], _georef, 6)
_add("land_mask", GRID, ["id"], lambda m: {"land": (m.when(raster.land(m, m.col("depth") - 30.0, -9999.0, True), 1, 0), False), "depth": (raster.depth(m, m.col("depth") - 30.0, -9999.0, True), True), "depth_up": (raster.depth(m, m.col("depth") - 30.0, -9999.0, False), True)}, 6)


def _project(m):
    lon, lat = raster.conic_to_lonlat(m, 3_500_000.0 + m.col("x") * 500.0, 2_500_000.0 + m.col("y") * 5000.0)
    return {"lon": (lon, True), "lat": (lat, True)}


_add("conic_to_lonlat", GRID, ["id", "ix", "iy"], _project, 7)

ORACLE_SQL |= {n: sql for n, sql in published.ORACLE_SQL.items() if n in QUERIES}
