"""Hand-written SQL of the published laws, apart from the formulas that the queries are built of.

Polynomials are written out by powers, fluxes in matrix or wave form, so a slip in ``functions`` shows.
"""

from __future__ import annotations

_WATER = "w AS (SELECT p_partkey AS id, p_size * 0.5e0 AS t, 30e0 + p_retailprice / 500e0 AS s, (p_partkey % 5000)::DOUBLE AS p FROM part)"


def _surface(last: str) -> str:
    return f"""(999.842594e0 + 6.793952e-2 * t - 9.095290e-3 * t ** 2 + 1.001685e-4 * t ** 3 - 1.120083e-6 * t ** 4 + {last} * t ** 5
        + s * (8.24493e-1 - 4.0899e-3 * t + 7.6438e-5 * t ** 2 - 8.2467e-7 * t ** 3 + 5.3875e-9 * t ** 4) + s ** 1.5e0 * (-5.72466e-3 + 1.0227e-4 * t - 1.6546e-6 * t ** 2) + 4.8314e-4 * s ** 2)"""


_UNESCO = f"""CASE WHEN p <= 0 THEN {_surface('6.536332e-9')} ELSE {_surface('6.536332e-9')} / (1e0 - p / 10e0 / (
        19652.21e0 + 148.4206e0 * t - 2.327105e0 * t ** 2 + 1.360477e-2 * t ** 3 - 5.155288e-5 * t ** 4 + s * (54.6746e0 - 0.603459e0 * t + 1.09987e-2 * t ** 2 - 6.1670e-5 * t ** 3)
        + s ** 1.5e0 * (7.944e-2 + 1.6483e-2 * t - 5.3009e-4 * t ** 2)
        + p / 10e0 * (3.239908e0 + 1.43713e-3 * t + 1.16092e-4 * t ** 2 - 5.77905e-7 * t ** 3 + s * (2.2838e-3 - 1.0981e-5 * t - 1.6078e-6 * t ** 2) + 1.91075e-4 * s ** 1.5e0)
        + (p / 10e0) ** 2 * (8.50935e-5 - 6.12293e-6 * t + 5.2787e-8 * t ** 2 + s * (-9.9348e-7 + 2.0816e-8 * t + 9.1697e-10 * t ** 2)))) END"""
_JACKETT = f"""CASE WHEN p <= 0 THEN {_surface('6.536336e-9')} ELSE {_surface('6.536336e-9')} / (1e0 - p / 10e0 / (19652.21e0 + 148.4206e0 * t - 2.327105e0 * t ** 2 + 1.360477e-2 * t ** 3
        + s * (54.6746e0 - 0.603459e0 * t + 1.09987e-2 * t ** 2) + p / 10e0 * (3.239908e0 + 1.43713e-3 * t + 1.16092e-4 * t ** 2) + 8.50935e-5 * (p / 10e0) ** 2)) END"""


def _law(rho: str, deep: str | None = None) -> str:
    return f"""WITH {_WATER}, every AS (SELECT id, t, s, p, 'here' AS place FROM w UNION ALL SELECT id, t, s, 0e0, 'top' FROM w), r AS (SELECT id, place, {rho} AS rho FROM every)
    SELECT id, round(any_value(rho) FILTER (place = 'here'), 6) + 0e0 AS rho, round(any_value(rho) FILTER (place = 'here') - 1000e0, 6) + 0e0 AS anomaly, round(any_value(rho) FILTER (place = 'top'), 6) + 0e0 AS potential FROM r GROUP BY id"""


_DERIVATIVES = f"""WITH {_WATER}, v(kind, dt, ds, dp) AS (VALUES ('c', 0e0, 0e0, 0e0), ('t+', 0.01e0, 0e0, 0e0), ('t-', -0.01e0, 0e0, 0e0), ('s+', 0e0, 0.01e0, 0e0), ('s-', 0e0, -0.01e0, 0e0), ('p+', 0e0, 0e0, 1e0), ('p-', 0e0, 0e0, -1e0)),
    spot AS (SELECT id, kind, t + dt AS t, s + ds AS s, greatest(0e0, p + dp) AS p FROM w, v), r AS (SELECT id, kind, {_UNESCO} AS rho FROM spot),
    k AS (SELECT id, max(rho) FILTER (kind = 'c') AS c, max(rho) FILTER (kind = 't+') AS tu, max(rho) FILTER (kind = 't-') AS td, max(rho) FILTER (kind = 's+') AS su, max(rho) FILTER (kind = 's-') AS sd, max(rho) FILTER (kind = 'p+') AS pu, max(rho) FILTER (kind = 'p-') AS pd FROM r GROUP BY id)
    SELECT id, round(-(tu - td) / 0.02e0 / c, 8) + 0e0 AS alpha, round((su - sd) / 0.02e0 / c, 8) + 0e0 AS beta, round((pu - pd) / 2e0 / c, 8) + 0e0 AS kappa FROM k"""

_SIGMA = """x AS (SELECT o_orderkey AS id, -(o_orderkey % 101)::DOUBLE / 100e0 AS s, (o_custkey % 7)::DOUBLE / 11e0 - 0.3e0 AS eta, (o_custkey % 400)::DOUBLE / 7e0 AS h, (o_orderkey % 13)::DOUBLE / 103e0 AS de, (o_orderkey % 17)::DOUBLE / 50e0 AS dh FROM orders)"""
_TRANSFORM = f"""WITH {_SIGMA}, y AS (SELECT *, h + eta AS d, eta * (1e0 + s) + s * h AS z FROM x)
    SELECT id, round(z, 8) + 0e0 AS z, round(CASE WHEN d < 1e-10 THEN -0.5e0 ELSE (z - eta) / d END, 8) + 0e0 AS back, round(CASE WHEN d > 1e-10 THEN 1e0 / d ELSE 0e0 END, 8) + 0e0 AS ds_dz,
        round(CASE WHEN d < 1e-10 THEN 0e0 ELSE -(de * (1e0 + s) + s * dh) / d END, 8) + 0e0 AS ds_dx, round(CASE WHEN d < 1e-10 THEN 0e0 ELSE -(1e0 + s) * de / d END, 8) + 0e0 AS ds_dt,
        round(de * (1e0 + s) + s * dh, 8) + 0e0 AS dz_dx, round(de + s * de, 8) + 0e0 AS dz_dt FROM y"""


def _bottom(s: str, b: str) -> str:
    return f"((exp({b} * ({s} + 1e0)) - 1e0) / (exp({b}) - 1e0) - 1e0)"


def _top(s: str, a: str) -> str:
    return f"((exp({a} * {s}) - exp(-{a} * {s})) / (exp({a}) - exp(-{a})))"


def _roms(s: str, a: str, b: str) -> str:
    cosh = lambda x: f"((exp({x}) + exp(-({x}))) / 2e0)"
    return f"(({s} + 1e0) * (1e0 - {cosh(f'{a} * {s}')}) / ({cosh(a)} - 1e0) - {s} * {_bottom(s, b)})"


_SHARE = "(0.4e0 * ((exp(5e0) + exp(-5e0)) / 2e0 - 1e0) / ((exp(5e0) + exp(-5e0)) / 2e0 + 1e0))"
_STRETCH = f"""WITH {_SIGMA} SELECT id, round(s, 8) + 0e0 AS uniform, round({_top('s', '5e0')}, 8) + 0e0 AS surface, round({_bottom('s', '0.4e0')}, 8) + 0e0 AS bottom,
    round({_top('s', '5e0')} + {_SHARE} * ({_bottom('s', '0.4e0')} - {_top('s', '5e0')}), 8) + 0e0 AS surface_bottom, round({_roms('s', '5e0', '0.4e0')}, 8) + 0e0 AS roms FROM x"""
_SLOPES = f"""WITH {_SIGMA}, y AS (SELECT id, least(s + 1e-6, 0e0) AS a, greatest(s - 1e-6, -1e0) AS b FROM x)
    SELECT id, round(({_top('a', '3e0')} - {_top('b', '3e0')}) / (a - b), 4) + 0e0 AS surface, round(({_bottom('a', '0.4e0')} - {_bottom('b', '0.4e0')}) / (a - b), 4) + 0e0 AS bottom, round(({_roms('a', '3e0', '0.4e0')} - {_roms('b', '3e0', '0.4e0')}) / (a - b), 4) + 0e0 AS roms FROM y"""

_FACE = """raw AS (SELECT l_orderkey AS id, l_quantity / 10e0 AS h1, l_tax * 10e0 AS mx1, l_discount * 5e0 AS my1, l_extendedprice / 20000e0 AS h2, l_discount * 20e0 - 1e0 AS mx2, l_tax * 5e0 AS my2, 0.6e0 AS nx, 0.8e0 AS ny FROM lineitem),
    st AS (SELECT *, (mx1 * nx + my1 * ny) / h1 AS n1, (mx2 * nx + my2 * ny) / h2 AS n2, sqrt(9.81e0 * h1) AS c1, sqrt(9.81e0 * h2) AS c2, 9.81e0 * h1 ** 2 / 2e0 AS p1, 9.81e0 * h2 ** 2 / 2e0 AS p2 FROM raw),
    fl AS (SELECT *, h1 * n1 AS a0, h2 * n2 AS b0, mx1 * n1 + p1 * nx AS a1, mx2 * n2 + p2 * nx AS b1, my1 * n1 + p1 * ny AS a2, my2 * n2 + p2 * ny AS b2 FROM st)"""


def _flux(*parts: str, more: str = "", source: str = "fl") -> str:
    return f"WITH {_FACE}{more} SELECT id, {', '.join(f'round({e}, 7) + 0e0 AS f{k}' for k, e in enumerate(parts))} FROM {source}"


_SPEED = "greatest(abs(n1) + c1, abs(n2) + c2)"
_ROE = """, ro AS (SELECT *, (h1 + h2) / 2e0 AS h, (mx1 / sqrt(h1) + mx2 / sqrt(h2)) / (sqrt(h1) + sqrt(h2)) AS u, (my1 / sqrt(h1) + my2 / sqrt(h2)) / (sqrt(h1) + sqrt(h2)) AS v FROM fl),
    rw AS (SELECT *, u * nx + v * ny AS un, sqrt(9.81e0 * h) AS c, h2 - h1 AS dh, n2 - n1 AS dn, (my2 * nx - mx2 * ny) / h2 - (my1 * nx - mx1 * ny) / h1 AS dt FROM ro),
    rl AS (SELECT *, CASE WHEN abs(un - c) < 0.1e0 * c THEN ((un - c) ** 2 / (0.1e0 * c) + 0.1e0 * c) / 2e0 ELSE abs(un - c) END AS l1, CASE WHEN abs(un + c) < 0.1e0 * c THEN ((un + c) ** 2 / (0.1e0 * c) + 0.1e0 * c) / 2e0 ELSE abs(un + c) END AS l3 FROM rw),
    rk AS (SELECT *, l1 * (dh - h * dn / c) / 2e0 AS k1, abs(un) * h * dt AS k2, l3 * (dh + h * dn / c) / 2e0 AS k3 FROM rl)"""
_HLLC = """, wv AS (SELECT *, least(n1 - c1, n2 - c2) AS sl, greatest(n1 + c1, n2 + c2) AS sr FROM fl),
    md AS (SELECT *, h1 * (sl - n1) - h2 * (sr - n2) AS den, h1 * n1 * (sl - n1) - h2 * n2 * (sr - n2) + p2 - p1 AS num FROM wv), mm AS (SELECT *, CASE WHEN abs(den) > 1e-10 THEN num / den ELSE (n1 + n2) / 2e0 END AS sm FROM md),
    ss AS (SELECT *, h1 * (sl - n1) / CASE WHEN sl = sm THEN 1e0 ELSE sl - sm END AS g1, h2 * (sr - n2) / CASE WHEN sr = sm THEN 1e0 ELSE sr - sm END AS g2 FROM mm)"""


def _hllc(k: int) -> str:
    q = {0: ("h1", "h2"), 1: ("mx1", "mx2"), 2: ("my1", "my2")}[k]
    n = {0: None, 1: "nx", 2: "ny"}[k]
    star = [f"g{j}" if n is None else f"g{j} * ({q[j - 1]} / h{j} + (sm - n{j}) * {n})" for j in (1, 2)]
    return f"CASE WHEN sl >= 0 THEN a{k} WHEN sr <= 0 THEN b{k} WHEN sm >= 0 THEN a{k} + sl * ({star[0]} - {q[0]}) ELSE b{k} + sr * ({star[1]} - {q[1]}) END"


ORACLE_SQL: dict[str, str] = {
    "eos_linear": _law("1025e0 * (1e0 - 2e-4 * (t - 10e0) + 7.6e-4 * (s - 35e0))"),
    "eos_unesco": _law(_UNESCO),
    "eos_jackett": _law(_JACKETT),
    "eos_derivatives": _DERIVATIVES,
    "sound_speed": f"WITH {_WATER} SELECT id, round(1449.2e0 + 4.6e0 * t - 5.5e-2 * t ** 2 + 2.9e-4 * t ** 3 + (1.34e0 - 1e-2 * t) * (s - 35e0) + 1.6e-2 * p, 6) + 0e0 AS c FROM w",
    "sigma_transform": _TRANSFORM,
    "sigma_stretch": _STRETCH,
    "sigma_stretch_derivative": _SLOPES,
    "flux_central": _flux("(a0 + b0) / 2e0", "(a1 + b1) / 2e0", "(a2 + b2) / 2e0"),
    "flux_llf": _flux(*(f"(a{k} + b{k} - {_SPEED} * ({r} - {q})) / 2e0" for k, (q, r) in enumerate((("h1", "h2"), ("mx1", "mx2"), ("my1", "my2"))))),
    "flux_roe": _flux("(a0 + b0 - k1 - k3) / 2e0", "(a1 + b1 - k1 * (u - c * nx) + k2 * ny - k3 * (u + c * nx)) / 2e0", "(a2 + b2 - k1 * (v - c * ny) - k2 * nx - k3 * (v + c * ny)) / 2e0", more=_ROE, source="rk"),
    "flux_hllc": _flux(*(_hllc(k) for k in range(3)), more=_HLLC, source="ss"),
    "flux_upwind": f"WITH {_FACE} SELECT id, round((mx2 * nx + my1 * ny) * CASE WHEN mx2 * nx + my1 * ny >= 0 THEN h1 ELSE h2 END, 7) + 0e0 AS f FROM raw",
}

_N = "side AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM orders), s AS (SELECT i % n AS ix, i // n AS iy, (i % n) / (n - 1e0) AS a, (i // n) / (n - 1e0) AS b FROM (SELECT n, unnest(range(n * n)) AS i FROM side) AS t)"
_CONE = "CASE WHEN sqrt((a - {0}) ** 2 + (b - {1}) ** 2) < {2} THEN {3} * (1e0 - sqrt((a - {0}) ** 2 + (b - {1}) ** 2) / {2}) ** {4} ELSE 0e0 END"
_RIDGES = " - ".join(f"CASE WHEN abs(a - b / 2e0 - ({o})) < 0.08e0 THEN {h} * cos(pi() * abs(a - b / 2e0 - ({o})) / 0.16e0) ** 2 ELSE 0e0 END" for o, h in (("-0.25e0", "64e0"), ("0e0", "80e0"), ("0.25e0", "64e0")))
ORACLE_SQL["synthetic_depths"] = f"""WITH {_N} SELECT ix, iy, round(50e0 + 100e0 * a + 50e0 * b, 6) + 0e0 AS slope,
    round(50e0 + 100e0 * a + 50e0 * b + 75e0 * (1e0 - tanh(50e0 * (abs(a - (0.3e0 + 0.05e0 * sin(4e0 * pi() * b))) - 0.05e0))), 6) + 0e0 AS canyon,
    round(200e0 - {_CONE.format('0.7e0', '0.6e0', '0.15e0', '150e0', '0.7e0')}, 6) + 0e0 AS seamount, round(150e0 - {_RIDGES}, 6) + 0e0 AS ridge,
    round(100e0 + 50e0 * a + 60e0 * (1e0 - tanh(60e0 * (abs(a - 0.25e0) - 0.04e0))) - {_CONE.format('0.75e0', '0.5e0', '0.12e0', '100e0', '0.8e0')}, 6) + 0e0 AS canyon_seamount,
    round(50e0 + 250e0 * (1e0 + tanh((a - 0.4e0) / 0.02e0)) / 2e0, 6) + 0e0 AS shelf, round(exp(sin(pi() * a / 5e0) * sin(pi() * b / 5e0)), 6) + 0e0 AS bump FROM s"""

#: Metrics by the form of their text: whole numbers, three or four decimals, else two in scientific form.
ORACLE_SQL["metric_format"] = """WITH m AS (SELECT p_partkey AS id, ['iterations', 'total_ms', 'solution_l2_norm', 'data_residual', 'relative_residual', 'time_ms', 'qinv_apply_calls'][p_partkey % 7 + 1] AS name, (p_size * 37 + p_partkey % 11) / 64e0 AS v FROM part)
    SELECT id, CASE WHEN name IN ('iterations', 'total_ms', 'qinv_apply_calls') THEN trunc(v)::BIGINT::VARCHAR WHEN name = 'solution_l2_norm' THEN printf('%.3f', v) WHEN name = 'data_residual' THEN printf('%.4f', v) ELSE printf('%.2e', v) END AS text FROM m"""
