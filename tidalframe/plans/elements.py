"""Queries of moving elements, boundary faces, mortars, energies and edge conditions, with hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions import basis
from tidalframe.operators import column, energies, mesh, seabed, sigma_fields
from tidalframe.plans.files import _CUBIC, _PATCH, _patches
from tidalframe.plans.fits import _FIELD, _LIST, _field, _r
from tidalframe.plans.meshes import _EDGES, _LOCATED, BASE, BOX, DEEP, LEVELS, _points
from tidalframe.sources.tables import materialise, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_NODES = [float(x) for x in basis.lobatto(4)[0]]
_WEIGHTS = [float(x) for x in basis.lobatto(4)[1]]


def _slope_table() -> str:
    """Derivatives of the Lagrange polynomials at their nodes, as the quotient of products."""
    x = _NODES
    out = []
    for r in range(4):
        for c in range(4):
            if r == c:
                v = sum(1 / (x[c] - x[m]) for m in range(4) if m != c)
            else:
                top = bottom = 1.0
                for m in range(4):
                    if m not in (r, c):
                        top *= x[r] - x[m]
                    if m != c:
                        bottom *= x[c] - x[m]
                v = top / bottom
            out.append(f"({r}, {c}, {v:.17e})")
    return f"d(r, c, w) AS (VALUES {', '.join(out)})"


_SLOPES = f"""{_slope_table()}, di AS (SELECT elem, r AS i, j, k, sum(w * v) AS di FROM f JOIN d ON c = i GROUP BY elem, r, j, k), dj AS (SELECT elem, i, r AS j, k, sum(w * v) AS dj FROM f JOIN d ON c = j GROUP BY elem, i, r, k),
    dk AS (SELECT elem, i, j, r AS k, sum(w * v) AS dk FROM f JOIN d ON c = k GROUP BY elem, i, j, r),
    m AS (SELECT elem, i, j, k, di, dj, dk, ({_LIST(_NODES)}[k + 1] - 1e0) / 2e0 AS s, elem % 7 / 10e0 + 5e0 + elem % 3 AS depth, 0.1e0 * (i + 1) AS ex, 0.05e0 * (j + 1) AS ey, 0.3e0 - 0.1e0 * i AS hx, 0.02e0 * j AS hy, 0.01e0 * (elem % 5) AS et
        FROM di JOIN dj USING (elem, i, j, k) JOIN dk USING (elem, i, j, k)),
    g AS (SELECT *, di - (s * (ex + hx) - ex) / depth * dk AS ux, dj - (s * (ey + hy) - ey) / depth * dk AS uy, dk / depth AS uz, et * (1e0 + s) AS wm FROM m)"""


def _moving(spark, sf_dir):
    """Node values with reference slopes, and a surface and bed by position."""
    slopes = column.gradient(_field(spark, sf_dir))
    e = F.col("elem")
    rows = slopes.withColumns({"eta": e % 7 / 10.0, "h": 5.0 + e % 3, "eta_x": 0.1 * (F.col("i") + 1), "eta_y": 0.05 * (F.col("j") + 1), "h_x": 0.3 - 0.1 * F.col("i"), "h_y": 0.02 * F.col("j"), "eta_t": 0.01 * (e % 5)})
    return sigma_fields.at_fixed_height(sigma_fields.metrics(rows))


@query("sigma_gradient", f"WITH {_FIELD}, {_SLOPES} SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(ux, 6) + 0e0 AS ux, round(uy, 6) + 0e0 AS uy, round(uz, 6) + 0e0 AS uz FROM g")
def sigma_gradient(spark, sf_dir):
    return _moving(spark, sf_dir).select("elem", "i", "j", "k", *[_r(c).alias(c) for c in ("ux", "uy", "uz")])


@query("ale_terms", f"""WITH {_FIELD}, {_SLOPES} SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(-wm * uz, 6) + 0e0 AS correction,
    round(0.5e0 + 0.2e0 * ux - 0.1e0 * uy + (0.03e0 * k - wm / depth) * dk, 6) + 0e0 AS rate FROM g""")
def ale_terms(spark, sf_dir):
    """What mesh motion adds, and the rate along a flow of (0.2, -0.1) that passes sigma surfaces at 0.03 a level."""
    rows = _moving(spark, sf_dir)
    w = sigma_fields.mesh_velocity(F.col("eta_t"), F.lit(0.0), F.col("sigma"))
    rate = sigma_fields.material_rate(F.lit(0.5), F.lit(0.2), F.lit(-0.1), 0.03 * F.col("k"), w)
    return rows.select("elem", "i", "j", "k", _r(sigma_fields.ale_correction(w)).alias("correction"), _r(rate).alias("rate"))


@query("sigma_divergence", f"WITH {_FIELD}, {_SLOPES} SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(2e0 * di - dj + 0.5e0 * dk, 6) + 0e0 AS divergence FROM g")
def sigma_divergence(spark, sf_dir):
    flow = _field(spark, sf_dir).select("elem", "i", "j", "k", (2 * F.col("v")).alias("hu"), (-F.col("v")).alias("hv"), (0.5 * F.col("v")).alias("omega"))
    return sigma_fields.divergence(flow).select("elem", "i", "j", "k", _r("divergence").alias("divergence"))


@query("node_heights", f"""WITH c AS (SELECT vec_id AS elem, i, j, vec_id % 7 / 10e0 + 0.01e0 * i AS eta, 5e0 + vec_id % 3 + 0.1e0 * j AS h FROM embeddings, range(4) AS p(i), range(4) AS q(j))
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(eta + ({_LIST(_NODES)}[k + 1] - 1e0) / 2e0 * (eta + h), 6) + 0e0 AS z, round(50e0 * 40e0 * (eta + h) / 2e0, 4) + 0e0 AS det FROM c, range(4) AS r(k)""")
def node_heights(spark, sf_dir):
    """Nodes between bed and surface, and the volume factor of elements of 100 by 80; equidistant in sigma, so it is exact."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)])).alias("x")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("elem"), at).select("elem", "x.*")
    columns = rows.withColumns({"eta": F.col("elem") % 7 / 10.0 + 0.01 * F.col("i"), "h": 5.0 + F.col("elem") % 3 + 0.1 * F.col("j")})
    z = sigma_fields.heights(columns, sigma_fields.levels())
    both = z.join(sigma_fields.jacobian(z, 100.0, 80.0), ["elem", "i", "j", "k"])
    return both.select("elem", "i", "j", "k", _r("z").alias("z"), _r("det", 4).alias("det"))


_KIND = "CASE elem % 5 WHEN 0 THEN 'dirichlet' WHEN 1 THEN 'neumann' WHEN 2 THEN 'outflow' WHEN 3 THEN 'no_slip' ELSE 'free_slip' END"


@query("boundary_flux", f"""WITH {_FIELD}, s AS (SELECT elem, j, k, v, elem % 3 - 1e0 AS speed, {_KIND} AS kind FROM f WHERE i = 3)
    SELECT elem, 3::INT AS i, j::INT AS j, k::INT AS k, round({_LIST(_WEIGHTS)}[j + 1] * {_LIST(_WEIGHTS)}[k + 1] * speed * CASE WHEN speed >= 0 THEN v WHEN kind = 'dirichlet' THEN 2e0 WHEN kind = 'no_slip' THEN -v ELSE v END, 7) + 0e0 AS v FROM s""")
def boundary_flux(spark, sf_dir):
    """Upwind fluxes through the outer face along i, beyond which lies what the boundary's kind says."""
    names = F.array(*[F.lit(k) for k in ("dirichlet", "neumann", "outflow", "no_slip", "free_slip")])
    kind = F.element_at(names, (F.col("elem") % 5 + 1).cast("int"))
    faces = column.face_values(_field(spark, sf_dir)).where("face = 1")
    return sigma_fields.boundary_lift(faces, kind, F.lit(2.0), F.col("elem") % 3 - 1.0).select("elem", "i", "j", "k", _r("v", 7).alias("v"))


@query("mortar_return", f"WITH {_FIELD} SELECT elem, j::INT AS a, k::INT AS b, round(v, 6) + 0e0 AS v FROM f WHERE i = 3")
def mortar_return(spark, sf_dir):
    """Face values on the four quarters of a face and back by projection, which returns them as they were."""
    faces = column.face_values(_field(spark, sf_dir)).where("face = 1")
    return sigma_fields.from_quarters(sigma_fields.quarter(faces)).select("elem", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), _r("v").alias("v"))


# --- energies of patches by Gauss points, and conditions across edges --------------------------------------------

_G = basis.gauss(4)
_GAUSS = f"g(q, u, w) AS (VALUES {', '.join(f'({k}, {float(x):.17e}, {float(w):.17e})' for k, (x, w) in enumerate(zip(*_G, strict=True)))})"
_ONE = "CASE i WHEN 0 THEN -3e0 * (1e0 - u) ** 2 WHEN 1 THEN 3e0 * (1e0 - u) * (1e0 - 3e0 * u) WHEN 2 THEN 3e0 * u * (2e0 - 3e0 * u) ELSE 3e0 * u ** 2 END"
_TWO = "CASE i WHEN 0 THEN 6e0 * (1e0 - u) WHEN 1 THEN 18e0 * u - 12e0 WHEN 2 THEN 6e0 - 18e0 * u ELSE 6e0 * u END"


@query("patch_energies", f"""WITH {_PATCH}, {_GAUSS}, b AS (SELECT q, i, w, {_CUBIC('u')} AS b0, {_ONE} AS b1, {_TWO} AS b2 FROM g, range(4) AS r(i)),
    s AS (SELECT leaf, p.q AS pq, t.q AS tq, any_value(p.w * t.w) AS w, sum(z * p.b1 * t.b0) AS zu, sum(z * p.b0 * t.b1) AS zv, sum(z * p.b2 * t.b0) AS zuu, sum(z * p.b1 * t.b1) AS zuv, sum(z * p.b0 * t.b2) AS zvv FROM c JOIN b AS p ON p.i = k % 4 JOIN b AS t ON t.i = k // 4 GROUP BY leaf, p.q, t.q)
    SELECT leaf, round(sum(w * dx * dy * ((zu / dx) ** 2 + (zv / dy) ** 2)), 4) + 0e0 AS dirichlet, round(sum(w * dx * dy * ((zuu / dx ** 2) ** 2 + 2e0 * (zuv / (dx * dy)) ** 2 + (zvv / dy ** 2) ** 2)), 9) + 0e0 AS thin_plate
    FROM s JOIN (SELECT leaf, xmax - xmin AS dx, ymax - ymin AS dy FROM elem) AS e USING (leaf) GROUP BY leaf""")
def patch_energies(spark, sf_dir):
    """Squared slopes and squared curvatures of each patch, as quadratic forms of its coefficients."""
    out = energies.energy(_patches(spark, sf_dir), 3)
    return out.select("leaf", _r("dirichlet", 4).alias("dirichlet"), _r("thin_plate", 9).alias("thin_plate"))


@query("edge_conditions", f"""WITH {_PATCH}, w AS (SELECT leaf, xmax - xmin AS dx, ymax - ymin AS dy FROM elem)
    SELECT leaf, round(max(CASE WHEN k = 1 THEN z END) * 3e0 / any_value(dx) - max(CASE WHEN k = 0 THEN z END) * 3e0 / any_value(dx), 6) + 0e0 AS left_slope,
        round(6e0 * (max(CASE WHEN k = 15 THEN z END) - 2e0 * max(CASE WHEN k = 11 THEN z END) + max(CASE WHEN k = 7 THEN z END)) / any_value(dy) ** 2, 8) + 0e0 AS top_curvature FROM c JOIN w USING (leaf) GROUP BY leaf""")
def edge_conditions(spark, sf_dir):
    """Rows of boundary conditions applied: the slope across the left edge at the bottom, the curvature across the top at the right."""
    rows = _patches(spark, sf_dir)
    slope = energies.edge_row(rows, 3, "left", 0, 1)
    bend = energies.edge_row(rows, 3, "top", 3, 2)
    return slope.select("leaf", _r("value").alias("left_slope")).join(bend.select("leaf", _r("value", 8).alias("top_curvature")), "leaf")


@query("penalty_jumps", f"""WITH {_PATCH}, w AS (SELECT *, xmax - xmin AS dx FROM elem),
    m AS (SELECT a.leaf, b.leaf AS other, a.dx AS dx FROM w AS a JOIN w AS b ON b.xmin = a.xmax AND b.ymin = a.ymin AND b.ymax = a.ymax),
    j AS (SELECT m.leaf, p.k // 4 AS r, 3e0 / dx * (q1.z - q0.z - p1.z + p.z) AS jump, dx FROM m JOIN c AS p ON p.leaf = m.leaf AND p.k % 4 = 2 JOIN c AS p1 ON p1.leaf = m.leaf AND p1.k = p.k + 1
        JOIN c AS q0 ON q0.leaf = m.other AND q0.k = p.k - 2 JOIN c AS q1 ON q1.leaf = m.other AND q1.k = p.k - 1),
    h(r, s, v) AS (VALUES {', '.join(f'({r}, {s}, {v:.17e})' for r, row in enumerate(energies.mass(3).tolist()) for s, v in enumerate(row))})
    SELECT a.leaf, round(sum(10e0 * a.jump * b.jump * v), 8) + 0e0 AS penalty FROM j AS a JOIN j AS b ON a.leaf = b.leaf JOIN h ON h.r = a.r AND h.s = b.r GROUP BY a.leaf""")
def penalty_jumps(spark, sf_dir):
    """Interior penalty of slope jumps across conforming vertical edges: strength over size, times the squared jump along the edge."""
    return energies.penalty(_patches(spark, sf_dir), 3, 10.0).select("leaf", _r("penalty", 8).alias("penalty"))


_MAP = "50e0 + 0.3e0 * di AS j00, -0.2e0 * di AS j01, 0.1e0 * di AS j02, 0.3e0 * dj AS j10, 40e0 - 0.2e0 * dj AS j11, 0.1e0 * dj AS j12, 0.3e0 * dk AS j20, -0.2e0 * dk AS j21, 5e0 + 0.1e0 * dk AS j22"
_COFACTORS = {(r, c): f"(j{(r + 1) % 3}{(c + 1) % 3} * j{(r + 2) % 3}{(c + 2) % 3} - j{(r + 1) % 3}{(c + 2) % 3} * j{(r + 2) % 3}{(c + 1) % 3})" for r in range(3) for c in range(3)}


@query("map_jacobians", f"""WITH {_FIELD}, {_SLOPES}, a AS (SELECT elem, i, j, k, {_MAP} FROM m), b AS (SELECT *, j00 * {_COFACTORS[0, 0]} + j01 * {_COFACTORS[0, 1]} + j02 * {_COFACTORS[0, 2]} AS det FROM a)
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(det, 3) + 0e0 AS det, {', '.join(f'round({_COFACTORS[c, r]} / det, 8) + 0e0 AS g{r}{c}' for r in range(3) for c in range(3))} FROM b""")
def map_jacobians(spark, sf_dir):
    """Determinants and inverses of the maps of bent elements: straight boxes whose nodes a field shifts."""
    node = lambda axis: column.by_index(axis, _NODES)
    v = F.col("v")
    nodes = _field(spark, sf_dir).select("elem", "i", "j", "k", (50.0 * node("i") + 0.3 * v).alias("x"), (40.0 * node("j") - 0.2 * v).alias("y"), (5.0 * node("k") + 0.1 * v).alias("z"))
    out = sigma_fields.geometry(nodes)
    return out.select(*[F.col(c).cast("int").alias(c) if c != "elem" else F.col(c) for c in ("elem", "i", "j", "k")], _r("det", 3).alias("det"), *[_r(f"g{r}{c}", 8).alias(f"g{r}{c}") for r in range(3) for c in range(3)])


@query("height_slopes", f"""WITH c AS (SELECT vec_id AS elem, i, j, 0.01e0 * (vec_id % 7) AS ex, 0.02e0 * i AS ey, 0.1e0 * (vec_id % 3) AS hx, -0.05e0 * j AS hy FROM embeddings, range(4) AS p(i), range(4) AS q(j))
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(ex + s * (ex + hx), 7) + 0e0 AS z_x, round(ey + s * (ey + hy), 7) + 0e0 AS z_y FROM (SELECT *, ({_LIST(_NODES)}[k + 1] - 1e0) / 2e0 AS s FROM c, range(4) AS r(k)) AS t""")
def height_slopes(spark, sf_dir):
    """Slopes of the sigma surfaces between a sloping surface and a sloping bed."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)])).alias("x")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("elem"), at).select("elem", "x.*")
    columns = rows.withColumns({"eta_x": 0.01 * (F.col("elem") % 7), "eta_y": 0.02 * F.col("i"), "h_x": 0.1 * (F.col("elem") % 3), "h_y": -0.05 * F.col("j")})
    return sigma_fields.height_slopes(columns, sigma_fields.levels()).select("elem", "i", "j", "k", _r("z_x", 7).alias("z_x"), _r("z_y", 7).alias("z_y"))


# --- the seabed: patches whose coefficients are lifted by their leaf's number, so that sides of an edge differ ------

_LIFTED = "(z + (leaf % 5) * (k % 3)) * 0.318309886e0"
_B = lambda i, u: f"(CASE {i} WHEN 0 THEN (1e0 - {u}) ** 3 WHEN 1 THEN 3e0 * {u} * (1e0 - {u}) ** 2 WHEN 2 THEN 3e0 * {u} ** 2 * (1e0 - {u}) ELSE {u} ** 3 END)"
_D = lambda i, u: f"(CASE {i} WHEN 0 THEN -3e0 * (1e0 - {u}) ** 2 WHEN 1 THEN 3e0 * (1e0 - {u}) * (1e0 - 3e0 * {u}) WHEN 2 THEN 3e0 * {u} * (2e0 - 3e0 * {u}) ELSE 3e0 * {u} ** 2 END)"


def _lifted(spark, sf_dir):
    """The patches, lifted."""
    lift = F.transform("coefficients", lambda z, k: (z + (F.col("leaf") % 5) * (k % 3)) * 0.318309886)
    return materialise(_patches(spark, sf_dir).withColumn("coefficients", lift), "patches")


@query("seabed_depth", f"""WITH {_PATCH}, {_LOCATED},
    m AS (SELECT px, py, leaf, xmin, xmax, ymin, ymax, (px - xmin) / (xmax - xmin) AS u, (py - ymin) / (ymax - ymin) AS v FROM asks JOIN elem USING (lx, ix, iy)),
    h AS (SELECT px, py, leaf, any_value(px < xmax) AS r, any_value(px > xmin) AS l, any_value(py < ymax) AS t, any_value(py > ymin) AS b, sum(({_LIFTED}) * {_B('k % 4', 'u')} * {_B('k // 4', 'v')}) AS h,
        sum(({_LIFTED}) * {_D('k % 4', 'u')} * {_B('k // 4', 'v')}) / any_value(xmax - xmin) AS sx, sum(({_LIFTED}) * {_B('k % 4', 'u')} * {_D('k // 4', 'v')}) / any_value(ymax - ymin) AS sy FROM m JOIN c USING (leaf) GROUP BY px, py, leaf),
    g AS (SELECT px, py, min(leaf) AS leaf, arg_min(h, leaf) AS h, arg_min(sx, leaf) FILTER (r) AS xr, arg_min(sx, leaf) FILTER (l) AS xl, arg_min(sy, leaf) FILTER (t) AS yt, arg_min(sy, leaf) FILTER (b) AS yb FROM h GROUP BY px, py)
    SELECT px, py, coalesce(leaf, -1) AS element, leaf IS NOT NULL AS found, round(coalesce(h, 0e0), 6) + 0e0 AS depth, round(coalesce((xr + xl) / 2, xr, xl, 0e0), 6) + 0e0 AS dh_dx, round(coalesce((yt + yb) / 2, yt, yb, 0e0), 6) + 0e0 AS dh_dy FROM p LEFT JOIN g USING (px, py)""")
def seabed_depth(spark, sf_dir):
    """Element, depth and slopes of the seabed at points, many of them on edges and some outside."""
    out = seabed.evaluate(_points(spark, sf_dir), _lifted(spark, sf_dir), BOX, LEVELS, ("px", "py"), 3)
    return out.select("px", "py", "element", "found", _r("depth", 6).alias("depth"), _r("dh_dx", 6).alias("dh_dx"), _r("dh_dy", 6).alias("dh_dy"))


def _conform_sql() -> str:
    place = lambda e, k: f"CASE {e} WHEN 0 THEN 4 * {k} WHEN 1 THEN 4 * {k} + 3 WHEN 2 THEN {k} ELSE {k} + 12 END"
    halves = ["1 0 0 0", "0.5 0.5 0 0", "0.25 0.5 0.25 0", "0.125 0.375 0.375 0.125"]  # a cubic on the first half, in Bernstein form; the other half mirrors it
    values = [(0, r, c, w) for r, row in enumerate(halves) for c, w in enumerate(row.split())] + [(1, 3 - r, 3 - c, w) for r, row in enumerate(halves) for c, w in enumerate(row.split())]
    out = [f"""WITH {_PATCH}, {_EDGES}, k AS (SELECT leaf, edge, neighbour, neighbour_edge, CASE WHEN lo + hi < nlo + nhi THEN 0 ELSE 1 END AS half FROM met WHERE nhi - nlo > (hi - lo) * 1.5e0),
        ext(half, r, c, w) AS (VALUES {', '.join(f'({h}, {r}, {c}, {w}e0)' for h, r, c, w in values)}), lifted AS (SELECT lx, leaf, k, {_LIFTED} AS z FROM c JOIN elem USING (leaf)), done{BASE} AS (SELECT leaf, k, z FROM lifted WHERE lx = {BASE})"""]
    for level in LEVELS[1:]:
        out.append(f"""new{level} AS (SELECT leaf, spot AS k, arg_max(z, edge) AS z FROM (SELECT k.leaf, edge, {place('edge', 'r')} AS spot, sum(w * d.z) AS z FROM k JOIN elem ON elem.leaf = k.leaf AND lx = {level} JOIN ext USING (half)
            JOIN done{level - 1} AS d ON d.leaf = neighbour AND d.k = {place('neighbour_edge', 'c')} GROUP BY ALL) AS s GROUP BY leaf, spot),
        done{level} AS (SELECT l.leaf, l.k, coalesce(n.z, l.z) AS z FROM lifted AS l LEFT JOIN new{level} AS n ON n.leaf = l.leaf AND n.k = l.k WHERE lx = {level})""")
    every = " UNION ALL ".join(f"SELECT leaf, k, z FROM done{level}" for level in LEVELS)
    return ",\n        ".join(out) + f" SELECT leaf, k::INT AS k, round(z, 6) + 0e0 AS z FROM ({every}) AS every"


@query("seabed_conform", _conform_sql())
def seabed_conform(spark, sf_dir):
    """Coefficients after those on hanging edges are taken from the coarser side."""
    patches = _lifted(spark, sf_dir)
    coefficients = patches.select("leaf", F.posexplode("coefficients").alias("k", "z"))
    return seabed.conform(coefficients, patches, mesh.adjacency(patches, DEEP), LEVELS, 3).select("leaf", "k", _r("z").alias("z"))


# --- cells refined along one axis at a time ----------------------------------------------------------------------

@query("directional_growth", """WITH RECURSIVE c AS (SELECT 1 AS lx, 1 AS ly, i % 2 AS ix, i // 2 AS iy FROM range(4) AS r(i)
        UNION ALL SELECT lx + a.x, ly + a.y, ix * (1 + a.x) + p.b * a.x, iy * (1 + a.y) + q.b * a.y FROM
            (SELECT *, CASE WHEN lx < 5 AND ix * 1024e0 / (1 << lx) <= 300e0 AND (ix + 1) * 1024e0 / (1 << lx) > 300e0 THEN 1 ELSE 0 END AS x, CASE WHEN ly < 3 AND iy * 1024e0 / (1 << ly) <= 700e0 AND (iy + 1) * 1024e0 / (1 << ly) > 700e0 THEN 1 ELSE 0 END AS y FROM c) AS a,
            range(2) AS p(b), range(2) AS q(b) WHERE a.x + a.y > 0 AND (a.x = 1 OR p.b = 0) AND (a.y = 1 OR q.b = 0))
    SELECT lx::INT AS lx, ly::INT AS ly, ix::BIGINT AS ix, iy::BIGINT AS iy FROM c
    WHERE NOT ((lx < 5 AND ix * 1024e0 / (1 << lx) <= 300e0 AND (ix + 1) * 1024e0 / (1 << lx) > 300e0) OR (ly < 3 AND iy * 1024e0 / (1 << ly) <= 700e0 AND (iy + 1) * 1024e0 / (1 << ly) > 700e0))""")
def directional_growth(spark, sf_dir):
    """Cells halved along x around x = 300 to level 5, and along y around y = 700 to level 3."""
    held = lambda a, at: (F.col(f"{a}min") <= at) & (F.col(f"{a}max") > at)
    return mesh.grow_axes(mesh.uniform(spark, 1, 1), held("x", 300.0), held("y", 700.0), (5, 3), BOX).select("lx", "ly", "ix", "iy")


@query("axis_balance", """WITH RECURSIVE span AS (SELECT l FROM range(1, 7) AS r(l)),
    cell AS (SELECT l AS lx, 1 AS ly, CASE WHEN l = 6 THEN 0 ELSE 1 END AS ix, 0 AS iy FROM span WHERE l > 1 UNION ALL SELECT 6, 1, 1, 0),
    top AS (SELECT 1 AS lx, 1 AS ly, 1 AS ix, 0 AS iy UNION ALL SELECT 1, 1, 1, 1),
    above AS (SELECT l AS lx, 1 AS ly, 1 AS ix, 1 AS iy FROM span WHERE l BETWEEN 2 AND 5 UNION ALL SELECT 5, 1, 0, 1)
    SELECT lx::INT AS lx, ly::INT AS ly, ix::BIGINT AS ix, iy::BIGINT AS iy FROM (SELECT * FROM cell UNION SELECT * FROM top UNION SELECT * FROM above) AS t""")
def axis_balance(spark, sf_dir):
    """The lower left cell halved along x to level 6, then neighbours brought within one level per axis: the cell above follows to level 5."""
    near = (F.col("xmin") <= 0.0) & (F.col("ymin") <= 0.0)
    grown = mesh.grow_axes(mesh.uniform(spark, 1, 1), near, F.lit(False), (6, 1), BOX)
    return mesh.balance_axes(grown, 6).select("lx", "ly", "ix", "iy")
