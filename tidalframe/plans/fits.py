"""Queries of fits, columns and reports, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions import basis
from tidalframe.functions.dual import SQL, Text
from tidalframe.operators import column, fit, mesh, report
from tidalframe.plans import published
from tidalframe.plans.meshes import _EDGES, _MESH, DEEP, test_mesh
from tidalframe.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(e, digits: int = 6):
    return F.round(e, digits) + 0.0


# --- error marking -----------------------------------------------------------------------------

_METRIC = "SELECT o_custkey AS element, sqrt(avg((o_totalprice - 150000e0) * (o_totalprice - 150000e0))) AS m FROM orders GROUP BY 1"


@query("dorfler_mark", f"""WITH e AS ({_METRIC}),
    r AS (SELECT element, m, sum(m * m) OVER () AS tot, coalesce(sum(m * m) OVER (ORDER BY m DESC, element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
    k AS (SELECT min(m) AS cutoff FROM r WHERE before < 0.5e0 * tot)
    SELECT e.element, round(e.m, 4) + 0e0 AS metric FROM e CROSS JOIN k WHERE e.m >= k.cutoff * (1 - 1e-12)""")
def dorfler_mark(spark, sf_dir):
    """Which elements must be refined: RMS misfit per element, then the half of the squared error."""
    d = F.col("o_totalprice") - 150000.0
    metric = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("element")).agg(F.sqrt(F.avg(d * d)).alias("m"))
    return fit.dorfler(metric, "element", "m", 0.5).select("element", _r("m", 4).alias("metric"))


_ORDER_SAMPLES = "SELECT o_custkey AS elem, 1e0 + o_orderkey % 5 AS w, (o_totalprice - 150000e0) / 977e0 AS diff FROM orders"


def _order_samples(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("elem"), (1.0 + F.col("o_orderkey") % 5).alias("w"), ((F.col("o_totalprice") - 150000.0) / 977.0).alias("diff"))


@query("element_l2", f"SELECT elem, round(sqrt(sum(w * diff * diff)), 6) + 0e0 AS l2, round(sqrt(sum(w * diff * diff) / sum(w)), 6) + 0e0 AS normalised FROM ({_ORDER_SAMPLES}) AS s GROUP BY elem")
def element_l2(spark, sf_dir):
    return fit.element_error(_order_samples(spark, sf_dir)).select("elem", _r("l2").alias("l2"), _r("normalised").alias("normalised"))


@query("global_error", f"""SELECT round(max(l2), 6) + 0e0 AS most, round(avg(l2), 6) + 0e0 AS mean FROM (SELECT elem, sqrt(sum(w * diff * diff)) AS l2 FROM ({_ORDER_SAMPLES}) AS s GROUP BY elem) AS e""")
def global_error(spark, sf_dir):
    return fit.element_error(_order_samples(spark, sf_dir)).agg(_r(F.max("l2")).alias("most"), _r(F.avg("l2")).alias("mean"))


@query("coarsening_metric", """WITH s AS (SELECT o_custkey AS elem, o_orderkey AS q, 1e0 + o_orderkey % 5 AS w, o_totalprice / 977e0 AS z FROM orders)
    SELECT elem, round(sum(w * abs(z - CASE WHEN q % 4 <> 0 THEN z * 0.9e0 + 1e0 ELSE z END)) / sum(w), 6) + 0e0 AS mean_difference,
        round(sum(w * abs(z - CASE WHEN q % 4 <> 0 THEN z * 0.9e0 + 1e0 ELSE z END)), 6) + 0e0 AS volume_change FROM s GROUP BY elem""")
def coarsening_metric(spark, sf_dir):
    now = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("elem"), F.col("o_orderkey").alias("q"), (1.0 + F.col("o_orderkey") % 5).alias("w"), (F.col("o_totalprice") / 977.0).alias("z"))
    before = now.where("q % 4 <> 0").withColumn("z", F.col("z") * 0.9 + 1.0)
    return fit.coarsening_metric(now, before).select("elem", _r("mean_difference").alias("mean_difference"), _r("volume_change").alias("volume_change"))


# --- sampling, assembly, constraints ------------------------------------------------------------


def _gauss_sql(n: int) -> str:
    at, weight = basis.gauss(n)
    rows = ", ".join(f"({k}, {at[k % n]!r}e0, {at[k // n]!r}e0, {float(weight[k % n] * weight[k // n])!r}e0)".replace("np.float64(", "").replace(")e0", "e0") for k in range(n * n))
    return f"gauss AS (SELECT * FROM (VALUES {rows}) AS g(q, u, v, g))"


@query("gauss_samples", f"""WITH {_MESH}, {_gauss_sql(3)} SELECT leaf, q, round(xmin + u * (xmax - xmin), 8) + 0e0 AS x, round(ymin + v * (ymax - ymin), 8) + 0e0 AS y, round(g * (xmax - xmin) * (ymax - ymin), 8) + 0e0 AS w FROM elem, gauss""")
def gauss_samples(spark, sf_dir):
    return fit.gauss_samples(test_mesh(spark, sf_dir), 3, ("leaf",)).select("leaf", "q", _r("x", 8).alias("x"), _r("y", 8).alias("y"), _r("w", 8).alias("w"))


# samples on a 16 x 16 mesh of bilinear elements, from line items; dof = node of the grid
_SAMPLES = "SELECT (l_partkey % 16)::BIGINT * 16 + l_suppkey % 16 AS elem, l_discount * 67e0 / 7e0 AS u, l_tax * 86e0 / 7e0 AS v, l_quantity AS w, l_extendedprice / 977e0 AS z FROM lineitem"
_B = [basis.tensor(SQL, 1, k, Text("u"), Text("v")) for k in range(4)]
_BASIS = f"b AS (SELECT elem, w, z, unnest([0, 1, 2, 3]) AS a, unnest([{', '.join(map(str, _B))}]) AS x, row_number() OVER () AS s FROM smp)"
_DOF = "dof AS (SELECT e AS elem, a, (e // 16 + a % 2) * 17 + e % 16 + a // 2 AS i FROM range(256) AS r(e), range(4) AS q(a))"
_SYSTEM = f"""smp AS ({_SAMPLES}), num AS (SELECT *, row_number() OVER () AS s FROM smp),
    b AS (SELECT s, elem, w, z, unnest([0, 1, 2, 3]) AS a, unnest([{', '.join(map(str, _B))}]) AS x FROM num), {_DOF},
    blk AS (SELECT p.elem, p.a AS a, q.a AS c, sum(p.w * p.x * q.x) AS v FROM b AS p JOIN b AS q ON p.s = q.s GROUP BY ALL),
    mat AS (SELECT d.i, e.i AS j, sum(v) AS v FROM blk JOIN dof AS d ON blk.elem = d.elem AND blk.a = d.a JOIN dof AS e ON blk.elem = e.elem AND blk.c = e.a GROUP BY ALL HAVING abs(sum(v)) >= 1e-16),
    rhs AS (SELECT d.i, sum(w * z * x) AS v FROM b JOIN dof AS d ON b.elem = d.elem AND b.a = d.a GROUP BY ALL)"""


def _dofs(spark):
    rows = spark.range(1024).select(F.floor(F.col("id") / 4).cast("long").alias("elem"), (F.col("id") % 4).cast("int").alias("local"))
    return rows.withColumn("dof", (F.floor(F.col("elem") / 16) + F.col("local") % 2) * 17 + F.col("elem") % 16 + F.floor(F.col("local") / 2))


def _system(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 16 * 16 + F.col("l_suppkey") % 16).alias("elem"), (F.col("l_discount") * 67.0 / 7.0).alias("u"), (F.col("l_tax") * 86.0 / 7.0).alias("v"), F.col("l_quantity").alias("w"), (F.col("l_extendedprice") / 977.0).alias("z"))
    return fit.normal_equations(rows, _dofs(spark), 1)


@query("assemble_normal", f"WITH {_SYSTEM} SELECT i, j, round(v, 5) + 0e0 AS v FROM mat")
def assemble_normal(spark, sf_dir):
    return _system(spark, sf_dir)[0].select("i", "j", _r("v", 5).alias("v"))


@query("assemble_load", f"WITH {_SYSTEM} SELECT i, round(v, 4) + 0e0 AS v FROM rhs")
def assemble_load(spark, sf_dir):
    return _system(spark, sf_dir)[1].select("i", _r("v", 4).alias("v"))


_SLAVES = "con AS (SELECT d AS slave, d + o AS master, 0.5e0 AS w FROM range(289) AS r(d), (VALUES (-1), (1)) AS p(o) WHERE d % 17 % 4 = 2 AND d // 17 % 2 = 1)"


def _constraints(spark):
    rows = spark.range(289).select(F.col("id").alias("slave"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("o"))
    return rows.where("slave % 17 % 4 = 2 AND floor(slave / 17) % 2 = 1").select("slave", (F.col("slave") + F.col("o")).alias("master"), F.lit(0.5).alias("w"))


_CONDENSED = f"""{_SLAVES}, one AS (SELECT coalesce(master, i) AS i, j, v * coalesce(w, 1e0) AS v FROM mat LEFT JOIN con ON mat.i = con.slave),
    two AS (SELECT i, coalesce(master, j) AS j, sum(v * coalesce(w, 1e0)) AS v FROM one LEFT JOIN con ON one.j = con.slave GROUP BY ALL)"""


@query("condense", f"WITH {_SYSTEM}, {_CONDENSED} SELECT i, j, round(v, 5) + 0e0 AS v FROM two")
def condense(spark, sf_dir):
    return fit.condense(_system(spark, sf_dir)[0], _constraints(spark)).select("i", "j", _r("v", 5).alias("v"))


_CORNERS = f"""{_MESH}, {_EDGES}, corner AS (SELECT leaf AS elem, a AS local, xmin + (a % 2) * (xmax - xmin) AS x, ymin + (a // 2) * (ymax - ymin) AS y FROM elem, range(4) AS r(a)),
    node AS (SELECT elem, local, dense_rank() OVER (ORDER BY x, y) - 1 AS dof FROM corner),
    fine AS (SELECT leaf, edge, CASE WHEN lo + hi < nlo + nhi THEN 1 ELSE 0 END AS far FROM (SELECT *, count(*) OVER (PARTITION BY leaf, edge) AS n FROM met) AS m WHERE n = 1 AND nhi - nlo > (hi - lo) * 1.5e0),
    slave AS (SELECT DISTINCT dof FROM fine JOIN node ON leaf = elem AND local = CASE edge WHEN 0 THEN 2 * far WHEN 1 THEN 2 * far + 1 WHEN 2 THEN far ELSE far + 2 END)"""


def _corners(spark, sf_dir):
    """The mesh, and (elem, local, dof) of the corners of its leaves."""
    leaves = test_mesh(spark, sf_dir)
    rows = leaves.withColumn("local", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    x = F.col("xmin") + (F.col("local") % 2) * (F.col("xmax") - F.col("xmin"))
    y = F.col("ymin") + F.floor(F.col("local") / 2) * (F.col("ymax") - F.col("ymin"))
    return leaves, fit.conforming_dofs(rows.select(F.col("leaf").alias("elem"), "local", x.alias("x"), y.alias("y")))


def _hanging(leaves, dofs):
    """(slave, master, w) in unknowns of bilinear elements: corners on the middle of a coarser neighbour's edge."""
    local = fit.hanging_constraints(mesh.adjacency(leaves, DEEP), 1)
    slave = dofs.select(F.col("elem").alias("leaf"), "local", F.col("dof").alias("slave"))
    master = dofs.select(F.col("elem").alias("master_leaf"), F.col("local").alias("master_local"), F.col("dof").alias("master"))
    return local.join(slave, ["leaf", "local"]).join(master, ["master_leaf", "master_local"]).select("slave", "master", "w").distinct()


@query("free_dofs", f"WITH {_CORNERS} SELECT dof, row_number() OVER (ORDER BY dof) - 1 AS free FROM (SELECT DISTINCT dof FROM node) AS d ANTI JOIN slave USING (dof)")
def free_dofs(spark, sf_dir):
    """Corner unknowns of the mesh less the hanging ones, renumbered."""
    leaves, dofs = _corners(spark, sf_dir)
    return fit.free_dofs(dofs, _hanging(leaves, dofs))


_X = "x AS (SELECT i, sin(i * 0.37e0) + 2e0 AS v FROM rhs)"


def _x(load):
    return load.select("i", (F.sin(F.col("i") * 0.37) + 2.0).alias("v"))


@query("objective", f"WITH {_SYSTEM}, {_X} SELECT round(sum(mat.v * a.v * b.v) / 1e6, 6) + 0e0 AS value FROM mat JOIN x AS a ON mat.i = a.i JOIN x AS b ON mat.j = b.i")
def objective(spark, sf_dir):
    matrix, load = _system(spark, sf_dir)
    return fit.quadratic_form(matrix, _x(load)).select(_r(F.col("value") / 1e6).alias("value"))


@query("matrix_vector", f"WITH {_SYSTEM}, {_X} SELECT mat.i, round(sum(mat.v * x.v), 4) + 0e0 AS v FROM mat JOIN x ON mat.j = x.i GROUP BY mat.i")
def matrix_vector(spark, sf_dir):
    matrix, load = _system(spark, sf_dir)
    return fit.matvec(matrix, _x(load)).select("i", _r("v", 4).alias("v"))


@query("frobenius_scale", f"WITH {_SYSTEM}, {_CONDENSED} SELECT round((SELECT sqrt(sum(v * v)) FROM mat) / (SELECT sqrt(sum(v * v)) FROM two), 8) + 0e0 AS alpha")
def frobenius_scale(spark, sf_dir):
    matrix = _system(spark, sf_dir)[0]
    return fit.frobenius_ratio(matrix, fit.condense(matrix, _constraints(spark))).select(_r("alpha", 8).alias("alpha"))


@query("jacobi_sweep", f"""WITH {_SYSTEM}, d AS (SELECT i, v AS d FROM mat WHERE i = j), x1 AS (SELECT rhs.i, 0.8e0 * rhs.v / d AS v FROM rhs JOIN d USING (i)),
    x2 AS (SELECT rhs.i, any_value(x1.v) + 0.8e0 * (any_value(rhs.v) - sum(mat.v * y.v)) / any_value(d) AS v FROM rhs JOIN d USING (i) JOIN x1 ON rhs.i = x1.i JOIN mat ON mat.i = rhs.i JOIN x1 AS y ON mat.j = y.i GROUP BY rhs.i)
    SELECT i, round(v, 6) + 0e0 AS v FROM x2""")
def jacobi_sweep(spark, sf_dir):
    matrix, load = _system(spark, sf_dir)
    return fit.jacobi(matrix, load, 2).select("i", _r("v").alias("v"))


@query("direct_solve")
def direct_solve(spark, sf_dir):
    """The weighted bilinear fit, condensed, solved and expanded; tests compare it with numpy."""
    matrix, load = _system(spark, sf_dir)
    con = _constraints(spark)
    free = fit.solve(fit.condense(matrix, con), fit.condense_load(load, con))
    return fit.expand(free, con).select("i", _r("v").alias("v"))


@query("gather_coefficients", f"WITH {_CORNERS} SELECT elem, list(dof * 2e0 ORDER BY local) AS coefficients FROM node GROUP BY elem")
def gather_coefficients(spark, sf_dir):
    """Every leaf's corner values in local order."""
    _, dofs = _corners(spark, sf_dir)
    return fit.gather(dofs, dofs.select(F.col("dof").alias("i"), (F.col("dof") * 2.0).alias("v")).distinct())


# --- columns: each embedding is an element of order 3 -------------------------------------------

_STEP, _WEIGHT = (0.0, 0.2, 0.5, 0.3), (1 / 6, 5 / 6, 5 / 6, 1 / 6)
_HEIGHT = (-3.0, -2.2, -1.1, 0.0)
_LIST = lambda xs: "[" + ", ".join(f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in xs) + "]"
_FIELD = "f AS (SELECT vec_id AS elem, p % 4 AS i, p // 4 % 4 AS j, p // 16 AS k, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) AS t)"


def _field(spark, sf_dir):
    return column.field(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("depth_average", f"WITH {_FIELD} SELECT elem, i::INT AS i, j::INT AS j, round(sum({_LIST(_WEIGHT)}[k + 1] * v) / sum({_LIST(_WEIGHT)}[k + 1]), 7) + 0e0 AS mean, round(sum({_LIST(_WEIGHT)}[k + 1] * v), 7) + 0e0 AS total FROM f GROUP BY elem, i, j")
def depth_average(spark, sf_dir):
    return column.depth_average(_field(spark, sf_dir), _WEIGHT).select("elem", "i", "j", _r("mean", 7).alias("mean"), _r("total", 7).alias("total"))


@query("deviation", f"WITH {_FIELD}, m AS (SELECT elem, i, j, sum({_LIST(_WEIGHT)}[k + 1] * v) / sum({_LIST(_WEIGHT)}[k + 1]) AS m FROM f GROUP BY elem, i, j) SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(v - m, 7) + 0e0 AS v FROM f JOIN m USING (elem, i, j)")
def deviation(spark, sf_dir):
    return column.deviation(_field(spark, sf_dir), _WEIGHT).select("elem", "i", "j", "k", _r("v", 7).alias("v"))


_COLUMN = "WINDOW c AS (PARTITION BY elem, i, j ORDER BY k)"


@query("omega_column", f"""WITH {_FIELD}, t AS (SELECT *, coalesce((v + lag(v) OVER c) / 2e0 * {_LIST(_STEP)}[k + 1], 0e0) AS part FROM f {_COLUMN})
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(-(sum(part) OVER (PARTITION BY elem, i, j ORDER BY k ROWS UNBOUNDED PRECEDING)) / 40e0, 8) + 0e0 AS omega FROM t""")
def omega_column(spark, sf_dir):
    return column.omega(_field(spark, sf_dir), _STEP, 40.0).select("elem", "i", "j", "k", _r("omega", 8).alias("omega"))


@query("pressure_column", f"""WITH {_FIELD}, t AS (SELECT *, coalesce((v + lead(v) OVER c) / 2e0 * lead({_LIST(_STEP)}[k + 1]) OVER c, 0e0) AS part FROM f {_COLUMN})
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(9.81e0 * 40e0 * sum(part) OVER (PARTITION BY elem, i, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) + 0e0 AS p FROM t""")
def pressure_column(spark, sf_dir):
    return column.pressure(_field(spark, sf_dir), _STEP, 40.0).select("elem", "i", "j", "k", _r("p").alias("p"))


@query("buoyancy", f"""WITH {_FIELD}, g AS (SELECT elem, i, j, k, v + 1000e0 AS v, {_LIST(_HEIGHT)}[k + 1] AS z FROM f),
    t AS (SELECT *, -9.81e0 * ((lead(v) OVER c - lag(v) OVER c) / (lead(z) OVER c - lag(z) OVER c)) / v AS n FROM g {_COLUMN})
    SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(coalesce(n, lead(n) OVER c, lag(n) OVER c), 9) + 0e0 AS n2 FROM t {_COLUMN}""")
def buoyancy(spark, sf_dir):
    rows = _field(spark, sf_dir).withColumn("v", F.col("v") + 1000.0)
    return column.buoyancy(rows, _HEIGHT).select("elem", "i", "j", "k", _r("n2", 9).alias("n2"))


def _gradient_sql() -> str:
    d = basis.derivative_matrix(basis.lobatto(4)[0])
    values = ", ".join(f"({r}, {c}, {d[r, c]:.17e})" for r in range(4) for c in range(4))
    parts = " JOIN ".join(f"(SELECT elem, {', '.join(f'{a} AS {a}' if a != axis else f'd.r AS {axis}' for a in 'ijk')}, sum(d.v * f.v) AS d{axis} FROM f JOIN d ON f.{axis} = d.c GROUP BY ALL) AS t{axis}" + ("" if axis == "i" else " USING (elem, i, j, k)") for axis in "ijk")
    return f"WITH {_FIELD}, d AS (SELECT * FROM (VALUES {values}) AS t(r, c, v)) SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, {', '.join(f'round(d{a}, 7) + 0e0 AS d{a}' for a in 'ijk')} FROM {parts}"


@query("reference_gradient", _gradient_sql())
def reference_gradient(spark, sf_dir):
    return column.gradient(_field(spark, sf_dir)).select("elem", "i", "j", "k", *[_r(f"d{a}", 7).alias(f"d{a}") for a in "ijk"])


@query("directional_mask", f"""WITH {_FIELD}, g AS (SELECT elem,
        (SELECT max(r) FROM (SELECT max(v) - min(v) AS r FROM f AS h WHERE h.elem = e.elem GROUP BY j, k) AS x) AS gx, (SELECT max(r) FROM (SELECT max(v) - min(v) AS r FROM f AS h WHERE h.elem = e.elem GROUP BY i, k) AS x) AS gy,
        (SELECT max(r) FROM (SELECT max(v) - min(v) AS r FROM f AS h WHERE h.elem = e.elem GROUP BY i, j) AS x) AS gz FROM (SELECT DISTINCT elem FROM f) AS e)
    SELECT elem, round(gx, 7) + 0e0 AS gx, round(gy, 7) + 0e0 AS gy, round(gz, 7) + 0e0 AS gz,
        CASE WHEN gx > 0.9e0 * greatest(gx, gy, gz) THEN 1 ELSE 0 END + CASE WHEN gy > 0.9e0 * greatest(gx, gy, gz) THEN 2 ELSE 0 END + CASE WHEN gz > 0.9e0 * greatest(gx, gy, gz) THEN 4 ELSE 0 END AS mask FROM g""")
def directional_mask(spark, sf_dir):
    return column.directional_mask(_field(spark, sf_dir), 0.9).select("elem", *[_r(g, 7).alias(g) for g in ("gx", "gy", "gz")], "mask")


_STATE = "SELECT o_custkey AS elem, 10e0 + o_totalprice / 90000e0 AS h, (o_orderkey % 11 - 5e0) / 7e0 AS u, (o_orderkey % 13 - 6e0) / 9e0 AS v, (o_orderkey % 17) / 19e0 AS eta FROM orders"


@query("diagnostics", f"""WITH s AS ({_STATE}), e AS (SELECT elem, sum(h) AS mass, sum(0.5e0 * h * (u * u + v * v) + 0.5e0 * 9.81e0 * eta * eta) AS energy, sqrt(max(u * u) + max(v * v)) AS speed,
        min(eta) AS lo, max(eta) AS hi, sqrt(9.81e0 * max(h)) + greatest(max(abs(u)), max(abs(v))) AS wave FROM s GROUP BY elem)
    SELECT round(sum(mass), 4) + 0e0 AS mass, round(sum(energy), 4) + 0e0 AS energy, round(max(speed), 8) + 0e0 AS max_velocity, round(min(lo), 8) + 0e0 AS eta_min, round(max(hi), 8) + 0e0 AS eta_max, round(max(wave), 8) + 0e0 AS wave_speed FROM e""")
def diagnostics(spark, sf_dir):
    k = F.col("o_orderkey")
    state = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("elem"), (10.0 + F.col("o_totalprice") / 90000.0).alias("h"), ((k % 11 - 5.0) / 7.0).alias("u"), ((k % 13 - 6.0) / 9.0).alias("v"), ((k % 17) / 19.0).alias("eta"))
    out = column.diagnostics(state)
    return out.select(*[_r(c, 4 if c in ("mass", "energy") else 8).alias(c) for c in out.columns])


@query("refine_projection")
def refine_projection(spark, sf_dir):
    """Every element halved along k, by interpolation at the halves' nodes; tests check polynomials."""
    return column.refine_field(_field(spark, sf_dir), "k").select("elem", "half", "i", "j", "k", _r("v", 7).alias("v"))


# --- reports ------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


@query("convergence_rate", """WITH r AS (SELECT user_id, value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ratio FROM events)
    SELECT user_id, round(avg(ratio), 8) + 0e0 AS rate, count(*) AS n FROM r WHERE ratio > 0 AND ratio < 10 GROUP BY user_id""")
def convergence_rate(spark, sf_dir):
    return report.convergence_rate(_events(spark, sf_dir), "user_id", ("ts", "event_id"), "value").select("user_id", _r("rate", 8).alias("rate"), "n")


@query("convergence_rate_uncapped", """WITH r AS (SELECT user_id, value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ratio FROM events)
    SELECT user_id, round(avg(ratio), 6) + 0e0 AS rate, count(*) AS n FROM r WHERE ratio > 0 GROUP BY user_id""")
def convergence_rate_uncapped(spark, sf_dir):
    return report.convergence_rate(_events(spark, sf_dir), "user_id", ("ts", "event_id"), "value", None).select("user_id", _r("rate").alias("rate"), "n")


@query("descriptive_stats", """SELECT event_type, count(*) AS n, round(min(value), 6) + 0e0 AS low, round(max(value), 6) + 0e0 AS high, round(avg(value), 6) + 0e0 AS mean, round(median(value), 6) + 0e0 AS median, round(stddev_pop(value), 6) + 0e0 AS std,
    round(quantile_cont(value, 0.25), 6) + 0e0 AS p25, round(quantile_cont(value, 0.75), 6) + 0e0 AS p75, round(quantile_cont(value, 0.9), 6) + 0e0 AS p90, round(quantile_cont(value, 0.99), 6) + 0e0 AS p99,
    count(*) FILTER (event_id % 3 = 0) AS marked, round(min(value) FILTER (event_id % 3 = 0), 6) + 0e0 AS marked_min, round(max(value) FILTER (event_id % 3 = 0), 6) + 0e0 AS marked_max FROM events WHERE value > 0 GROUP BY event_type""")
def descriptive_stats(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("hit", F.col("event_id") % 3 == 0)
    out = report.statistics(rows, "event_type", "value", "hit")
    return out.select(*[c if c in ("event_type", "n", "marked") else _r(c).alias(c) for c in out.columns])


_SOLVERS = ("direct", "iterative", "multigrid")


@query("scaling_pivot", """WITH t AS (SELECT p_size AS grid_size, ['direct', 'iterative', 'multigrid'][p_partkey % 3 + 1] AS solver, arg_min(p_retailprice, p_partkey) AS t FROM part GROUP BY 1, 2)
    SELECT grid_size, max(t) FILTER (solver = 'direct') AS direct, max(t) FILTER (solver = 'iterative') AS iterative, max(t) FILTER (solver = 'multigrid') AS multigrid FROM t GROUP BY grid_size""")
def scaling_pivot(spark, sf_dir):
    solver = F.element_at(F.array(*[F.lit(s) for s in _SOLVERS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("grid_size"), solver.alias("solver"), "p_retailprice", "p_partkey")
    return report.pivot_first(rows, "grid_size", "solver", "p_retailprice", _SOLVERS, "p_partkey")


@query("complexity_lines", """WITH s AS (SELECT p_size::DOUBLE AS n, p_retailprice / 977e0 AS t FROM part), b AS (SELECT min(n) AS n0 FROM s), m AS (SELECT n0, avg(t) AS t0 FROM s, b WHERE n = n0 GROUP BY n0)
    SELECT DISTINCT n, round(t0 * (n / n0), 6) + 0e0 AS line0, round(t0 * power(n / n0, 1.5e0), 6) + 0e0 AS line1, round(t0 * power(n / n0, 2e0), 6) + 0e0 AS line2 FROM s, m""")
def complexity_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("n"), (F.col("p_retailprice") / 977.0).alias("t"))
    return report.complexity_lines(rows, "n", "t").select("n", *[_r(f"line{k}").alias(f"line{k}") for k in range(3)])


@query("solver_pairs", """WITH v AS (SELECT vec_id % 5 AS name, (vec_id // 5) * 64 + p AS item, x::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) AS t)
    SELECT a.name AS a, b.name AS b, round(sqrt(sum((a.v - b.v) ** 2)), 6) + 0e0 AS l2, round(sqrt(sum((a.v - b.v) ** 2)) / greatest(sqrt(sum(a.v * a.v)), sqrt(sum(b.v * b.v))), 6) + 0e0 AS relative, round(max(abs(a.v - b.v)), 6) + 0e0 AS largest
    FROM v AS a JOIN v AS b ON a.item = b.item AND a.name < b.name GROUP BY 1, 2""")
def solver_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("name"), F.col("vec_id"), F.posexplode("embedding").alias("p", "x"))
    rows = rows.select("name", (F.floor(F.col("vec_id") / 5) * 64 + F.col("p") + 1).alias("item"), F.col("x").cast("double").alias("v"))
    out = report.pairs(rows, "item", "name", "v")
    return out.select("a", "b", *[_r(c).alias(c) for c in ("l2", "relative", "largest")])


@query("first_last_residual", "SELECT user_id, arg_min(value, row(ts, event_id)) AS first, arg_max(value, row(ts, event_id)) AS last, count(value) AS n FROM events GROUP BY user_id")
def first_last_residual(spark, sf_dir):
    return report.first_last(_events(spark, sf_dir), "user_id", ("ts", "event_id"), "value")


@query("ordered_solvers", "SELECT DISTINCT event_type, coalesce(nullif(list_position(['purchase', 'click'], event_type), 0), 3)::INT AS place FROM events")
def ordered_solvers(spark, sf_dir):
    return _events(spark, sf_dir).select("event_type").distinct().select("event_type", report.preferred_order(F.col("event_type"), ("purchase", "click")).alias("place"))


@query("metric_format", published.ORACLE_SQL["metric_format"])
def metric_format(spark, sf_dir):
    names = ("iterations", "total_ms", "solution_l2_norm", "data_residual", "relative_residual", "time_ms", "qinv_apply_calls")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), report.formatted(name, (F.col("p_size") * 37 + F.col("p_partkey") % 11) / 64.0).alias("text"))


@query("domain_rms", f"SELECT elem, round(sqrt(sum(w * diff * diff) / sum(w)), 6) + 0e0 AS rms FROM ({_ORDER_SAMPLES}) AS s GROUP BY elem")
def domain_rms(spark, sf_dir):
    return report.rms(_order_samples(spark, sf_dir), "elem", "w", "diff").select("elem", _r("rms").alias("rms"))
