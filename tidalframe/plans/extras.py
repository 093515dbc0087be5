"""Queries of generators, constraints, element faces, time stepping and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions import basis, morton
from tidalframe.functions.dual import COLUMN, SQL, Text
from tidalframe.operators import adaptive, column, fit, mesh, seabed, stepping
from tidalframe.plans import published
from tidalframe.plans.fits import _FIELD, _LIST, _field, _r
from tidalframe.plans.meshes import _EDGES, _MESH, BOX, DEEP, test_mesh
from tidalframe.sources import synthetic
from tidalframe.sources.tables import materialise, table
from tidalframe.streaming import triggers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_X, _Y = Text("x"), Text("y")
_SIDE = "side AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM orders)"
_GRID = f"{_SIDE}, g AS (SELECT i % n AS ix, i // n AS iy, (i % n) * (100e0 / (n - 1)) AS x, (i // n) * (100e0 / (n - 1)) AS y FROM (SELECT n, unnest(range(n * n)) AS i FROM side) AS t)"


def _grid(spark, sf_dir):
    """A square grid with about as many points as there are orders."""
    return synthetic.grid(spark, int(table(spark, sf_dir, "orders").count() ** 0.5))


@query("synthetic_depths", published.ORACLE_SQL["synthetic_depths"])
def synthetic_depths(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return _grid(spark, sf_dir).select("ix", "iy", *[COLUMN.round(f(COLUMN, x, y), 6).alias(n) for n, f in synthetic.DEPTHS.items()], COLUMN.round(synthetic.bump(COLUMN, x, y), 6).alias("bump"))


def _initial(m, x, y):
    h = m.lit(50.0)
    kelvin, lock = synthetic.kelvin_wave(m, x, y, h, 1.0, 0.01, 1e-1), synthetic.lock_exchange(m, x, y, h, 49.0)
    return {"eta": kelvin["eta"], "u": kelvin["u"], "t": lock["t"], "rest": synthetic.quiescent(m, x, y, h)["s"]}


@query("initial_states", f"WITH {_GRID} SELECT ix, iy, {', '.join(f'{SQL.round(e, 9)} AS {n}' for n, e in _initial(SQL, _X, _Y).items())} FROM g")
def initial_states(spark, sf_dir):
    return _grid(spark, sf_dir).select("ix", "iy", *[COLUMN.round(e, 9).alias(n) for n, e in _initial(COLUMN, F.col("x"), F.col("y")).items()])


def _hanging_sql() -> str:
    rows = [(h, r, c, basis.extraction(3, h)[r, c]) for h in (0, 1) for r in range(4) if r != (0 if h == 0 else 3) for c in range(4) if basis.extraction(3, h)[r, c]]
    values = ", ".join(f"({h}, {r}, {c}, {w:.17e})" for h, r, c, w in rows)
    place = lambda e, k: f"(CASE {e} WHEN 0 THEN {k} * 4 WHEN 1 THEN {k} * 4 + 3 WHEN 2 THEN {k} ELSE {k} + 12 END)::INT"
    return f"""WITH {_MESH}, {_EDGES}, k AS (SELECT *, count(*) OVER (PARTITION BY leaf, edge) AS n FROM met), x AS (SELECT * FROM (VALUES {values}) AS t(half, r, c, w))
        SELECT leaf, edge, {place('edge', 'r')} AS local, neighbour AS master_leaf, {place('neighbour_edge', 'c')} AS master_local, w FROM k JOIN x ON half = CASE WHEN lo + hi < nlo + nhi THEN 0 ELSE 1 END WHERE n = 1 AND nhi - nlo > (hi - lo) * 1.5e0"""


@query("hanging_constraints", _hanging_sql())
def hanging_constraints(spark, sf_dir):
    return fit.hanging_constraints(mesh.adjacency(test_mesh(spark, sf_dir), DEEP), 3)


@query("children_mean", f"WITH {_MESH} SELECT lx - 1 AS lx, ix // 2 AS ix, iy // 2 AS iy, avg(leaf * 1e0) AS v FROM elem GROUP BY ALL")
def children_mean(spark, sf_dir):
    return fit.children_mean(test_mesh(spark, sf_dir).withColumn("v", F.col("leaf").cast("double"))).select("lx", "ix", "iy", "v")


@query("conforming_dofs", f"""WITH {_MESH}, n AS (SELECT leaf AS elem, a AS local, xmin + (a % 2) * (xmax - xmin) AS x, ymin + (a // 2) * (ymax - ymin) AS y FROM elem, range(4) AS r(a))
    SELECT elem, local::INT AS local, dense_rank() OVER (ORDER BY x, y) - 1 AS dof FROM n""")
def conforming_dofs(spark, sf_dir):
    a = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    rows = test_mesh(spark, sf_dir).withColumn("local", a)
    x = F.col("xmin") + (F.col("local") % 2) * (F.col("xmax") - F.col("xmin"))
    y = F.col("ymin") + F.floor(F.col("local") / 2) * (F.col("ymax") - F.col("ymin"))
    return fit.conforming_dofs(rows.select(F.col("leaf").alias("elem"), "local", x.alias("x"), y.alias("y")))


@query("stack_constraints", """SELECT n_nationkey::BIGINT AS row, n_regionkey::BIGINT AS col, 1e0 AS v FROM nation UNION ALL SELECT r_regionkey + 25, r_regionkey * 2, 0.5e0 FROM region""")
def stack_constraints(spark, sf_dir):
    one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_regionkey").cast("long").alias("col"), F.lit(1.0).alias("v"))
    two = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("row"), (F.col("r_regionkey") * 2).cast("long").alias("col"), F.lit(0.5).alias("v"))
    return fit.stack((one, 25), (two, 5))


@query("boundary_lookup", """WITH b AS (SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS kind FROM nation WHERE n_regionkey < 4 GROUP BY 1) SELECT c_custkey AS id, c_nationkey % 5 AS k, kind FROM customer LEFT JOIN b ON c_nationkey % 5 = k""")
def boundary_lookup(spark, sf_dir):
    rules = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_regionkey").alias("k"), "n_nationkey", F.col("n_name").alias("kind"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("k"))
    return fit.first_match(rows, rules, "k", "n_nationkey", "kind").select("id", "k", "kind")


@query("migrate_some", "SELECT part, leaf FROM (SELECT o_custkey % 9 AS part, o_orderkey AS leaf, row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderkey) AS r FROM orders) AS t WHERE r <= 20")
def migrate_some(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("part"), F.col("o_orderkey").alias("leaf"))
    return fit.take_each(rows, "part", ("leaf",), 20)


@query("region_remove", "SELECT p_partkey AS id, (p_size & ~4)::INT AS flags, (p_size & 4) <> 0 AS had FROM part")
def region_remove(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").bitwiseAND(F.lit(~4)).alias("flags"), (F.col("p_size").bitwiseAND(F.lit(4)) != 0).alias("had"))


_W = [float(x) for x in basis.lobatto(4)[1]]


@query("mass_integral", f"WITH {_FIELD} SELECT elem, round(sum({_LIST(_W)}[i + 1] * {_LIST(_W)}[j + 1] * {_LIST(_W)}[k + 1] * v), 7) + 0e0 AS total FROM f GROUP BY elem")
def mass_integral(spark, sf_dir):
    return column.mass(_field(spark, sf_dir)).groupBy("elem").agg(_r(F.sum("v"), 7).alias("total"))


_FACES = """s AS (SELECT elem, 0 AS face, j AS a, k AS b, v FROM f WHERE i = 0 UNION ALL SELECT elem, 1, j, k, v FROM f WHERE i = 3 UNION ALL SELECT elem, 2, i, k, v FROM f WHERE j = 0
    UNION ALL SELECT elem, 3, i, k, v FROM f WHERE j = 3 UNION ALL SELECT elem, 4, i, j, v FROM f WHERE k = 0 UNION ALL SELECT elem, 5, i, j, v FROM f WHERE k = 3)"""


@query("interface_lift", f"""WITH {_FIELD}, {_FACES}, j AS (SELECT p.elem, p.face, p.a, p.b, 0.5e0 * (q.v - p.v) * {_LIST(_W)}[p.a + 1] * {_LIST(_W)}[p.b + 1] AS v FROM s AS p JOIN s AS q ON p.a = q.a AND p.b = q.b
        AND ((p.face = 1 AND q.face = 0 AND q.elem = p.elem + 1) OR (p.face = 0 AND q.face = 1 AND q.elem = p.elem - 1)))
    SELECT elem, (CASE face WHEN 1 THEN 3 ELSE 0 END)::INT AS i, a::INT AS j, b::INT AS k, round(sum(v), 8) + 0e0 AS v FROM j GROUP BY ALL""")
def interface_lift(spark, sf_dir):
    """Central jumps across a row of elements that follow each other along i, put on the face nodes."""
    faces = column.face_values(_field(spark, sf_dir))
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("elem"))
    pairs = ids.select("elem", F.explode(F.array(F.struct(F.lit(1).alias("face"), (F.col("elem") + 1).alias("neighbour"), F.lit(0).alias("neighbour_face")), F.struct(F.lit(0).alias("face"), (F.col("elem") - 1).alias("neighbour"), F.lit(1).alias("neighbour_face")))).alias("p")).select("elem", "p.*")
    return column.lift(column.interface_jumps(faces, pairs), 0.5 * (F.col("outer") - F.col("inner"))).select("elem", "i", "j", "k", _r("v", 8).alias("v"))


def _mortar_sql() -> str:
    t = column.child_nodes()[0]
    values = ", ".join(f"({r}, {c}, {t[r, c]:.17e})" for r in range(4) for c in range(4))
    return f"WITH {_FIELD}, {_FACES}, t AS (SELECT * FROM (VALUES {values}) AS x(r, c, w)) SELECT elem, face::INT AS face, r::INT AS a, b::INT AS b, round(sum(w * v), 8) + 0e0 AS v FROM s JOIN t ON a = c WHERE face = 1 GROUP BY ALL"


@query("mortar_projection", _mortar_sql())
def mortar_projection(spark, sf_dir):
    return column.mortar(column.face_values(_field(spark, sf_dir)).where("face = 1"), 0).select("elem", "face", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), _r("v", 8).alias("v"))


@query("continuity_residual", f"WITH {_FIELD} SELECT elem, round(sqrt(avg((v + k * 0.1e0) ** 2)), 8) + 0e0 AS rms FROM f GROUP BY elem")
def continuity_residual(spark, sf_dir):
    d = F.col("v") + F.col("k") * 0.1
    return _field(spark, sf_dir).groupBy("elem").agg(_r(F.sqrt(F.avg(d * d)), 8).alias("rms"))


@query("rk_decay", """SELECT p_partkey AS id, round(y * (1e0 - d), 9) + 0e0 AS euler, round(y * (1e0 - d + d * d / 2e0), 9) + 0e0 AS rk2, round(y * (1e0 - d + d * d / 2e0 - d * d * d / 6e0), 9) + 0e0 AS ssprk3,
    round(y * (1e0 - d + d * d / 2e0 - d * d * d / 6e0 + d * d * d * d / 24e0), 9) + 0e0 AS rk4 FROM (SELECT p_partkey, p_retailprice / 977e0 AS y, 0.3e0 AS d FROM part) AS t""")
def rk_decay(spark, sf_dir):
    """One step of y' = -3 y by each method; the oracle is the methods' stability polynomial."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 977.0).alias("y"), F.lit(0.0).alias("t"))
    return rows.select("id", *[_r(stepping.step_columns(k, lambda t, y: -3.0 * y, "t", "y", 0.1), 9).alias(k) for k in ("euler", "rk2", "ssprk3", "rk4")])


@query("mode_split_step")
def mode_split_step(spark, sf_dir):
    """One split step of every column; tests check that deviations stay and means follow the short steps."""
    state = _field(spark, sf_dir).select("elem", "i", "j", "k", F.col("v").alias("u"), F.lit(0.25).alias("eta"))
    out = stepping.split_modes(state, (1 / 6, 5 / 6, 5 / 6, 1 / 6), 2.0, 8, 40.0)
    return out.select("elem", "i", "j", "k", _r("u", 8).alias("u"), _r("eta", 8).alias("eta"))


@query("interval_triggers", """WITH RECURSIVE s AS (SELECT user_id AS key, (epoch(ts) - 1704067200)::DOUBLE / 3600e0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT key, t, n, t >= 24e0 AS hit, 24e0 AS due, CASE WHEN t >= 24e0 THEN 48e0 ELSE 24e0 END AS next FROM s WHERE n = 1
        UNION ALL SELECT s.key, s.t, s.n, s.t >= w.next, w.next, CASE WHEN s.t >= w.next THEN w.next + 24e0 ELSE w.next END FROM w JOIN s ON s.key = w.key AND s.n = w.n + 1)
    SELECT key, round(t, 6) + 0e0 AS t, due FROM w WHERE hit""")
def interval_triggers(spark, sf_dir):
    """Steps that fire a daily output: at most one each, without catching up."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (seconds / 3600.0).alias("t"))
    return triggers.triggers_batch(steps, 24.0).select("key", _r("t").alias("t"), "due")


@query("adaptive_history")
def adaptive_history(spark, sf_dir):
    """History of an adaptive fit of a seamount's depths at line items' points; tests hold its solutions against dense ones."""
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1031).alias("a"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1024).alias("b")).distinct()
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    samples = points.select((F.col("a") * 2048 + F.col("b")).alias("id"), x.alias("x"), y.alias("y"), synthetic.seamount(COLUMN, x * (100.0 / 1024), y * (100.0 / 1024)).alias("z"), F.lit(1.0).alias("w"))
    _, history = adaptive.adaptive_fit(samples, BOX, 2, 7, threshold=1.0, most_rounds=3, tolerance=1e-6)
    frame = adaptive.history_frame(spark, history)
    return frame.select("round", "elements", "unknowns", *[_r(c, 4).alias(c) for c in ("most", "mean")], "marked", "reason")


_CUBES = """p3 AS (SELECT l_partkey % 1031 AS px, (l_suppkey * 37 + l_orderkey) % 1024 AS py, l_quantity * 20e0 AS pz FROM lineitem),
    f3 AS (SELECT least(floor(px / 32e0), 31)::BIGINT AS x, least(floor(py / 32e0), 31)::BIGINT AS y, least(floor(pz / 32e0), 31)::BIGINT AS z FROM p3 WHERE px <= 1024),
    s3 AS (SELECT l AS level, x >> (5 - l) AS ix, y >> (5 - l) AS iy, z >> (5 - l) AS iz FROM f3, range(2, 5) AS r(l) GROUP BY 1, 2, 3, 4 HAVING count(*) > 12),
    c3 AS (SELECT * FROM (SELECT 2 AS level, i % 4 AS ix, i // 4 % 4 AS iy, i // 16 AS iz FROM range(64) AS r(i)
        UNION ALL SELECT level + 1, ix * 2 + a, iy * 2 + b, iz * 2 + c FROM s3, range(2) AS p(a), range(2) AS q(b), range(2) AS s(c)) AS every ANTI JOIN s3 USING (level, ix, iy, iz)),
    e3 AS (SELECT ((level * 32 + iz) * 32 + iy) * 32 + ix AS leaf, *, 32 >> level AS w FROM c3)"""


def _cubes(spark, sf_dir):
    """The octree of line items as points, from level 2 to 5."""
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1031).cast("double").alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1024).cast("double").alias("y"), (F.col("l_quantity") * 20.0).alias("z"))
    return materialise(mesh.octree_from_points(points, (*BOX, 0.0, 1024.0), 2, 5, 12), "octree")


def _face_sql() -> str:
    meets = []
    for d, (axis, (a, b)) in enumerate((("ix", ("iy", "iz")), ("iy", ("ix", "iz")), ("iz", ("ix", "iy")))):
        across = " AND ".join(f"p.{c} * p.w < (q.{c} + 1) * q.w AND q.{c} * q.w < (p.{c} + 1) * p.w" for c in (a, b))
        meets.append(f"SELECT p.leaf, {2 * d + 1} AS face, p.level AS l, q.level AS m, q.leaf AS neighbour FROM e3 AS p JOIN e3 AS q ON (p.{axis} + 1) * p.w = q.{axis} * q.w AND {across}")
        meets.append(f"SELECT p.leaf, {2 * d} AS face, p.level AS l, q.level AS m, q.leaf AS neighbour FROM e3 AS p JOIN e3 AS q ON p.{axis} * p.w = (q.{axis} + 1) * q.w AND {across}")
    return f"""WITH {_CUBES}, met AS ({' UNION ALL '.join(meets)}), every AS (SELECT leaf, f AS face FROM e3, range(6) AS r(f))
        SELECT leaf, face::INT AS face, CASE WHEN l = m THEN 'same_level' WHEN l > m THEN 'fine_to_coarse' ELSE 'coarse_to_fine' END AS kind, neighbour FROM met
        UNION ALL SELECT leaf, face::INT, 'boundary', NULL FROM every ANTI JOIN met USING (leaf, face)"""


@query("face_adjacency", _face_sql())
def face_adjacency(spark, sf_dir):
    return mesh.face_adjacency(_cubes(spark, sf_dir), 5)


_BOTTOM = f"{_CUBES}, low AS (SELECT leaf, level AS lx, ix, iy FROM e3 WHERE iz = 0), quads AS (SELECT row_number() OVER (ORDER BY {morton.encode(SQL, Text('(ix << (5 - lx))'), Text('(iy << (5 - lx))'), bits=8)}, lx) - 1 AS quad, leaf FROM low)"


@query("bottom_links", f"WITH {_BOTTOM} SELECT leaf, quad FROM quads")
def bottom_links(spark, sf_dir):
    """The lowest layer of the octree and the numbered quadtree cells that it stands on."""
    cubes = _cubes(spark, sf_dir)
    low = cubes.where("iz = 0").select(F.col("level").alias("lx"), F.col("level").alias("ly"), "ix", "iy")
    return mesh.bottom_links(cubes, mesh.numbered(low, 5))


@query("locate_points_3d", f"""WITH {_CUBES}, p AS (SELECT DISTINCT px, py, pz FROM p3), a1 AS (SELECT *, unnest(list_distinct([floor(px * (1 << l) / 1024e0), ceil(px * (1 << l) / 1024e0) - 1]))::BIGINT AS ix FROM p, range(2, 6) AS r(l)),
    a2 AS (SELECT *, unnest(list_distinct([floor(py * (1 << l) / 1024e0), ceil(py * (1 << l) / 1024e0) - 1]))::BIGINT AS iy FROM a1),
    a3 AS (SELECT *, unnest(list_distinct([floor(pz * (1 << l) / 1024e0), ceil(pz * (1 << l) / 1024e0) - 1]))::BIGINT AS iz FROM a2),
    hit AS (SELECT px, py, pz, min(leaf) AS leaf FROM a3 JOIN e3 ON l = level AND a3.ix = e3.ix AND a3.iy = e3.iy AND a3.iz = e3.iz GROUP BY 1, 2, 3)
    SELECT px, py, pz, coalesce(leaf, -1) AS leaf FROM p LEFT JOIN hit USING (px, py, pz)""")
def locate_points_3d(spark, sf_dir):
    """The octree cell that holds each point; on shared faces the lowest."""
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1031).alias("px"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1024).alias("py"), (F.col("l_quantity") * 20.0).alias("pz")).distinct()
    points = points.withColumns({c: F.col(f"p{c}").cast("double") for c in "xyz"})
    return mesh.locate(points, _cubes(spark, sf_dir).withColumnRenamed("level", "lx"), (*BOX, 0.0, 1024.0), range(2, 6), ("px", "py", "pz"), ("x", "y", "z"))


@query("seabed_elements", f"""WITH {_BOTTOM}, p AS (SELECT DISTINCT px, py FROM p3), a1 AS (SELECT *, unnest(list_distinct([floor(px * (1 << l) / 1024e0), ceil(px * (1 << l) / 1024e0) - 1]))::BIGINT AS ix FROM p, range(2, 6) AS r(l)),
    a2 AS (SELECT *, unnest(list_distinct([floor(py * (1 << l) / 1024e0), ceil(py * (1 << l) / 1024e0) - 1]))::BIGINT AS iy FROM a1),
    hit AS (SELECT px, py, min(quad) AS element, arg_min(leaf, quad) AS cell FROM a2 JOIN low ON l = lx AND a2.ix = low.ix AND a2.iy = low.iy JOIN quads USING (leaf) GROUP BY 1, 2)
    SELECT px, py, coalesce(element, -1) AS element, coalesce(cell, -1) AS cell FROM p LEFT JOIN hit USING (px, py)""")
def seabed_elements(spark, sf_dir):
    """The seabed element under each point and the octree cell that stands on it."""
    cubes = _cubes(spark, sf_dir)
    low = cubes.where("iz = 0").select(F.col("level").alias("lx"), F.col("level").alias("ly"), "ix", "iy", F.col("leaf").alias("cell"))
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1031).alias("px"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1024).alias("py")).distinct()
    points = points.withColumns({c: F.col(f"p{c}").cast("double") for c in "xy"})
    return seabed.find(points, mesh.numbered(low, 5).select("cell", F.col("leaf").alias("element"), "lx", "ix", "iy"), BOX, range(2, 6), ("px", "py"))


@query("graded_mesh", """WITH RECURSIVE deep AS (SELECT floor(log2(count(*)))::INT AS d FROM customer), t AS (SELECT 0 AS lx, 0 AS ix, 0 AS iy, d FROM deep UNION ALL SELECT lx + 1, ix * 2 + a, iy * 2 + b, d FROM t, range(2) AS p(a), range(2) AS q(b)
        WHERE lx < d AND ix * 2 <= 2 ** lx AND (ix + 1) * 2 >= 2 ** lx AND iy * 2 <= 2 ** lx AND (iy + 1) * 2 >= 2 ** lx)
    SELECT lx, ix::BIGINT AS ix, iy::BIGINT AS iy FROM t WHERE NOT (lx < d AND ix * 2 <= 2 ** lx AND (ix + 1) * 2 >= 2 ** lx AND iy * 2 <= 2 ** lx AND (iy + 1) * 2 >= 2 ** lx)""")
def graded_mesh(spark, sf_dir):
    """Refined towards the centre by as many levels as the number of customers has bits."""
    return mesh.graded(spark, table(spark, sf_dir, "customer").count().bit_length() - 1, BOX).select("lx", "ix", "iy")


@query("constraint_violation", "SELECT round(sqrt(sum(r * r)), 8) + 0e0 AS norm FROM (SELECT s_nationkey, sum(s_acctbal / 977e0 * sin(s_suppkey * 1e0)) AS r FROM supplier GROUP BY 1) AS t")
def constraint_violation(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("row"), F.col("s_suppkey").alias("col"), (F.col("s_acctbal") / 977.0).alias("v"))
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.sin(F.col("s_suppkey").cast("double")).alias("v"))
    return fit.violation(rows, x).select(_r("norm", 8).alias("norm"))


@query("gradient_indicator", f"""WITH {_FIELD}, m AS (SELECT elem, max(v) - min(v) AS m FROM f GROUP BY elem), i AS (SELECT elem, m / (SELECT max(m) FROM m) AS i FROM m)
    SELECT elem, round(i, 8) + 0e0 AS indicator, CASE WHEN i > 0.9e0 THEN 1 WHEN i < 0.6e0 THEN -1 ELSE 0 END AS action FROM i""")
def gradient_indicator(spark, sf_dir):
    metric = _field(spark, sf_dir).groupBy("elem").agg((F.max("v") - F.min("v")).alias("m"))
    return fit.indicator_marks(metric, "elem", "m", 0.9, 0.6).select("elem", _r("indicator", 8).alias("indicator"), "action")


@query("slope_constraints", """WITH l AS (SELECT (1 << floor(log2(sqrt(count(*))))::INT)::BIGINT AS n FROM customer), c AS (SELECT i AS leaf, i % n AS ix, i // n AS iy, n FROM (SELECT n, unnest(range(n * n)) AS i FROM l) AS s), t AS (SELECT * FROM (VALUES (2, -1e0), (3, 2e0), (4, -1e0)) AS x(k, v))
    SELECT leaf * 4 + r AS row, (iy * 3 + r) * (3 * n + 1) + ix * 3 + k AS col, v FROM c, t, range(4) AS q(r) WHERE ix < n - 1""")
def slope_constraints(spark, sf_dir):
    """Slopes agree across the vertical edges of a square mesh of cubic cells, about as many as there are customers."""
    level = (table(spark, sf_dir, "customer").count().bit_length() - 1) // 2
    n = 1 << level
    cells = mesh.uniform(spark, level, level).withColumn("leaf", F.col("iy") * n + F.col("ix"))
    local = F.explode(F.sequence(F.lit(0), F.lit(15)))
    dofs = cells.select(F.col("leaf").alias("elem"), "ix", "iy", local.alias("local"))
    dofs = dofs.select("elem", "local", ((F.col("iy") * 3 + F.floor(F.col("local") / 4)) * (3 * n + 1) + F.col("ix") * 3 + F.col("local") % 4).cast("long").alias("dof"))
    return fit.slope_jumps(dofs, mesh.adjacency(cells, level), 3)


def _states(spark, sf_dir):
    """A state from each embedding: every field is a simple function of its values."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    of = lambda a, b: F.transform(e, lambda x: a * x + b)
    fields = {"h": of(2.0, 20.0), "u": of(1.0, 0.0), "v": of(-0.5, 0.1), "omega": of(0.25, 0.0), "eta": of(0.1, 0.0), "t": of(3.0, 10.0), "s": of(0.5, 35.0), "f": of(0.0, 0.01)}
    return table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(n) for n, c in fields.items()])


def _tendency_sql() -> str:
    d = basis.derivative_matrix(basis.lobatto(4)[0])
    values = ", ".join(f"({r}, {c}, {d[r, c]:.17e})" for r in range(4) for c in range(4))
    state = "s AS (SELECT elem, i, j, k, 2e0 * v + 20e0 AS h, v AS u, -0.5e0 * v + 0.1e0 AS w, 0.25e0 * v AS o, 0.1e0 * v AS eta, 3e0 * v + 10e0 AS t FROM f)"
    along = lambda axis, what: f"(SELECT elem, {', '.join(a if a != axis else f'd.r AS {axis}' for a in 'ijk')}, {', '.join(f'sum(d.x * {e}) AS {n}' for n, e in what.items())} FROM s JOIN d ON s.{axis} = d.c GROUP BY ALL)"
    x = along("i", {"u1": "h * u * u", "t1": "h * t * u", "e1": "eta"})
    y = along("j", {"u2": "h * u * w", "t2": "h * t * w"})
    z = along("k", {"u3": "h * u * o", "t3": "h * t * o"})
    return f"""WITH {_FIELD}, {state}, d AS (SELECT * FROM (VALUES {values}) AS t(r, c, x))
        SELECT elem AS vec_id, (i + 4 * j + 16 * k)::INT AS node, round(-(u1 + u2 + u3) + 0.01e0 * h * w - 9.81e0 * h * e1, 6) + 0e0 AS dhu, round(-(t1 + t2 + t3), 6) + 0e0 AS dht
        FROM s JOIN {x} AS px USING (elem, i, j, k) JOIN {y} AS py USING (elem, i, j, k) JOIN {z} AS pz USING (elem, i, j, k)"""


@query("primitive_tendencies", _tendency_sql())
def primitive_tendencies(spark, sf_dir):
    from tidalframe.operators import tendencies

    out = tendencies.primitive(_states(spark, sf_dir), "vec_id").select("vec_id", F.posexplode(F.arrays_zip("dhu", "dht")).alias("node", "x"))
    return out.select("vec_id", "node", _r("x.dhu").alias("dhu"), _r("x.dht").alias("dht"))


@query("adapt_cycle", f"""WITH {_MESH}, a AS (SELECT *, leaf * 1e0 AS v, CASE WHEN leaf % 11 = 0 THEN 1 WHEN leaf % 7 <> 0 THEN -1 ELSE 0 END AS action FROM elem),
    f AS (SELECT lx, ix // 2 AS px, iy // 2 AS py, avg(v) AS v FROM a WHERE action = -1 GROUP BY ALL HAVING count(*) = 4)
    SELECT a.lx, a.ix, a.iy, a.v FROM a LEFT JOIN f ON a.action = -1 AND a.lx = f.lx AND a.ix // 2 = px AND a.iy // 2 = py WHERE px IS NULL AND NOT (action = 1 AND a.lx < 6)
    UNION ALL SELECT lx + 1, ix * 2 + p.i, iy * 2 + q.i, v FROM a, range(2) AS p(i), range(2) AS q(i) WHERE action = 1 AND lx < 6 UNION ALL SELECT lx - 1, px, py, v FROM f""")
def adapt_cycle(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir).withColumn("v", F.col("leaf").cast("double"))
    actions = leaves.withColumn("action", F.when(F.col("leaf") % 11 == 0, 1).when(F.col("leaf") % 7 != 0, -1).otherwise(0))
    return mesh.adapt_cycle(leaves, actions, 6).select("lx", "ix", "iy", "v")
