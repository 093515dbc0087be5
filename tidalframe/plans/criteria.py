"""Queries of refinement criteria, vetoes, flags, balance and solvers, with hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions import basis
from tidalframe.operators import column, criteria, fit, mesh, solvers, spatial
from tidalframe.plans.fits import _FIELD, _LIST, _field, _r
from tidalframe.plans.meshes import _ASKS, _MESH, _PIXELS, BOX, DEEP, _asks, _pixels, segment_boxes, test_mesh, tree_sql
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


# --- samples of the mesh on the pixel raster: a pixel is 16 wide, depth is its value less 150 ---------------

_DEPTH = f"pixel AS ({_PIXELS}), {_MESH}"
_AT = "LEFT JOIN pixel ON pixel.px = least(63, floor(x / 16e0))::BIGINT AND pixel.py = least(63, floor(y / 16e0))::BIGINT"
_FIVE = f"""spot AS (SELECT leaf, s, CASE s WHEN 0 THEN xmin WHEN 1 THEN xmax WHEN 2 THEN xmin WHEN 3 THEN xmax ELSE (xmin + xmax) / 2e0 END AS x,
        CASE s WHEN 0 THEN ymin WHEN 1 THEN ymin WHEN 2 THEN ymax WHEN 3 THEN ymax ELSE (ymin + ymax) / 2e0 END AS y FROM elem, range(5) AS r(s)),
    five AS (SELECT leaf, s, val::DOUBLE - 150e0 AS depth, coalesce(val::DOUBLE - 150e0 <= 0, TRUE) AS land FROM spot {_AT})"""


def _grid_sql(n: int) -> str:
    return f"""spots{n} AS (SELECT leaf, s, xmin + (s % {n}) / {n - 1}e0 * (xmax - xmin) AS x, ymin + (s // {n}) / {n - 1}e0 * (ymax - ymin) AS y FROM elem, range({n * n}) AS r(s)),
    grid{n} AS (SELECT leaf, s, val::DOUBLE - 150e0 AS depth, coalesce(val::DOUBLE - 150e0 <= 0, TRUE) AS land FROM spots{n} {_AT})"""


def _depths(spark, sf_dir, samples):
    """Samples with the depth of their pixel, and whether they are land; where there is no pixel, there is land."""
    pixels = _pixels(spark, sf_dir).select("px", "py", (F.col("val").cast("double") - 150.0).alias("depth"))
    at = samples.withColumns({"px": F.least(F.lit(63), F.floor(F.col("x") / 16)).cast("long"), "py": F.least(F.lit(63), F.floor(F.col("y") / 16)).cast("long")})
    return at.join(pixels, ["px", "py"], "left").withColumn("land", F.coalesce(F.col("depth") <= 0, F.lit(True)))


def _five(spark, sf_dir):
    return _depths(spark, sf_dir, criteria.five_samples(test_mesh(spark, sf_dir), ("leaf",)))


@query("land_elements", f"WITH {_DEPTH}, {_FIVE} SELECT leaf, bool_and(land) AS land FROM five GROUP BY leaf")
def land_elements(spark, sf_dir):
    return criteria.all_land(_five(spark, sf_dir), ("leaf",))


_G3 = basis.gauss(3)[0]


@query("land_elements_gauss", f"""WITH {_DEPTH}, {_FIVE}, spots AS (SELECT leaf, xmin + {_LIST([float(x) for x in _G3])}[s % 3 + 1] * (xmax - xmin) AS x, ymin + {_LIST([float(x) for x in _G3])}[s // 3 + 1] * (ymax - ymin) AS y FROM elem, range(9) AS r(s)),
    inner_ AS (SELECT leaf, bool_and(abs(CASE WHEN val IS NULL OR val < 150 THEN 0e0 ELSE val::DOUBLE - 150e0 END) <= 1e-6) AS dry FROM spots {_AT} GROUP BY leaf)
    SELECT leaf, bool_and(land) OR any_value(dry) AS land FROM five JOIN inner_ USING (leaf) GROUP BY leaf""")
def land_elements_gauss(spark, sf_dir):
    """Land by corners and centre, or by no depth at any of 3 x 3 Gauss points, where depths end at zero."""
    inner = _depths(spark, sf_dir, fit.gauss_samples(test_mesh(spark, sf_dir), 3, ("leaf",))).withColumn("depth", F.greatest(F.coalesce("depth", F.lit(0.0)), F.lit(0.0)))
    return criteria.land_or_no_depth(_five(spark, sf_dir), inner, ("leaf",))


@query("refine_criteria", f"""WITH {_DEPTH}, {_FIVE}, {_grid_sql(5)},
    a AS (SELECT leaf, max(depth) - min(depth) AS span FROM five GROUP BY leaf), b AS (SELECT leaf, bool_or(land) AND bool_or(NOT land) AS coast FROM grid5 GROUP BY leaf)
    SELECT leaf, coalesce(span / (xmax - xmin) > 1.5e0, FALSE) AS gradient, coalesce(span > 60e0, FALSE) AS bathymetry, coast AND lx < {DEEP} AS coast,
        coalesce(span / (xmax - xmin) > 1.5e0, FALSE) OR coalesce(span > 60e0, FALSE) OR (coast AND lx < {DEEP}) AS refine FROM elem JOIN a USING (leaf) JOIN b USING (leaf)""")
def refine_criteria(spark, sf_dir):
    """Gradient by range over size, range over five samples, wet and dry on 5 x 5 samples below the deepest level, and any of them."""
    leaves = test_mesh(spark, sf_dir)
    span = criteria.value_range(_five(spark, sf_dir), ("leaf",), "depth")
    coast = criteria.mixed(_depths(spark, sf_dir, criteria.grid_samples(leaves, ("leaf",), 5)), ("leaf",))
    rows = leaves.join(span, "leaf").join(coast, "leaf")
    steep = F.coalesce(criteria.steep(F.col("low"), F.col("high"), F.col("xmax") - F.col("xmin"), 1.5), F.lit(False))
    wide = F.coalesce(F.col("high") - F.col("low") > 60.0, F.lit(False))
    near = F.col("coast") & (F.col("lx") < DEEP)
    return rows.select("leaf", steep.alias("gradient"), wide.alias("bathymetry"), near.alias("coast"), criteria.any_of(steep, wide, near).alias("refine"))


@query("generator_criteria", f"""WITH {_DEPTH}, {_grid_sql(3)}, c AS (SELECT leaf, bool_or(coalesce(depth, -1e0) < 2e0) AND bool_or(coalesce(depth, -1e0) >= 2e0) AS coast FROM grid3 GROUP BY leaf),
    m AS (SELECT leaf, least(63, floor((xmin + xmax) / 32e0))::BIGINT AS px, least(63, floor((ymin + ymax) / 32e0))::BIGINT AS py FROM elem),
    g AS (SELECT leaf, (e.val::DOUBLE - w.val) / 32e0 AS dx, (n.val::DOUBLE - s.val) / 32e0 AS dy FROM m LEFT JOIN pixel AS e ON e.px = m.px + 1 AND e.py = m.py LEFT JOIN pixel AS w ON w.px = m.px - 1 AND w.py = m.py
        LEFT JOIN pixel AS n ON n.px = m.px AND n.py = m.py + 1 LEFT JOIN pixel AS s ON s.px = m.px AND s.py = m.py - 1)
    SELECT leaf, xmax - xmin >= 40e0 AND (coast OR coalesce(sqrt(dx * dx + dy * dy) > 3e0, FALSE)) AS wanted FROM elem JOIN c USING (leaf) JOIN g USING (leaf)""")
def generator_criteria(spark, sf_dir):
    """Not below 40 wide; near the coast on 3 x 3 samples, or steep at the centre by central differences."""
    leaves = test_mesh(spark, sf_dir)
    samples = _depths(spark, sf_dir, criteria.grid_samples(leaves, ("leaf",), 3)).withColumn("land", F.coalesce("depth", F.lit(-1.0)) < 2.0)
    coast = criteria.mixed(samples, ("leaf",))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1))])).alias("o")
    middle = lambda c: F.least(F.lit(63), F.floor((F.col(f"{c}min") + F.col(f"{c}max")) / 32)).cast("long")
    asks = leaves.select("leaf", middle("x").alias("x0"), middle("y").alias("y0"), at).select("leaf", "o.n", (F.col("x0") + F.col("o.a")).alias("px"), (F.col("y0") + F.col("o.b")).alias("py"))
    four = asks.join(_pixels(spark, sf_dir), ["px", "py"], "left").groupBy("leaf").pivot("n", ["e", "w", "n", "s"]).agg(F.first(F.col("val").cast("double")))
    rows = leaves.join(coast, "leaf").join(four, "leaf")
    return rows.select("leaf", criteria.generator_wants(F.col("xmax") - F.col("xmin"), F.col("coast"), (F.col("e") - F.col("w")) / 32, (F.col("n") - F.col("s")) / 32, 40.0, 3.0).alias("wanted"))


@query("base_grid_mask", f"WITH {_DEPTH}, {_FIVE} SELECT leaf, coalesce(bool_or(NOT land) FILTER (s = 4), FALSE) OR bool_or(NOT land) AS water FROM five GROUP BY leaf")
def base_grid_mask(spark, sf_dir):
    return criteria.water_cells(_five(spark, sf_dir), ("leaf",))


QUERIES["coast_masks"] = lambda spark, sf_dir: criteria.coast_masks(test_mesh(spark, sf_dir), segment_boxes(spark, sf_dir), ("leaf",), DEEP)


def _coast_sql() -> str:
    from tidalframe.plans.meshes import ORACLE_SQL as MESHES

    head, tail = MESHES["segment_boxes"].rsplit("SELECT DISTINCT leaf FROM t", 1)
    return f"{head}, hit AS (SELECT DISTINCT leaf FROM t{tail}) SELECT leaf, (CASE WHEN hit.leaf IS NOT NULL AND lx < {DEEP} THEN 3 ELSE 0 END)::INT AS mask FROM elem LEFT JOIN hit USING (leaf)"


ORACLE_SQL["coast_masks"] = _coast_sql()


@query("aoi_actions", f"""WITH {_DEPTH}, {_FIVE}, l AS (SELECT leaf, bool_and(land) AS land FROM five GROUP BY leaf),
    a AS (SELECT leaf, lx, (xmin + xmax) / 2e0 BETWEEN 256e0 AND 700e0 AND (ymin + ymax) / 2e0 < 600e0 AS inside, (leaf * 7 % 3 - 1)::INT AS action, land FROM elem JOIN l USING (leaf))
    SELECT leaf, (CASE WHEN inside AND lx < {DEEP} THEN 1 WHEN inside AND action = -1 THEN 0 WHEN action = 1 AND (lx >= {DEEP} OR land) THEN 0 WHEN action = -1 AND lx <= {DEEP - 1} THEN 0 ELSE action END)::INT AS action FROM a""")
def aoi_actions(spark, sf_dir):
    """Actions under level limits and land; in an area of interest the deepest level, and no coarsening."""
    leaves = test_mesh(spark, sf_dir).join(criteria.all_land(_five(spark, sf_dir), ("leaf",)), "leaf").withColumns({"action": (F.col("leaf") * 7 % 3 - 1).cast("int"), "ly": F.col("lx")})
    inside = ((F.col("xmin") + F.col("xmax")) / 2).between(256.0, 700.0) & ((F.col("ymin") + F.col("ymax")) / 2 < 600.0)
    return criteria.constrained_actions(leaves, inside, DEEP, DEEP, DEEP - 1, F.col("land")).select("leaf", "action")


@query("small_polygons", """SELECT c_custkey AS id FROM customer WHERE abs((c_acctbal / 3e0 * (c_acctbal / 7e0) - 100e0 * c_nationkey) + (100e0 * 90e0 - (c_custkey % 50) * (c_acctbal / 7e0)) + ((c_custkey % 50) * 1e0 * c_nationkey - c_acctbal / 3e0 * 90e0)) / 2e0 >= 100000e0""")
def small_polygons(spark, sf_dir):
    """Polygons of an area that is worth keeping."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a = point(F.col("c_acctbal") / 3, F.col("c_nationkey"))
    ring = F.array(a, point(F.lit(100), F.col("c_acctbal") / 7), point(F.col("c_custkey") % 50, F.lit(90)), a)
    return table(spark, sf_dir, "customer").where(spatial.ring_area(ring) >= 100000.0).select(F.col("c_custkey").alias("id"))


@query("marked_flags", "SELECT o_orderkey AS element, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) THEN 1 ELSE 0 END::INT AS marked FROM orders")
def marked_flags(spark, sf_dir):
    marked = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("element"))
    return criteria.with_flag(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("element")), marked, ("element",))


@query("loading_stats", """SELECT (SELECT count(*) FROM part) AS registered, count(*) AS loaded, coalesce(sum(p_size * 4096), 0)::BIGINT AS bytes FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)""")
def loading_stats(spark, sf_dir):
    """Parts as tiles of p_size pages; those that large lines name are loaded."""
    tiles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile"), "p_size")
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("tile"))
    return criteria.loading_stats(tiles, used, "tile", F.col("p_size").cast("long") * 4096)


@query("omega_linear", f"WITH {_FIELD}, d AS (SELECT elem, i, j, sum({_LIST((1 / 6, 5 / 6, 5 / 6, 1 / 6))}[k + 1] * v) AS div FROM f GROUP BY elem, i, j) SELECT elem, i::INT AS i, j::INT AS j, k::INT AS k, round(-(k / 3e0) * div / 40e0, 8) + 0e0 AS omega FROM d, range(4) AS r(k)")
def omega_linear(spark, sf_dir):
    """A linear profile of the vertical velocity, from 0 at the bottom to minus the column's divergence per depth."""
    div = column.depth_average(_field(spark, sf_dir), (1 / 6, 5 / 6, 5 / 6, 1 / 6)).withColumnRenamed("total", "div")
    return column.linear_omega(div, "div", 4, 40.0).select("elem", "i", "j", "k", _r("omega", 8).alias("omega"))


@query("subcycle_average", "SELECT user_id, round(avg(value), 7) + 0e0 AS eta, count(value) AS n FROM events GROUP BY user_id")
def subcycle_average(spark, sf_dir):
    """The mean of a value over the sub-cycles of a step; here a user's events."""
    return column.cycle_mean(table(spark, sf_dir, "events"), ("user_id",), "value").select("user_id", _r("mean", 7).alias("eta"), "n")


@query("scattered_points", "SELECT l_partkey % 16 AS cell, count(*) AS n, round(sum(CASE WHEN l_tax > 0 THEN l_tax ELSE 1e0 END), 4) + 0e0 AS weight FROM lineitem GROUP BY 1")
def scattered_points(spark, sf_dir):
    """Points with weights where they are given, else 1, summed per cell."""
    from tidalframe.sources.files import scattered

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("z"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("w"))
    points = scattered(rows)
    return points.groupBy((F.col("x").cast("long") % 16).alias("cell")).agg(F.count("z").alias("n"), (F.round(F.sum("w"), 4) + 0.0).alias("weight"))


def _coarsen_sql() -> str:
    t = column.parent_nodes()
    values = ", ".join(f"({h}, {r}, {c}, {t[h, r, c]:.17e})" for h in (0, 1) for r in range(4) for c in range(4) if t[h, r, c])
    return f"WITH {_FIELD}, t AS (SELECT * FROM (VALUES {values}) AS x(half, r, c, w)) SELECT elem // 2 AS parent, i::INT AS i, j::INT AS j, r::INT AS k, round(sum(w * v), 7) + 0e0 AS v FROM f JOIN t ON half = elem % 2 AND c = k GROUP BY 1, 2, 3, 4 HAVING count(*) > 0"


@query("coarsen_projection", _coarsen_sql())
def coarsen_projection(spark, sf_dir):
    """Pairs of elements as halves along k of a parent, whose nodes take the value of the half that holds them."""
    halves = _field(spark, sf_dir).withColumns({"half": (F.col("elem") % 2).cast("int"), "parent": F.floor(F.col("elem") / 2).cast("long")})
    return column.coarsen_field(halves, "k").select("parent", "i", "j", "k", _r("v", 7).alias("v"))


def _halves_sql() -> str:
    t = column.child_nodes()
    values = ", ".join(f"({h}, {r}, {c}, {t[h, r, c]:.17e})" for h in (0, 1) for r in range(4) for c in range(4))
    return f"WITH {_FIELD}, t AS (SELECT * FROM (VALUES {values}) AS x(half, r, c, w)) SELECT elem, half::INT AS half, i::INT AS i, j::INT AS j, r::INT AS k, round(sum(w * v), 7) + 0e0 AS v FROM f JOIN t ON c = k GROUP BY elem, half, i, j, r"


ORACLE_SQL["refine_projection"] = _halves_sql()


@query("first_by_key", "SELECT l_orderkey AS size, arg_min(l_suppkey, row(l_linenumber, l_partkey, l_suppkey)) AS supplier FROM lineitem GROUP BY 1")
def first_by_key(spark, sf_dir):
    """One row of each size, the first by line."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("size"), F.col("l_suppkey").alias("supplier"), "l_linenumber", "l_partkey")
    return criteria.first_of_each(rows, ("size",), ("l_linenumber", "l_partkey", "supplier")).select("size", "supplier")


@query("box_filter_or_point", f"""WITH pixel AS ({_PIXELS}), good AS (SELECT * FROM pixel WHERE (px * 7 + py * 3) % 5 = 0), ask AS (SELECT id, floor(px)::BIGINT AS px, floor(py)::BIGINT AS py FROM ({_ASKS}) AS a),
    m AS (SELECT id, avg(val::DOUBLE) AS mean FROM ask JOIN good ON good.px BETWEEN ask.px - 1 AND ask.px + 1 AND good.py BETWEEN ask.py - 1 AND ask.py + 1 GROUP BY id)
    SELECT ask.id, round(coalesce(mean, pixel.val::DOUBLE), 6) + 0e0 AS value FROM ask LEFT JOIN m USING (id) LEFT JOIN pixel ON pixel.px = ask.px AND pixel.py = ask.py""")
def box_filter_or_point(spark, sf_dir):
    """The mean of the valid pixels around a point; where there is none, the pixel at the point."""
    asks = _asks(spark, sf_dir).select("id", F.floor("px").alias("px"), F.floor("py").alias("py"))
    pixels = _pixels(spark, sf_dir).withColumn("val", F.col("val").cast("double"))
    return spatial.box_filter_or_point(asks, pixels, pixels.where((F.col("px") * 7 + F.col("py") * 3) % 5 == 0), ("id",), 1).select("id", _r("value").alias("value"))


# --- balance: what must be split is closed under parents, and under parents of a split cell's neighbours -----

_STOPS = "SELECT (s_suppkey * 131 % 1000)::DOUBLE AS px, (s_suppkey * 57 % 1000)::DOUBLE AS py FROM supplier WHERE s_suppkey % 9 = 0"


@query("balance_centre", f"WITH {tree_sql(_STOPS, 1, 7, 0)} SELECT lx, ix, iy FROM cells")
def balance_centre(spark, sf_dir):
    """Single points refined as deep as it goes, then balanced: coarse cells far around them are split too."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select((F.col("s_suppkey") * 131 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 57 % 1000).cast("double").alias("y"))
    return mesh.balance(materialise(mesh.from_points(rows, BOX, 1, 7, 0, graded=False), "cells"), 7).select("lx", "ix", "iy")


# --- solvers: forty chains of seven unknowns, whose inverse is known in closed form --------------------------

_LOADS = "SELECT l_suppkey % 40 AS system, l_linenumber::BIGINT AS i, sum(l_quantity) / 100e0 AS b FROM lineitem GROUP BY 1, 2"
_CHAIN = f"""WITH b AS ({_LOADS}), n AS (SELECT system, max(i) AS n FROM b GROUP BY 1)
    SELECT p.system, p.i, round(sum(least(p.i, q.i) * (n + 1 - greatest(p.i, q.i)) / (n + 1e0) * q.b), 6) + 0e0 AS v FROM b AS p JOIN b AS q ON p.system = q.system JOIN n ON p.system = n.system GROUP BY p.system, p.i"""


def _loads(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("system"), F.col("l_linenumber").cast("long").alias("i"), "l_quantity")
    return rows.groupBy("system", "i").agg((F.sum("l_quantity") / 100.0).alias("v"))


def _chain(loads, key: str):
    """Second differences with zero beyond both ends: -1, 2, -1."""
    near = loads.select(F.col(key), F.col("i").alias("j"))
    entry = F.explode(F.array(*[F.struct((F.col("i") + d).alias("j"), F.lit(w).alias("v")) for d, w in ((-1, -1.0), (0, 2.0), (1, -1.0))])).alias("e")
    return loads.select(key, "i", entry).select(key, "i", "e.j", "e.v").join(near, [key, "j"])


def _solver(method: str):
    def run(spark, sf_dir):
        loads = _loads(spark, sf_dir)
        return solvers.solve_each(_chain(loads, "system"), loads, "system", method).select("system", "i", _r("v").alias("v"))

    run.__doc__ = f"Each chain's solution by {method}."
    return run


for _method in ("direct", "cg", "pcg", "fcg", "jacobi", "schwarz_multiplicative", "schwarz_additive", "schwarz_coloured", "multigrid"):
    QUERIES[f"solve_{_method}"], ORACLE_SQL[f"solve_{_method}"] = _solver(_method), _CHAIN

_SCHUR = f"""WITH b AS ({_LOADS}), m AS (SELECT system, i % 2 AS odd, sum(b / (1 + i)) / sum(1e0 / (1 + i)) AS y FROM b GROUP BY 1, 2)
    SELECT b.system, i, round((b - y) / (1 + i), 6) + 0e0 AS v FROM b JOIN m ON b.system = m.system AND i % 2 = odd"""


def _schur(kind: str):
    def run(spark, sf_dir):
        loads = _loads(spark, sf_dir)
        energy = loads.select("system", "i", F.col("i").alias("j"), (F.col("i") + 1.0).alias("v"))
        rows = loads.select("system", (F.col("i") % 2).alias("row"), "i", F.lit(1.0).alias("v"))
        return solvers.schur_each(energy, loads, rows, "system", kind).select("system", "i", _r("v").alias("v"))

    run.__doc__ = f"Each system's least energy where odd and even unknowns add up to zero; Schur preconditioner: {kind}."
    return run


for _kind in ("none", "diagonal", "block"):
    QUERIES[f"schur_{_kind}"], ORACLE_SQL[f"schur_{_kind}"] = _schur(_kind), _SCHUR


@query("residual_history", f"""WITH b AS ({_LOADS}) SELECT system, 0::BIGINT AS iteration, round(sqrt(sum(b * b)), 6) + 0e0 AS residual, 1e0 AS relative FROM b GROUP BY system UNION ALL SELECT DISTINCT system, 1::BIGINT, 0e0, 0e0 FROM b""")
def residual_history(spark, sf_dir):
    """Residuals on the way to each chain's direct solution."""
    loads = _loads(spark, sf_dir)
    return solvers.histories(_chain(loads, "system"), loads, "system", "direct").select("system", "iteration", _r("residual").alias("residual"), _r("relative").alias("relative"))


@query("distributed_cg", """WITH b AS (SELECT p_size % 12 + 1 AS i, sum(p_retailprice) / 1000e0 AS b FROM part GROUP BY 1)
    SELECT p.i::BIGINT AS i, round(sum(least(p.i, q.i) * (13 - greatest(p.i, q.i)) / 13e0 * q.b), 5) + 0e0 AS v FROM b AS p, b AS q GROUP BY p.i""")
def distributed_cg(spark, sf_dir):
    """One chain of twelve unknowns by conjugate gradients over tables."""
    loads = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 12 + 1).cast("long").alias("i")).agg((F.sum("p_retailprice") / 1000.0).alias("v")).withColumn("one", F.lit(1))
    return solvers.distributed_cg(_chain(loads, "one"), loads)[0].select("i", _r("v", 5).alias("v"))
