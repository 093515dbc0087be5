"""Queries over meshes, points, polygons and rasters, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions import morton
from tidalframe.functions.dual import SQL, Text
from tidalframe.operators import mesh, spatial
from tidalframe.sources.tables import materialise, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The test mesh on [0, 1024] squared: 16 x 16 cells, split where they hold more than MOST of the points of line items, down to DEEP, and graded.
BOX, BASE, DEEP, MOST = (0.0, 1024.0, 0.0, 1024.0), 4, 8, 4
LEVELS = tuple(range(BASE, DEEP + 1))
_PATH = f"{morton.encode(SQL, Text(f'(ix << ({DEEP} - lx))'), Text(f'(iy << ({DEEP} - lx))'), bits=8)}"


def tree_sql(points: str, base: int, deep: int, most: int, graded: bool = True) -> str:
    """``cells`` (lx, ix, iy) of the mesh of ``points`` (px, py); every level's splits follow from the finer level's."""
    side = 1 << deep
    out = [
        f"mp AS (SELECT least(floor(px / {1024 / side}e0), {side - 1})::BIGINT AS fx, least(floor(py / {1024 / side}e0), {side - 1})::BIGINT AS fy FROM ({points}) AS p WHERE px BETWEEN 0 AND 1024 AND py BETWEEN 0 AND 1024)",
        f"mh AS (SELECT l AS lx, fx >> ({deep} - l) AS ix, fy >> ({deep} - l) AS iy FROM mp, range({base}, {deep}) AS r(l) GROUP BY 1, 2, 3 HAVING count(*) > {most})",
        "near4(a, b) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))",
    ]
    for level in range(deep - 1, base - 1, -1):
        more = f" UNION SELECT (ix + a) >> 1, (iy + b) >> 1 FROM split{level + 1}, near4 WHERE ix + a BETWEEN 0 AND {(2 << level) - 1} AND iy + b BETWEEN 0 AND {(2 << level) - 1}" if graded and level < deep - 1 else ""
        out.append(f"split{level} AS (SELECT ix, iy FROM mh WHERE lx = {level}{more})")
    out.append("splits AS (" + " UNION ALL ".join(f"SELECT {level} AS lx, ix, iy FROM split{level}" for level in range(base, deep)) + ")")
    out.append(f"""cells AS (SELECT * FROM (SELECT {base} AS lx, i % {1 << base} AS ix, i // {1 << base} AS iy FROM range({1 << 2 * base}) AS r(i)
        UNION ALL SELECT lx + 1, ix * 2 + a, iy * 2 + b FROM splits, range(2) AS p(a), range(2) AS q(b)) AS every ANTI JOIN splits USING (lx, ix, iy))""")
    return ",\n    ".join(out)


_POINT_SQL = "SELECT DISTINCT l_partkey % 1031 AS px, (l_suppkey * 37 + l_orderkey) % 1024 AS py FROM lineitem"


_MESH = f"""{tree_sql(_POINT_SQL, BASE, DEEP, MOST)},
    elem AS (SELECT row_number() OVER (ORDER BY {_PATH}, lx) - 1 AS leaf, lx, ix, iy, ix * 1024e0 / 2 ** lx AS xmin, (ix + 1) * 1024e0 / 2 ** lx AS xmax,
        iy * 1024e0 / 2 ** lx AS ymin, (iy + 1) * 1024e0 / 2 ** lx AS ymax FROM cells)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def test_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with numbers and boxes, as a table."""
    cells = materialise(mesh.from_points(_points(spark, sf_dir), BOX, BASE, DEEP, MOST), "cells")
    return materialise(mesh.with_boxes(mesh.numbered(cells, DEEP), BOX), "mesh")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1031).alias("px"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1024).alias("py")).distinct()
    return rows.withColumns({"x": F.col("px").cast("double"), "y": F.col("py").cast("double")})


@query("uniform_mesh", f"""WITH l AS (SELECT floor(log2(sqrt(count(*))))::INT AS l FROM customer)
    SELECT i % (1 << l) AS ix, i // (1 << l) AS iy, (i % (1 << l)) * 1024e0 / (1 << l) AS xmin, (i // (1 << l)) * 1024e0 / (1 << (l - 1)) AS ymin,
    {morton.encode(SQL, Text('(i % (1 << l))'), Text('(i // (1 << l))'), bits=12)} AS code FROM (SELECT l, unnest(range(1 << (2 * l - 1))) AS i FROM l) AS t""")
def uniform_mesh(spark, sf_dir):
    """Cells of one level, about half as many as there are customers."""
    from tidalframe.functions.dual import COLUMN

    level = (table(spark, sf_dir, "customer").count().bit_length() - 1) // 2
    cells = mesh.with_boxes(mesh.uniform(spark, level, level - 1), BOX)
    return cells.select("ix", "iy", "xmin", "ymin", morton.encode(COLUMN, F.col("ix"), F.col("iy"), bits=12).alias("code"))


@query("leaf_numbering", f"WITH {_MESH} SELECT leaf, lx, ix, iy, xmin, xmax, ymin, ymax FROM elem")
def leaf_numbering(spark, sf_dir):
    return test_mesh(spark, sf_dir).select("leaf", "lx", "ix", "iy", "xmin", "xmax", "ymin", "ymax")


_LOCATED = f"""p AS ({_POINT_SQL}), ask AS (SELECT px, py, l AS lx, unnest(list_distinct([floor(px * (1 << l) / 1024e0), ceil(px * (1 << l) / 1024e0) - 1]))::BIGINT AS ix FROM p, range({BASE}, {DEEP + 1}) AS r(l)),
    asks AS (SELECT *, unnest(list_distinct([floor(py * (1 << lx) / 1024e0), ceil(py * (1 << lx) / 1024e0) - 1]))::BIGINT AS iy FROM ask),
    hit AS (SELECT px, py, min(leaf) AS leaf FROM asks JOIN elem USING (lx, ix, iy) GROUP BY px, py)"""


@query("locate_points", f"WITH {_MESH}, {_LOCATED} SELECT px, py, coalesce(leaf, -1) AS leaf FROM p LEFT JOIN hit USING (px, py)")
def locate_points(spark, sf_dir):
    return mesh.locate(_points(spark, sf_dir), test_mesh(spark, sf_dir), BOX, LEVELS, ("px", "py"))


@query("locate_or_nearest", f"""WITH {_MESH}, {_LOCATED},
    miss AS (SELECT * FROM p WHERE px > 1024)
    SELECT px, py, leaf FROM hit UNION ALL
    SELECT px, py, arg_min(leaf, row(((xmin + xmax) / 2 - px) ** 2 + ((ymin + ymax) / 2 - py) ** 2, leaf)) FROM miss, elem GROUP BY px, py""")
def locate_or_nearest(spark, sf_dir):
    points, leaves = _points(spark, sf_dir), test_mesh(spark, sf_dir)
    found = mesh.locate(points, leaves, BOX, LEVELS, ("px", "py"))
    lost = points.join(found.where("leaf = -1").select("px", "py"), ["px", "py"], "left_semi")
    centres = leaves.select(F.col("leaf").alias("id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"), F.lit(0.0).alias("z"))
    near = spatial.nearest(lost, centres, ("px", "py")).select("px", "py", F.col("site").alias("leaf"))
    return found.where("leaf >= 0").unionByName(near)


@query("nearest_point", """SELECT p_partkey AS id, arg_min(s_suppkey, row((x - sx) ** 2 + (y - sy) ** 2, s_suppkey)) AS site FROM
    (SELECT p_partkey, (p_partkey * 7919 % 1000)::DOUBLE AS x, p_retailprice AS y FROM part) AS a,
    (SELECT s_suppkey, (s_suppkey * 104729 % 1000)::DOUBLE AS sx, s_acctbal / 7e0 + 900e0 AS sy FROM supplier) AS b GROUP BY p_partkey""")
def nearest_point(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 104729 % 1000).cast("double").alias("x"), (F.col("s_acctbal") / 7.0 + 900.0).alias("y"), F.col("s_acctbal").alias("z"))
    return spatial.nearest(points, sites, ("id",)).select("id", "site")


_EDGES = """e AS (SELECT leaf, unnest([0, 1, 2, 3]) AS edge, unnest([xmin, xmax, ymin, ymax]) AS at, unnest([ymin, ymin, xmin, xmin]) AS lo, unnest([ymax, ymax, xmax, xmax]) AS hi FROM elem),
    met AS (SELECT a.leaf, a.edge, b.leaf AS neighbour, b.edge AS neighbour_edge, a.lo, a.hi, b.lo AS nlo, b.hi AS nhi FROM e AS a JOIN e AS b
        ON a.at = b.at AND b.edge = a.edge + CASE WHEN a.edge % 2 = 0 THEN 1 ELSE -1 END AND a.lo < b.hi AND b.lo < a.hi)"""


@query("edge_adjacency", f"""WITH {_MESH}, {_EDGES}, k AS (SELECT *, count(*) OVER (PARTITION BY leaf, edge) AS n, row_number() OVER (PARTITION BY leaf, edge ORDER BY nlo) - 1 AS o FROM met)
    SELECT leaf, edge, CASE WHEN n > 1 THEN 'coarse_to_fine' WHEN nhi - nlo > (hi - lo) * 1.5e0 THEN 'fine_to_coarse' ELSE 'conforming' END AS kind, neighbour, neighbour_edge,
        CASE WHEN n > 1 THEN o WHEN nhi - nlo > (hi - lo) * 1.5e0 THEN CASE WHEN lo + hi < nlo + nhi THEN 0 ELSE 1 END END::INT AS sub FROM k
    UNION ALL SELECT leaf, edge, 'boundary', NULL, NULL, NULL FROM e ANTI JOIN met USING (leaf, edge)""")
def edge_adjacency(spark, sf_dir):
    return mesh.adjacency(test_mesh(spark, sf_dir), DEEP)


@query("boundary_edges", f"WITH {_MESH}, {_EDGES} SELECT leaf, edge FROM e ANTI JOIN met USING (leaf, edge)")
def boundary_edges(spark, sf_dir):
    return mesh.adjacency(test_mesh(spark, sf_dir), DEEP).where("kind = 'boundary'").select("leaf", "edge")


@query("refine_children", f"""WITH {_MESH}, m AS (SELECT * FROM elem WHERE leaf % 5 = 0)
    SELECT lx, ix, iy FROM elem WHERE leaf % 5 <> 0 UNION ALL SELECT lx + 1, ix * 2 + a, iy * 2 + b FROM m, range(2) AS p(a), range(2) AS q(b)""")
def refine_children(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir)
    return mesh.refine(leaves, leaves.where("leaf % 5 = 0")).select("lx", "ix", "iy")


@query("refine_directional", f"""WITH {_MESH}, m AS (SELECT * FROM elem WHERE leaf % 5 = 0)
    SELECT lx, lx AS ly, ix, iy FROM elem WHERE leaf % 5 <> 0 UNION ALL SELECT lx + 1, lx, ix * 2 + a, iy FROM m, range(2) AS p(a)""")
def refine_directional(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir)
    return mesh.refine(leaves, leaves.where("leaf % 5 = 0"), mask=1)


@query("coarsen_siblings", f"""WITH {_MESH}, up AS (SELECT lx, ix // 2 AS px, iy // 2 AS py, count(*) AS n FROM elem WHERE leaf % 7 <> 0 GROUP BY ALL HAVING n = 4)
    SELECT elem.lx, ix, iy FROM elem LEFT JOIN up ON elem.lx = up.lx AND ix // 2 = px AND iy // 2 = py WHERE px IS NULL UNION ALL SELECT lx - 1, px, py FROM up""")
def coarsen_siblings(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir)
    return mesh.coarsen(leaves, leaves.where("leaf % 7 <> 0")).select("lx", "ix", "iy")


_HISTORY = "SELECT DISTINCT o_custkey % 6 AS lx, o_orderkey % (2 ** (o_custkey % 6))::BIGINT AS ix, o_custkey // 7 % (2 ** (o_custkey % 6))::BIGINT AS iy FROM orders WHERE o_custkey % 3 = 0"


@query("ancestors_asof", f"""WITH {_MESH}, h AS ({_HISTORY}), a AS (SELECT e.lx, e.ix, e.iy, h.lx AS from_level, h.lx * 100 + h.ix + h.iy AS coef FROM elem AS e JOIN h ON h.lx < e.lx AND e.ix >> (e.lx - h.lx) = h.ix AND e.iy >> (e.lx - h.lx) = h.iy)
    SELECT e.lx, e.ix, e.iy, coalesce(arg_max(coef, from_level), 0)::DOUBLE AS coef, max(from_level)::INT AS from_level FROM elem AS e LEFT JOIN a USING (lx, ix, iy) GROUP BY e.lx, e.ix, e.iy""")
def ancestors_asof(spark, sf_dir):
    side = F.pow(F.lit(2), F.col("lx")).cast("long")
    h = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").withColumn("lx", (F.col("o_custkey") % 6).cast("int"))
    h = h.select("lx", F.col("lx").alias("ly"), (F.col("o_orderkey") % side).alias("ix"), (F.floor(F.col("o_custkey") / 7) % side).cast("long").alias("iy")).distinct()
    h = h.withColumn("coef", (F.col("lx") * 100 + F.col("ix") + F.col("iy")).cast("double"))
    return mesh.nearest_ancestor(test_mesh(spark, sf_dir), h).select("lx", "ix", "iy", "coef", F.col("from_level").cast("int").alias("from_level"))


@query("tree_nodes", f"""WITH {_MESH}, up AS (SELECT DISTINCT lx - k AS lx, ix >> k AS ix, iy >> k AS iy FROM elem, range(1, 9) AS r(k) WHERE k <= lx)
    SELECT lx, ix, iy, FALSE AS is_leaf FROM up UNION ALL SELECT lx, ix, iy, TRUE FROM elem""")
def tree_nodes(spark, sf_dir):
    return mesh.tree_nodes(test_mesh(spark, sf_dir)).select("lx", "ix", "iy", "is_leaf")


_PARTS = f"""own AS (SELECT *, ntile(7) OVER (ORDER BY {_PATH}, lx) - 1 AS part FROM elem)"""


@query("morton_partition", f"WITH {_MESH}, {_PARTS} SELECT leaf, part::INT AS part FROM own")
def morton_partition(spark, sf_dir):
    return mesh.morton_parts(test_mesh(spark, sf_dir), 7, DEEP).select("leaf", F.col("part").cast("int").alias("part"))


@query("ghosts", f"""WITH {_MESH}, {_EDGES}, {_PARTS} SELECT DISTINCT a.part::INT AS part, b.leaf, b.part::INT AS owner FROM met JOIN own AS a ON met.leaf = a.leaf JOIN own AS b ON met.neighbour = b.leaf WHERE a.part <> b.part""")
def ghosts(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir)
    return mesh.ghosts(mesh.adjacency(leaves, DEEP), mesh.morton_parts(leaves, 7, DEEP).select("leaf", F.col("part").cast("int").alias("part")))


@query("partition_imbalance", """WITH n AS (SELECT o_custkey % 9 AS part, count(*) AS n FROM orders WHERE o_custkey % 9 <> 4 OR o_orderkey % 3 = 0 GROUP BY 1)
    SELECT max(n) AS largest, round(max(n) / avg(n), 9) + 0e0 AS ratio, CASE WHEN max(n) / avg(n) > 1.2e0 THEN 1 ELSE 0 END AS rebalance FROM n""")
def partition_imbalance(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("part"), F.col("o_orderkey").alias("leaf")).where("part <> 4 OR leaf % 3 = 0")
    return mesh.imbalance(rows).withColumn("ratio", F.round("ratio", 9))


@query("migration_plan", f"""WITH {_MESH}, {_PARTS} SELECT leaf, part::INT AS source, (leaf % 7)::INT AS target FROM own WHERE part <> leaf % 7""")
def migration_plan(spark, sf_dir):
    leaves = test_mesh(spark, sf_dir)
    return mesh.migration(mesh.morton_parts(leaves, 7, DEEP).withColumn("part", F.col("part").cast("int")), leaves.withColumn("part", (F.col("leaf") % 7).cast("int")))


_START = "SELECT leaf, floor(7e0 * sqrt(leaf * 1e0 / (SELECT count(*) FROM elem)))::INT AS part FROM elem"


def _diffuse_sql(rounds: int) -> str:
    out = [f"WITH {_MESH}, {_EDGES}, touch AS (SELECT DISTINCT leaf, neighbour FROM met), own0 AS ({_START})"]
    for r in range(rounds):
        out.append(f"""n{r} AS (SELECT part, count(*) AS n FROM own{r} GROUP BY part), a{r} AS (SELECT sum(n) // count(*) AS mean FROM n{r}),
        flow{r} AS (SELECT p.leaf, p.part, min(q.part) AS other FROM touch JOIN own{r} AS p ON touch.leaf = p.leaf JOIN own{r} AS q ON touch.neighbour = q.leaf JOIN n{r} AS x ON x.part = p.part JOIN n{r} AS y ON y.part = q.part, a{r}
            WHERE p.part <> q.part AND x.n > mean + 1 AND y.n < mean - 1 AND least(x.n - mean, mean - y.n) // 2 > 0 GROUP BY p.leaf, p.part),
        go{r} AS (SELECT f.leaf, f.other, row_number() OVER (PARTITION BY f.part, f.other ORDER BY f.leaf) AS r, least(x.n - mean, mean - y.n) // 2 AS most FROM flow{r} AS f JOIN n{r} AS x ON x.part = f.part JOIN n{r} AS y ON y.part = f.other, a{r}),
        own{r + 1} AS (SELECT leaf, CASE WHEN r <= most THEN other ELSE part END AS part FROM own{r} LEFT JOIN go{r} USING (leaf))""")
    return ",\n        ".join(out) + f" SELECT leaf, part FROM own{rounds}"


@query("diffusive_balance", _diffuse_sql(3))
def diffusive_balance(spark, sf_dir):
    """Owners of leaves after three rounds of giving to touching parts, from parts of very uneven size."""
    leaves = test_mesh(spark, sf_dir)
    total = leaves.agg(F.count("leaf").alias("total"))
    owners = leaves.crossJoin(F.broadcast(total)).select("leaf", F.floor(7.0 * F.sqrt(F.col("leaf") * 1.0 / F.col("total"))).cast("int").alias("part"))  # one row
    return mesh.diffuse(materialise(owners, "owners"), materialise(mesh.adjacency(leaves, DEEP), "near"), 0.0, 3)


@query("balance_2to1", f"WITH {tree_sql(_POINT_SQL, BASE, DEEP, MOST)} SELECT lx, ix, iy FROM cells")
def balance_2to1(spark, sf_dir):
    """The mesh of the points without grading, balanced by splitting the coarse side of each violation."""
    cells = materialise(mesh.from_points(_points(spark, sf_dir), BOX, BASE, DEEP, MOST, graded=False), "cells")
    return mesh.balance(cells, DEEP).select("lx", "ix", "iy")


_REGIONS = [("bay", [(100.0, 100.0), (500.0, 120.0), (460.0, 610.0), (90.0, 400.0)]), ("bank", [(300.0, 300.0), (900.0, 300.0), (600.0, 900.0)])]


@query("region_membership")
def region_membership(spark, sf_dir):
    """Bits of the polygons that hold each point, with the number of regions."""
    flags = spatial.region_flags(_points(spark, sf_dir), _REGIONS, ("px", "py"))
    return flags.select("px", "py", "flags", F.bit_count("flags").alias("regions"), (F.col("flags").bitwiseAND(F.lit(2).cast("long")) != 0).alias("in_bank"))


def _region_sql() -> str:
    tests = []
    for bit, (_, ring) in enumerate(_REGIONS):
        closed = [*ring, ring[0]]
        cross = " + ".join(f"CASE WHEN (({p[1]}e0 > py) <> ({q[1]}e0 > py)) AND px < {p[0]}e0 + (py - {p[1]}e0) / ({q[1] - p[1]}e0) * ({q[0] - p[0]}e0) THEN 1 ELSE 0 END" for p, q in zip(closed[:-1], closed[1:], strict=True) if p[1] != q[1])
        on = " OR ".join(f"(({q[0] - p[0]}e0) * (py - {p[1]}e0) = ({q[1] - p[1]}e0) * (px - {p[0]}e0) AND px BETWEEN {min(p[0], q[0])}e0 AND {max(p[0], q[0])}e0 AND py BETWEEN {min(p[1], q[1])}e0 AND {max(p[1], q[1])}e0)" for p, q in zip(closed[:-1], closed[1:], strict=True))
        tests.append(f"CASE WHEN ({cross}) % 2 = 1 AND NOT ({on}) THEN {1 << bit} ELSE 0 END")
    return f"SELECT px, py, flags, bit_count(flags)::INT AS regions, flags & 2 <> 0 AS in_bank FROM (SELECT px, py, ({' + '.join(tests)})::BIGINT AS flags FROM ({_POINT_SQL}) AS p) AS f"


ORACLE_SQL["region_membership"] = _region_sql()


@query("polygon_area", """SELECT c_custkey AS id, round(abs((x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y0 - x0 * y2)) / 2e0, 6) + 0e0 AS area FROM
    (SELECT c_custkey, c_acctbal / 3e0 AS x0, 1e0 * c_nationkey AS y0, 100e0 AS x1, c_acctbal / 7e0 AS y1, 1e0 * (c_custkey % 50) AS x2, 90e0 AS y2 FROM customer) AS t""")
def polygon_area(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a = point(F.col("c_acctbal") / 3, F.col("c_nationkey"))
    ring = F.array(a, point(F.lit(100), F.col("c_acctbal") / 7), point(F.col("c_custkey") % 50, F.lit(90)), a)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.round(spatial.ring_area(ring), 6) + 0.0).alias("area"))


@query("segment_boxes", f"""WITH {_MESH}, s AS (SELECT (s_suppkey * 131 % 1000)::DOUBLE AS x0, (s_suppkey * 57 % 1000)::DOUBLE AS y0, (s_suppkey * 131 % 1000)::DOUBLE + 60e0 AS x1, (s_suppkey * 57 % 1000)::DOUBLE - 45e0 AS y1 FROM supplier WHERE s_suppkey <= 40),
    t AS (SELECT leaf, greatest(0e0, (xmin - x0) / 60e0, (y0 - ymax) / 45e0) AS lo, least(1e0, (xmax - x0) / 60e0, (y0 - ymin) / 45e0) AS hi FROM s, elem) SELECT DISTINCT leaf FROM t WHERE lo <= hi""")
def segment_boxes(spark, sf_dir):
    x, y = (F.col("s_suppkey") * 131 % 1000).cast("double"), (F.col("s_suppkey") * 57 % 1000).cast("double")
    lines = table(spark, sf_dir, "supplier").where("s_suppkey <= 40").select(x.alias("x0"), y.alias("y0"), (x + 60.0).alias("x1"), (y - 45.0).alias("y1"))
    return spatial.boxes_on_segments(test_mesh(spark, sf_dir), lines, ("leaf",), 64.0)


_PIXELS = "SELECT o_custkey % 64 AS px, o_orderkey % 64 AS py, (max(o_totalprice) / 977e0)::FLOAT AS val FROM orders GROUP BY 1, 2"
_ASKS = "SELECT c_custkey AS id, (c_acctbal + 1000e0) / 190e0 AS px, c_custkey * 0.37e0 % 63e0 AS py FROM customer"


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 64).alias("px"), (F.col("o_orderkey") % 64).alias("py")).agg((F.max("o_totalprice") / 977.0).cast("float").alias("val"))


def _asks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000.0) / 190.0).alias("px"), (F.col("c_custkey") * 0.37 % 63.0).alias("py"))


_BILINEAR = f"""pixel AS ({_PIXELS}), ask AS ({_ASKS}), c AS (SELECT id, px, py, floor(px)::BIGINT + a AS cx, floor(py)::BIGINT + b AS cy,
        (CASE WHEN a = 1 THEN px - floor(px) ELSE 1e0 - (px - floor(px)) END) * (CASE WHEN b = 1 THEN py - floor(py) ELSE 1e0 - (py - floor(py)) END) AS w FROM ask, range(2) AS p(a), range(2) AS q(b)),
    v AS (SELECT id, sum(w * val) AS v, count(*) AS n FROM c JOIN pixel ON cx = pixel.px AND cy = pixel.py GROUP BY id HAVING n = 4)"""


@query("bilinear", f"WITH {_BILINEAR} SELECT id, round(coalesce(v, -9999e0), 4) + 0e0 AS value FROM ask LEFT JOIN v USING (id)")
def bilinear(spark, sf_dir):
    out = spatial.bilinear(_asks(spark, sf_dir), _pixels(spark, sf_dir), ("id",), -9999.0)
    return out.select("id", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


ORACLE_SQL["bilinear"] = ORACLE_SQL["bilinear"].replace("coalesce(v, -9999e0)", "coalesce(v, -9999e0)::FLOAT::DOUBLE")


@query("central_gradient", f"""WITH pixel AS ({_PIXELS}), ask AS (SELECT id, floor(px)::BIGINT AS px, floor(py)::BIGINT AS py FROM ({_ASKS}) AS a)
    SELECT id, round((e.val::DOUBLE - w.val) / 2e0, 6) + 0e0 AS dx, round((n.val::DOUBLE - s.val) / 2e0, 6) + 0e0 AS dy, round(e.val::DOUBLE - 2e0 * c.val + w.val, 6) + 0e0 AS dxx, round(n.val::DOUBLE - 2e0 * c.val + s.val, 6) + 0e0 AS dyy
    FROM ask JOIN pixel AS c ON c.px = ask.px AND c.py = ask.py JOIN pixel AS e ON e.px = ask.px + 1 AND e.py = ask.py JOIN pixel AS w ON w.px = ask.px - 1 AND w.py = ask.py
    JOIN pixel AS n ON n.px = ask.px AND n.py = ask.py + 1 JOIN pixel AS s ON s.px = ask.px AND s.py = ask.py - 1""")
def central_gradient(spark, sf_dir):
    """Slope and curvature at pixels by central differences: each pixel gathers its four neighbours once, and one join brings them to those who ask."""
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("c", 0, 0), ("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1))]))
    near = _pixels(spark, sf_dir).select("px", "py", F.col("val").cast("double").alias("val"), at.alias("o")).select((F.col("px") - F.col("o.a")).alias("px"), (F.col("py") - F.col("o.b")).alias("py"), "o.n", "val")
    five = near.groupBy("px", "py").agg(F.count(F.lit(1)).alias("found"), *[F.max(F.when(F.col("n") == n, F.col("val"))).alias(n) for n in "cewns"]).where("found = 5").drop("found")  # 64 x 64 at most
    asks = _asks(spark, sf_dir).select("id", F.floor("px").alias("px"), F.floor("py").alias("py"))
    r = lambda e: F.round(e, 6) + 0.0
    return asks.join(F.broadcast(five), ["px", "py"]).select("id", r((F.col("e") - F.col("w")) / 2).alias("dx"), r((F.col("n") - F.col("s")) / 2).alias("dy"), r(F.col("e") - 2.0 * F.col("c") + F.col("w")).alias("dxx"), r(F.col("n") - 2.0 * F.col("c") + F.col("s")).alias("dyy"))


@query("box_filter", f"""WITH pixel AS ({_PIXELS}), ask AS (SELECT id, floor(px)::BIGINT AS px, floor(py)::BIGINT AS py FROM ({_ASKS}) AS a)
    SELECT id, round(avg(val::DOUBLE), 6) + 0e0 AS mean, count(*) AS n FROM ask JOIN pixel ON pixel.px BETWEEN ask.px - 2 AND ask.px + 2 AND pixel.py BETWEEN ask.py - 2 AND ask.py + 2 GROUP BY id""")
def box_filter(spark, sf_dir):
    asks = _asks(spark, sf_dir).select("id", F.floor("px").alias("px"), F.floor("py").alias("py"))
    pixels = _pixels(spark, sf_dir).withColumn("val", F.col("val").cast("double"))
    return spatial.box_filter(asks, pixels, ("id",), 2).select("id", (F.round("mean", 6) + 0.0).alias("mean"), "n")


@query("tile_priority", """WITH tile AS (SELECT n_nationkey::BIGINT AS tile, (n_nationkey * 7 % 25)::INT AS priority, n_nationkey * 131 % 900 AS x, n_nationkey * 57 % 900 AS y FROM nation), p AS (SELECT DISTINCT l_partkey % 1031 AS px, (l_suppkey * 37 + l_orderkey) % 1024 AS py FROM lineitem)
    SELECT px, py, arg_min(tile, priority) AS tile FROM p LEFT JOIN tile ON px BETWEEN x AND x + 250 AND py BETWEEN y AND y + 180 GROUP BY px, py""")
def tile_priority(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    x, y = (k * 131 % 900).cast("double"), (k * 57 % 900).cast("double")
    tiles = table(spark, sf_dir, "nation").select(k.alias("tile"), (k * 7 % 25).cast("int").alias("priority"), x.alias("xmin"), (x + 250).alias("xmax"), y.alias("ymin"), (y + 180).alias("ymax"))
    return spatial.first_tile(_points(spark, sf_dir), tiles, ("px", "py"), 128.0)


@query("raster_bounds", f"WITH pixel AS ({_PIXELS}) SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, count(*) AS n, min(val) >= 0 AND max(val) > 0 AS depth_positive FROM pixel")
def raster_bounds(spark, sf_dir):
    return _pixels(spark, sf_dir).agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.count("val").alias("n"), ((F.min("val") >= 0) & (F.max("val") > 0)).alias("depth_positive"))
