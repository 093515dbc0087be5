"""Queries that solve one large system over the leaves of the points' mesh: its solution is known, so SQL states it.

The matrix couples each leaf with its edge neighbours and with itself; the right side is its product with known whole numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.operators import fit, large, mesh
from tidalframe.plans.fits import _r
from tidalframe.plans.meshes import _MESH, DEEP, test_mesh
from tidalframe.sources.tables import materialise

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SHIFT, TOLERANCE, BLOCK = 6.0, 1e-7, 64
_KNOWN = f"WITH {_MESH} SELECT leaf AS i, (leaf * 37 % 101)::DOUBLE AS v FROM elem"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _system(spark, sf_dir):
    """(leaves, matrix, known solution, right side)."""
    leaves = test_mesh(spark, sf_dir)
    near = mesh.adjacency(leaves, DEEP).where("neighbour IS NOT NULL").select(F.col("leaf").alias("i"), F.col("neighbour").alias("j")).distinct()
    own = near.groupBy("i").agg((F.count("j") + F.lit(SHIFT)).alias("v")).select("i", F.col("i").alias("j"), "v")
    matrix = materialise(near.withColumn("v", F.lit(-1.0)).unionByName(own), "matrix")
    known = leaves.select(F.col("leaf").alias("i"), (F.col("leaf") * 37 % 101).cast("double").alias("v"))
    return leaves, matrix, known, materialise(fit.matvec(matrix, known), "load")


def _blocks(leaves):
    return leaves.select(F.floor(F.col("leaf") / BLOCK).cast("long").alias("block"), F.col("leaf").alias("i"))


def _out(x):
    return x.select("i", _r("v", 3).alias("v"))


@query("large_cg", _KNOWN)
def large_cg(spark, sf_dir):
    """By conjugate gradients with the diagonal, from a start that is half the solution."""
    _, matrix, known, load = _system(spark, sf_dir)
    return _out(large.conjugate_gradients(matrix, load, start=known.withColumn("v", F.col("v") / 2), tolerance=TOLERANCE)[0])


@query("large_schwarz", _KNOWN)
def large_schwarz(spark, sf_dir):
    """By conjugate gradients with overlapping additive Schwarz on runs of leaves."""
    leaves, matrix, _, load = _system(spark, sf_dir)
    inverse = large.additive_schwarz(matrix, large.overlapped(matrix, _blocks(leaves)))
    x, _ = large.conjugate_gradients(matrix, load, lambda r: fit.matvec(inverse, r), tolerance=TOLERANCE)
    large.drop(inverse)
    return _out(x)


@query("large_coloured_schwarz", _KNOWN)
def large_coloured_schwarz(spark, sf_dir):
    """By sweeps over blocks of leaves, colour by colour."""
    leaves, matrix, _, load = _system(spark, sf_dir)
    return _out(large.multiplicative_schwarz(matrix, load, materialise(_blocks(leaves), "blocks"), 6))


@query("large_multigrid", _KNOWN)
def large_multigrid(spark, sf_dir):
    """By conjugate gradients with a V-cycle over the leaves' ancestors at levels 6 and 4."""
    leaves, matrix, _, load = _system(spark, sf_dir)

    def code(level):
        up = F.greatest(F.col("lx") - level, F.lit(0))
        shifted = [F.expr(f"shiftright({c}, greatest(lx - {level}, 0))") for c in ("ix", "iy")]
        return (((F.col("lx") - up) * 65536 + shifted[1]) * 65536 + shifted[0]).cast("long")

    chain = leaves.select(F.col("leaf").alias("i"), code(6).alias("c"), code(4).alias("d"))
    one = F.lit(1.0).alias("w")
    grid = large.Multigrid(matrix, [chain.select("i", "c", one), chain.select(F.col("c").alias("i"), F.col("d").alias("c"), one).distinct()])
    x, _ = large.conjugate_gradients(matrix, load, grid, tolerance=TOLERANCE)
    grid.close()
    return _out(x)


@query("large_schur", _KNOWN)
def large_schur(spark, sf_dir):
    """Under constraints between every sixty-fourth leaf and the next, through their multipliers."""
    leaves, matrix, known, load = _system(spark, sf_dir)
    at = leaves.where(f"leaf % {BLOCK} = 0").select((F.col("leaf") / BLOCK).cast("long").alias("row"), F.inline(F.array(*[F.struct((F.col("leaf") + d).alias("col"), F.lit(v).alias("v")) for d, v in ((0, 1.0), (1, -1.0))])))
    rows = materialise(at.join(leaves.select(F.col("leaf").alias("col")), "col", "left_semi").select("row", "col", "v"), "rows")
    bound = fit.matvec(rows.select(F.col("row").alias("i"), F.col("col").alias("j"), "v"), known)
    pull = rows.select(F.col("col").alias("i"), (F.col("v") * (F.col("row") % 7)).alias("pull")).groupBy("i").agg(F.sum("pull").alias("pull"))
    held = load.join(pull, "i", "left").select("i", (F.col("v") + F.coalesce("pull", F.lit(0.0))).alias("v"))
    return _out(large.schur(matrix, rows, materialise(held, "held"), materialise(bound, "bound"), tolerance=1e-5)[0])


@query("block_colours", f"WITH {_MESH} SELECT count(*) AS leaves, count(DISTINCT leaf // {BLOCK}) AS blocks, 0::BIGINT AS conflicts, TRUE AS few FROM elem")
def block_colours(spark, sf_dir):
    """Blocks of leaves coloured so that none that bear on each other share a colour: how many clash, and whether colours are at most neighbours and one."""
    leaves, matrix, _, _ = _system(spark, sf_dir)
    blocks = materialise(_blocks(leaves), "blocks")
    graph = materialise(large.block_conflicts(matrix, blocks), "graph")
    colours = large.coloured(graph)
    two = graph.where("i <> j").join(colours, "i").join(colours.select(F.col("i").alias("j"), F.col("colour").alias("other")), "j")
    clash = two.agg(F.count_if(F.col("colour") == F.col("other")).alias("conflicts"))
    most = graph.where("i <> j").groupBy("i").agg(F.count("j").alias("n")).agg(F.max("n").alias("n"))
    named = blocks.join(colours.select(F.col("i").alias("block"), "colour"), "block").agg(F.count("i").alias("leaves"), F.count_distinct("block").alias("blocks"), F.max("colour").alias("top"))
    return named.crossJoin(clash).crossJoin(most).select("leaves", "blocks", "conflicts", (F.col("top") <= F.col("n")).alias("few"))  # one row each
