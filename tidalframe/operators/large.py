"""One large sparse system on tables: conjugate gradients, overlapping Schwarz, colouring, aggregation multigrid, Schur complements.

Matrices are (i, j, v), vectors (i, v). A matrix that many products use is written once, bucketed by column, so an iteration shuffles vectors
and partial sums only. Each iteration's state is a table in the shared folder: a lost executor costs one of its tasks, and plans stay
short. The driver sees a few sums an iteration and decides when to stop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators import fit
from tidalframe.sources.tables import bucketed, drop, materialise, observed

#: Most unknowns of a block, and of the coarsest level, whose inverses are dense.
BLOCK_MOST, COARSE_MOST = 512, 512
#: Entries of a bucket of a matrix: every product starts a task a bucket.
BUCKET_ENTRIES = 1 << 17


def held(matrix: DataFrame, name: str) -> DataFrame:
    """A matrix, best a table already, bucketed by column into as many buckets as it has entries for; ``drop`` it at the end."""
    most = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return bucketed(matrix.select("i", "j", "v"), name, "j", max(1, min(most, 1024, -(-matrix.count() // BUCKET_ENTRIES))))


def conjugate_gradients(matrix: DataFrame, load: DataFrame, precondition: Callable[[DataFrame], DataFrame] | None = None, start: DataFrame | None = None, tolerance: float = 1e-12, most: int = 1000) -> tuple[DataFrame, list[float]]:
    """(i, v) and residual norms by flexible conjugate gradients, from ``start`` (i, v) or zero.

    ``precondition`` maps residuals (i, v) to corrections (i, v) and may change from step to step; none: the diagonal.
    """
    kept = held(matrix, "matrix")
    try:
        return _conjugate_gradients(kept, load, precondition, start, tolerance, most)
    finally:
        drop(kept)


def _conjugate_gradients(held: DataFrame, load: DataFrame, precondition, start, tolerance: float, most: int) -> tuple[DataFrame, list[float]]:
    diagonal = held.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    base = load.groupBy("i").agg(F.sum("v").alias("b")).join(diagonal, "i")
    if start is None:
        base = base.select("i", "b", F.lit(0.0).alias("x"), F.col("b").alias("r"), "d")
    else:
        begun = materialise(base.join(start.select("i", F.col("v").alias("x")), "i", "left").select("i", "b", "d", F.coalesce("x", F.lit(0.0)).alias("x")), "start")
        product = fit.matvec(held, begun.select("i", F.col("x").alias("v"))).select("i", F.col("v").alias("ax"))
        base = begun.join(product, "i", "left").select("i", "b", "x", (F.col("b") - F.coalesce("ax", F.lit(0.0))).alias("r"), "d")
    state, sums = observed(base, "cg", bb=F.col("b") * F.col("b"), rr=F.col("r") * F.col("r"))
    state, least = state.select("i", "x", "r", F.lit(0.0).alias("p"), "d"), tolerance * max(sums["bb"] ** 0.5, 1e-300)
    solve = _diagonal_steps if precondition is None else _preconditioned_steps
    return solve(held, state, precondition, [sums["rr"] ** 0.5], least, most)


def _norm2(rows: DataFrame) -> float:
    return rows.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0


def _diagonal_steps(held: DataFrame, state: DataFrame, _, history: list[float], least: float, most: int) -> tuple[DataFrame, list[float]]:
    """With the diagonal, one table an iteration: the sums over its rows also give what the residual is after the step."""
    beta, z = 0.0, F.col("r") / F.col("d")
    while history[-1] > least and len(history) <= most:
        state = state.withColumn("p", z + beta * F.col("p"))
        product = fit.matvec(held, state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("q"))
        r, q, d = F.col("r"), F.col("q"), F.col("d")
        seen, s = observed(state.join(product, "i"), "cg", pq=F.col("p") * q, rr=r * r, rq=r * q, qq=q * q, rz=r * r / d, rqz=r * q / d, qqz=q * q / d)
        if s["pq"] <= 0:
            return seen.select("i", F.col("x").alias("v")), history
        history[-1] = s["rr"] ** 0.5
        step = s["rz"] / s["pq"]
        state = seen.select("i", (F.col("x") + step * F.col("p")).alias("x"), (r - step * q).alias("r"), "p", "d")
        beta = max(0.0, -step * (s["rqz"] - step * s["qqz"]) / s["rz"])  # what remains of z.(r - old r) over the old z.r
        history.append(max(0.0, s["rr"] - 2 * step * s["rq"] + step * step * s["qq"]) ** 0.5)
        if history[-1] <= least or history[-1] < 1e-6 * history[-2]:
            history[-1] = _norm2(state) ** 0.5  # differences of sums are too coarse to stop by
    return state.select("i", F.col("x").alias("v")), history


def _preconditioned_steps(held: DataFrame, state: DataFrame, precondition: Callable[[DataFrame], DataFrame], history: list[float], least: float, most: int) -> tuple[DataFrame, list[float]]:
    """With any preconditioner, a table of the residual, one of its correction and one of the product an iteration."""

    def corrected(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        """``rows`` with z, the preconditioned r, as a table, with sums."""
        z = precondition(rows.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("z"))
        rows = rows.join(z, "i", "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
        return observed(rows, "cg", rz=F.col("r") * F.col("z"), qz=F.col("q") * F.col("z"))

    if history[-1] <= least:
        return state.select("i", F.col("x").alias("v")), history
    state, s = corrected(state.withColumn("q", F.lit(0.0)))
    rz, beta = s["rz"], 0.0
    while history[-1] > least and len(history) <= most:
        state = state.withColumn("p", F.col("z") + beta * F.col("p")).select("i", "x", "r", "p", "d")
        product = fit.matvec(held, state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("q"))
        seen, s = observed(state.join(product, "i"), "cg", pq=F.col("p") * F.col("q"))
        if s["pq"] <= 0:
            return seen.select("i", F.col("x").alias("v")), history
        step = rz / s["pq"]
        state, s = observed(seen.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p", "q", "d"), "cg", rr=F.col("r") * F.col("r"))
        history.append(s["rr"] ** 0.5)
        if history[-1] > least:
            state, s = corrected(state)
            beta, rz = max(0.0, -step * s["qz"] / rz), s["rz"]  # what remains of z.(r - old r) over the old z.r
    return state.select("i", F.col("x").alias("v")), history


def overlapped(matrix: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, i) with each block widened by the unknowns that its own are coupled with."""
    reach = blocks.join(matrix.where("v <> 0").select("i", "j"), "i").select("block", F.col("j").alias("i"))
    return blocks.select("block", "i").unionByName(reach).distinct()


def block_inverses(matrix: DataFrame, blocks: DataFrame, most: int = BLOCK_MOST) -> DataFrame:
    """(block, i, j, v): the inverse of the matrix on each block (block, i); blocks of over ``most`` unknowns are refused."""
    inside = blocks.join(matrix.select("i", "j", "v"), "i").join(blocks.select("block", F.col("i").alias("j")), ["block", "j"])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j, v = (rows.column(c).to_numpy() for c in "ijv")
        ids, at = np.unique(i, return_inverse=True)
        if len(ids) > most:
            raise ValueError(f"a block of {len(ids)} unknowns; at most {most} are inverted")
        dense = np.zeros((len(ids), len(ids)))
        np.add.at(dense, (at, np.searchsorted(ids, j)), v)
        inverse = np.linalg.inv(dense)
        return pa.table({"block": np.full(inverse.size, key[0].as_py()), "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "v": inverse.ravel()})

    return inside.select("block", "i", "j", "v").groupBy("block").applyInArrow(run, "block long, i long, j long, v double")


def additive_schwarz(matrix: DataFrame, blocks: DataFrame) -> DataFrame:
    """The preconditioner as a matrix (i, j, v): inverses of all blocks, overlapping corrections summed; bucketed, so ``drop`` it at the end."""
    sums = block_inverses(matrix, blocks).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return held(materialise(sums, "sums"), "schwarz")


def coloured(graph: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(i, colour) so that no edge (i, j) joins nodes of one colour.

    Every round takes the nodes whose hashed priority is the least among their uncoloured neighbours, an independent set, and gives each
    the least colour that none of its neighbours has. Rounds grow with the longest falling path of priorities, not with the nodes.
    """
    both = graph.where("i <> j").select("i", "j").unionByName(graph.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    edges = materialise(both, "conflicts")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = materialise(graph.select("i").unionByName(graph.select(F.col("j").alias("i"))).distinct(), "uncoloured")
    done = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        rivals = edges.join(left, "i").join(left.select(F.col("i").alias("j")), "j").groupBy("i").agg(F.min(rank("j")).alias("rival"))
        now = left.join(rivals, "i", "left").where(F.col("rival").isNull() | (rank("i") < F.col("rival"))).select("i")
        if done is None:
            fresh = now.select("i", F.lit(0).alias("colour"))
        else:
            near = now.join(edges, "i").join(done.select(F.col("i").alias("j"), "colour"), "j").groupBy("i").agg(F.array_sort(F.collect_set("colour")).alias("taken"))  # as many as a node has neighbours
            free = F.filter(F.sequence(F.lit(0), F.size("taken")), lambda c: ~F.array_contains("taken", c))[0]
            fresh = now.join(near, "i", "left").select("i", F.when(F.col("taken").isNull(), F.lit(0)).otherwise(free).alias("colour"))
        fresh = materialise(fresh, "coloured")
        done = fresh if done is None else materialise(done.unionByName(fresh), "coloured")
        left = materialise(left.join(fresh, "i", "left_anti"), "uncoloured")
    else:
        raise RuntimeError(f"nodes without a colour after {most_rounds} rounds")
    return done if done is not None else left.select("i", F.lit(0).alias("colour"))


def block_conflicts(matrix: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, j): blocks that share or couple unknowns, each block with itself too."""
    reach = blocks.join(matrix.where("v <> 0").select("i", "j"), "i").select("block", F.col("j").alias("k")).distinct()
    other = blocks.select(F.col("block").alias("other"), F.col("i").alias("k"))
    return reach.join(other, "k").select(F.col("block").alias("i"), F.col("other").alias("j")).distinct()


def multiplicative_schwarz(matrix: DataFrame, load: DataFrame, blocks: DataFrame, sweeps: int) -> DataFrame:
    """(i, v) after sweeps over the blocks, colour by colour; blocks of one colour are corrected at once, as none bears on another."""
    colours = materialise(coloured(block_conflicts(matrix, blocks)), "colours")
    named = blocks.join(colours.select(F.col("i").alias("block"), "colour"), "block")
    rows = materialise(matrix.select("i", "j", "v").join(named.select("i", "colour"), "i"), "matrix", "colour")  # a step reads what is of its colour
    inverses = materialise(block_inverses(matrix, blocks).join(colours.select(F.col("i").alias("block"), "colour"), "block").select("i", "j", "v", "colour"), "inverses", "colour")
    names = [r.colour for r in colours.select("colour").distinct().orderBy("colour").collect()]  # as many as a block has neighbours
    base = load.select("i", F.col("v").alias("b"))
    x = base.select("i", F.lit(0.0).alias("v"))
    for _ in range(sweeps):
        for c in names:
            own = F.col("colour") == c
            residual = base.join(fit.matvec(rows.where(own), x).select("i", F.col("v").alias("ax")), "i").select("i", (F.col("b") - F.col("ax")).alias("v"))
            step = fit.matvec(inverses.where(own).select("i", "j", "v"), residual).select("i", F.col("v").alias("step"))
            x = materialise(x.join(step, "i", "left").select("i", (F.col("v") + F.coalesce("step", F.lit(0.0))).alias("v")), "sweep")
    return x


def galerkin(matrix: DataFrame, prolong: DataFrame) -> DataFrame:
    """P'AP (i, j, v) for a prolongation (i, c, w), as two joins with sums."""
    right = matrix.join(prolong.select(F.col("i").alias("j"), F.col("c").alias("jc"), F.col("w").alias("wj")), "j").groupBy("i", "jc").agg(F.sum(F.col("v") * F.col("wj")).alias("v"))
    return right.join(prolong.select("i", F.col("c").alias("ic"), F.col("w").alias("wi")), "i").groupBy("ic", "jc").agg(F.sum(F.col("v") * F.col("wi")).alias("v")).select(F.col("ic").alias("i"), F.col("jc").alias("j"), "v")


class Multigrid:
    """A V-cycle over levels that prolongations (i, c, w) define, from the finest; the coarsest is inverted, up to ``COARSE_MOST`` unknowns."""

    def __init__(self, matrix: DataFrame, prolongations: Sequence[DataFrame], omega: float = 0.7):
        self.omega, self.levels = omega, []
        for p in prolongations:
            kept = held(matrix, "level")
            diagonal = materialise(kept.where("i = j").select("i", F.col("v").alias("d")), "diagonal")
            p = materialise(p.select("i", "c", "w"), "prolong")
            self.levels.append((kept, diagonal, p))
            matrix = materialise(galerkin(kept, p), "coarse")
        every = matrix.select(F.lit(0).cast("long").alias("block"), "i").distinct()
        self.coarse = materialise(block_inverses(matrix, every, COARSE_MOST).select("i", "j", "v"), "coarsest")

    def close(self) -> None:
        for held, _, _ in self.levels:
            drop(held)

    def __call__(self, residual: DataFrame, level: int = 0) -> DataFrame:
        """The correction (i, v) of a residual (i, v): one damped Jacobi sweep before and after the coarser level's."""
        if level == len(self.levels):
            return fit.matvec(self.coarse, residual)
        held, diagonal, p = self.levels[level]
        first = materialise(residual.join(diagonal, "i").select("i", F.col("v").alias("r"), "d", (self.omega * F.col("v") / F.col("d")).alias("z")), "smooth")
        left = self._left(held, first)
        down = left.join(p, "i").groupBy("c").agg(F.sum(F.col("left") * F.col("w")).alias("v")).select(F.col("c").alias("i"), "v")
        up = self(materialise(down, "restricted"), level + 1).select(F.col("i").alias("c"), F.col("v").alias("zc"))
        raised = p.join(up, "c").groupBy("i").agg(F.sum(F.col("w") * F.col("zc")).alias("more"))
        second = materialise(first.join(raised, "i", "left").select("i", "r", "d", (F.col("z") + F.coalesce("more", F.lit(0.0))).alias("z")), "corrected")
        return self._left(held, second).select("i", (F.col("z") + self.omega * F.col("left") / F.col("d")).alias("v"))

    @staticmethod
    def _left(held: DataFrame, state: DataFrame) -> DataFrame:
        """``state`` with ``left``, what z leaves of r."""
        product = fit.matvec(held, state.select("i", F.col("z").alias("v"))).select("i", F.col("v").alias("az"))
        return state.join(product, "i", "left").select("i", "z", "d", (F.col("r") - F.coalesce("az", F.lit(0.0))).alias("left"))


def schur(matrix: DataFrame, constraints: DataFrame, load: DataFrame, bound: DataFrame, tolerance: float = 1e-10, most: int = 200) -> tuple[DataFrame, DataFrame, list[float]]:
    """x (i, v), multipliers (i, v) and outer residuals of min x'Qx/2 - b'x with Ax = c; ``constraints`` is (row, col, v), ``bound`` (i, v) by row.

    The multiplier solves (A Q^-1 A') m = A Q^-1 b - c by conjugate gradients without a matrix; each product is an inner solve with Q. Every step of both
    loops is a table.
    """
    rows = materialise(constraints.select(F.col("row").alias("i"), F.col("col").alias("j"), "v"), "constraints")
    turned = rows.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    kept = held(matrix, "matrix")
    inner = lambda b: _conjugate_gradients(kept, b, None, None, tolerance / 100, 1000)[0]
    full = lambda b: load.select("i").join(b, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))  # every unknown has a right side
    free = inner(load)
    state = bound.select("i", F.col("v").alias("c")).join(fit.matvec(rows, free).select("i", F.col("v").alias("ax")), "i", "left")
    state, s = observed(state.select("i", F.lit(0.0).alias("x"), (F.coalesce("ax", F.lit(0.0)) - F.col("c")).alias("r")).withColumn("p", F.col("r")), "outer", rr=F.col("r") * F.col("r"))
    rr = s["rr"]
    history = [rr**0.5]
    while history[-1] > tolerance * max(history[0], 1e-300) and len(history) <= most:
        solved = inner(full(fit.matvec(turned, state.select("i", F.col("p").alias("v")))))
        seen, s = observed(state.join(fit.matvec(rows, solved).select("i", F.col("v").alias("q")), "i"), "outer", pq=F.col("p") * F.col("q"))
        if s["pq"] <= 0:
            break
        step = rr / s["pq"]
        moved = seen.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        new = _norm2(moved)
        state = moved.withColumn("p", F.col("r") + (new / rr) * F.col("p"))
        rr = new
        history.append(rr**0.5)
    multipliers = state.select("i", F.col("x").alias("v"))
    pull = fit.matvec(turned, multipliers).select("i", F.col("v").alias("pull"))
    x = inner(load.join(pull, "i", "left").select("i", (F.col("v") - F.coalesce("pull", F.lit(0.0))).alias("v")))
    drop(kept)
    return x, multipliers, history
