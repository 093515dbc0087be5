"""Least-squares fits on element meshes: sampling, assembly, constraints, solves, error marking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions.basis import bernstein_table, gauss
from tidalframe.sources.tables import materialise

#: Unknowns up to which a system is solved densely on the driver (eight bytes a pair: 200 MB).
MOST_DENSE = 5000


def literal_rows(columns: dict[str, Sequence]) -> Column:
    """A small constant table as an array of structs, for ``inline``."""
    rows = zip(*columns.values(), strict=True)
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, row, strict=True)]) for row in rows])


def gauss_samples(elements: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """n x n Gauss points of each element's box: (key, q, u, v, x, y, w), w summing to its area."""
    at, weight = gauss(n)
    table = {"q": list(range(n * n)), "u": [float(at[k % n]) for k in range(n * n)], "v": [float(at[k // n]) for k in range(n * n)], "g": [float(weight[k % n] * weight[k // n]) for k in range(n * n)]}
    rows = elements.select(*key, "xmin", "xmax", "ymin", "ymax", F.inline(literal_rows(table)))
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return rows.select(*key, "q", "u", "v", (F.col("xmin") + F.col("u") * dx).alias("x"), (F.col("ymin") + F.col("v") * dy).alias("y"), (F.col("g") * dx * dy).alias("w"))


def assemble(entries: DataFrame, drop: float = 1e-16) -> DataFrame:
    """Sparse matrix (i, j, v) from element contributions: duplicates add up, tiny sums go."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v")).where(F.abs("v") >= drop)


def normal_equations(samples: DataFrame, dofs: DataFrame, degree: int) -> tuple[DataFrame, DataFrame]:
    """Matrix (i, j, v) and right side (i, v) of the weighted fit of samples (elem, u, v, w, z).

    ``dofs`` is (elem, local, dof). Products of basis values are formed beside each sample and summed
    per element before they meet the dof numbers, so what is shuffled is one block per element.
    """
    n = (degree + 1) ** 2
    from tidalframe.functions import basis
    from tidalframe.functions.dual import COLUMN

    values = F.array(*[basis.tensor(COLUMN, degree, k, F.col("u"), F.col("v")) for k in range(n)])
    rows = samples.select("elem", "w", "z", values.alias("b"))
    pairs = F.posexplode(F.flatten(F.transform("b", lambda x: F.transform("b", lambda y: x * y))))
    block = rows.select("elem", "w", pairs.alias("p", "bb")).groupBy("elem", "p").agg(F.sum(F.col("w") * F.col("bb")).alias("v"))
    block = block.withColumns({"a": F.floor(F.col("p") / n).cast("int"), "c": F.col("p") % n})
    left, right = (dofs.select("elem", F.col("local").alias(a), F.col("dof").alias(i)) for a, i in (("a", "i"), ("c", "j")))
    matrix = assemble(block.join(left, ["elem", "a"]).join(right, ["elem", "c"]).select("i", "j", "v"))
    load = rows.select("elem", "w", "z", F.posexplode("b").alias("a", "x")).groupBy("elem", "a").agg(F.sum(F.col("w") * F.col("z") * F.col("x")).alias("v"))
    return matrix, load.join(left, ["elem", "a"]).groupBy("i").agg(F.sum("v").alias("v"))


def numbered(rows: DataFrame, order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """``rows`` with their number in ``order`` as ``name``, from 0 on.

    ``bucket`` rises with the order. Rows are counted per bucket, a window sums those few counts, and only the
    rows of one bucket are ordered in one task.
    """
    placed = rows.withColumn("bucket__", bucket)
    counts = placed.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n__"))
    run = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket__", F.coalesce(F.sum("n__").over(run), F.lit(0)).alias("base__"))
    inside = F.row_number().over(Window.partitionBy("bucket__").orderBy(*order))
    out = placed.withColumn("rank__", inside).join(bases, "bucket__")
    return out.withColumn(name, (F.col("base__") + F.col("rank__") - 1).cast("long")).drop("bucket__", "base__", "rank__")


#: Parts of a cell of the marking's histogram.
MARK_CELLS = 4096

#: Buckets over the range of positions, and unknowns in a bucket of numbers.
STRIPS, RUN = 4096, 1 << 16


def conforming_dofs(nodes: DataFrame, digits: int = 9) -> DataFrame:
    """(elem, local, dof): equal positions (x, y) share a number, in order of position."""
    spot = nodes.withColumns({"qx": F.round("x", digits), "qy": F.round("y", digits)})
    ends = spot.agg(F.min("qx").alias("x0__"), F.max("qx").alias("x1__"))
    strip = F.when(F.col("x1__") > F.col("x0__"), F.floor((F.col("qx") - F.col("x0__")) / (F.col("x1__") - F.col("x0__")) * STRIPS)).otherwise(0)
    unique = numbered(spot.select("qx", "qy").distinct().crossJoin(F.broadcast(ends)), ["qx", "qy"], strip, "dof")  # one row of ends
    return spot.join(unique.select("qx", "qy", "dof"), ["qx", "qy"]).select("elem", "local", "dof")


def condense(matrix: DataFrame, constraints: DataFrame) -> DataFrame:
    """The matrix with each slave replaced by its weighted masters on both axes."""
    slaves = constraints.select("slave", "master", "w")
    rows = matrix.join(slaves, matrix["i"] == slaves["slave"], "left").select(F.coalesce("master", "i").alias("i"), "j", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))
    both = rows.join(slaves, rows["j"] == slaves["slave"], "left").select("i", F.coalesce("master", "j").alias("j"), (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def condense_load(load: DataFrame, constraints: DataFrame) -> DataFrame:
    slaves = constraints.select("slave", "master", "w")
    rows = load.join(slaves, load["i"] == slaves["slave"], "left")
    return rows.groupBy(F.coalesce("master", "i").alias("i")).agg(F.sum(F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))


def expand(solution: DataFrame, constraints: DataFrame) -> DataFrame:
    """Values (i, v) of free unknowns, and of slaves from their masters."""
    back = constraints.join(solution, constraints["master"] == solution["i"]).groupBy(F.col("slave").alias("i")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return solution.unionByName(back)


def free_dofs(dofs: DataFrame, constraints: DataFrame) -> DataFrame:
    """(dof, free): unconstrained unknowns, renumbered in order."""
    kept = dofs.select("dof").distinct().join(constraints.select(F.col("slave").alias("dof")), "dof", "left_anti")
    return numbered(kept, ["dof"], F.floor(F.col("dof") / RUN), "free")


def stack(*blocks: tuple[DataFrame, int]) -> DataFrame:
    """Constraint rows (row, col, v) of blocks one under another; each with its number of rows."""
    out, offset = None, 0
    for block, rows in blocks:
        part = block.select((F.col("row") + offset).alias("row"), "col", "v")
        out = part if out is None else out.unionByName(part)
        offset += rows
    return out


def matvec(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of the product with x (i, v)."""
    y = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return matrix.join(y, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def quadratic_form(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """One row: x' A x."""
    left = x.select("i", F.col("v").alias("xi"))
    right = x.select(F.col("i").alias("j"), F.col("v").alias("xj"))
    return matrix.join(left, "i").join(right, "j").agg(F.sum(F.col("v") * F.col("xi") * F.col("xj")).alias("value"))


def frobenius_ratio(data: DataFrame, smooth: DataFrame, least: float = 1e-14) -> DataFrame:
    """One row: |data| / |smooth|, 0 where the latter vanishes."""
    norm = lambda m, n: m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(n))
    return norm(data, "a").crossJoin(norm(smooth, "b")).select(F.when(F.col("b") > least, F.col("a") / F.col("b")).otherwise(0.0).alias("alpha"))


def jacobi(matrix: DataFrame, load: DataFrame, sweeps: int, omega: float = 0.8) -> DataFrame:
    """Damped Jacobi from zero: (i, v) after a fixed number of sweeps.

    The first sweep needs no product. For more than two the matrix is written once, bucketed by column, so that a sweep shuffles x and the
    products but not the matrix; each x is a table, as a sweep uses it twice.
    """
    from tidalframe.sources.tables import bucketed, drop

    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    base = load.select("i", F.col("v").alias("b")).join(diagonal, "i")
    held = bucketed(matrix.select("i", "j", "v"), "matrix", "j") if sweeps > 2 else None
    if sweeps > 1:
        base = materialise(base, "base")
    x = base.select("i", (omega * F.col("b") / F.col("d") if sweeps else F.lit(0.0)).alias("v"))
    for _ in range(sweeps - 1):
        product = matvec(held or matrix, x).select("i", F.col("v").alias("ax"))
        x = base.join(x, "i").join(product, "i", "left").select("i", (F.col("v") + omega * (F.col("b") - F.coalesce("ax", F.lit(0.0))) / F.col("d")).alias("v"))
        if held is not None:
            x = materialise(x, "sweep")
    if held is not None:
        drop(held)
    return x


def gather_system(matrix: DataFrame, load: DataFrame, most: int = MOST_DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, dense matrix and right side; refused above ``most`` unknowns."""
    count = load.count()
    if count > most:
        raise ValueError(f"{count} unknowns; at most {most} are solved on the driver")
    b = load.orderBy("i").toPandas()
    at = {i: k for k, i in enumerate(b["i"])}
    dense = np.zeros((len(at), len(at)))
    for i, j, v in matrix.select("i", "j", "v").toPandas().itertuples(index=False):
        dense[at[i], at[j]] += v
    return b["i"].to_numpy(), dense, b["v"].to_numpy()


def solve(matrix: DataFrame, load: DataFrame) -> DataFrame:
    """Direct solution (i, v) of a system of bounded size."""
    ids, dense, b = gather_system(matrix, load)
    x = np.linalg.solve(dense, b)
    return matrix.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(ids, x, strict=True)], "i long, v double")


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: Callable[[np.ndarray], np.ndarray] | None = None, tolerance: float = 1e-10, most: int = 1000, flexible: bool = False) -> tuple[np.ndarray, list[float]]:
    """Solution and residual norms; flexible: Polak-Ribiere steps, for a changing preconditioner."""
    precondition = precondition or (lambda r: r)
    x = np.zeros_like(b)
    r = b.copy()
    history = [float(np.linalg.norm(r))]
    z = precondition(r)
    p, rz = z.copy(), float(r @ z)
    while history[-1] > tolerance * max(history[0], 1e-300) and len(history) <= most:
        q = apply(p)
        curve = float(p @ q)
        if curve <= 0:
            break
        step = rz / curve
        x += step * p
        old = r
        r = r - step * q
        history.append(float(np.linalg.norm(r)))
        z = precondition(r)
        new = float(r @ z)
        beta = (new - float(old @ z) if flexible else new) / rz
        p, rz = z + beta * p, new
    return x, history


def schur_solve(q: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float = 1e-12, precondition: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, list[float]]:
    """Minimiser of x'Qx/2 - b'x under Ax = 0, by (preconditioned) conjugate gradients on A Q^-1 A'."""
    unconstrained = np.linalg.solve(q, b)
    into = np.linalg.solve(q, a.T)
    multiplier, history = conjugate_gradients(lambda y: a @ (into @ y), a @ unconstrained, precondition, tolerance)
    return unconstrained - into @ multiplier, history


def schwarz(matrix: np.ndarray, b: np.ndarray, blocks: Sequence[Sequence[int]], kind: str = "multiplicative", omega: float = 1.0, sweeps: int = 1) -> np.ndarray:
    """Overlapping block sweeps: multiplicative (block after block), additive, or coloured."""
    x = np.zeros_like(b)
    groups = [[k] for k in range(len(blocks))] if kind == "multiplicative" else [list(range(len(blocks)))] if kind == "additive" else colours(blocks)
    for _ in range(sweeps):
        for group in groups:
            r = b - matrix @ x
            for k in group:
                at = np.asarray(blocks[k])
                x[at] += omega * np.linalg.solve(matrix[np.ix_(at, at)], r[at])
    return x


def colours(blocks: Sequence[Sequence[int]]) -> list[list[int]]:
    """Greedy groups of blocks without shared unknowns."""
    groups: list[tuple[list[int], set[int]]] = []
    for k, block in enumerate(blocks):
        for members, used in groups:
            if used.isdisjoint(block):
                members.append(k)
                used.update(block)
                break
        else:
            groups.append(([k], set(block)))
    return [g for g, _ in groups]


def v_cycle(matrices: Sequence[np.ndarray], up: Sequence[np.ndarray], b: np.ndarray, level: int = 0, sweeps: int = 2, omega: float = 0.8) -> np.ndarray:
    """One multigrid cycle; ``matrices`` from fine to coarse, ``up[k]`` prolongs from level k + 1."""
    a = matrices[level]
    if level == len(matrices) - 1:
        return np.linalg.solve(a, b)
    d = np.diag(a)
    x = np.zeros_like(b)
    for _ in range(sweeps):
        x += omega * (b - a @ x) / d
    x += up[level] @ v_cycle(matrices, up, up[level].T @ (b - a @ x), level + 1, sweeps, omega)
    for _ in range(sweeps):
        x += omega * (b - a @ x) / d
    return x


def galerkin(a: np.ndarray, up: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The fine matrix and its coarse counterparts."""
    out = [a]
    for p in up:
        out.append(p.T @ out[-1] @ p)
    return out


def thin_plate_block(degree: int, dx: float, dy: float, n: int = 6) -> np.ndarray:
    """Element energy of second derivatives on a dx by dy box, in tensor Bernstein coefficients."""
    from math import comb

    at, weight = gauss(n)

    def derivative(order: int) -> np.ndarray:
        low = bernstein_table(degree - order, at)
        out = np.zeros((len(at), degree + 1))
        for k in range(order + 1):
            out[:, k : k + degree - order + 1] += (-1) ** (order - k) * comb(order, k) * low
        for s in range(order):
            out = out * (degree - s)
        return out

    mass = [derivative(k).T @ (weight[:, None] * derivative(k)) for k in range(3)]
    return np.kron(mass[0], mass[2]) * dy / dx**3 + np.kron(mass[2], mass[0]) * dx / dy**3 + 2 * np.kron(mass[1], mass[1]) / (dx * dy)


def element_error(samples: DataFrame, key: str = "elem") -> DataFrame:
    """(key, l2, normalised): root of the weighted squared misfit, and per root of the area.

    ``samples`` has the key, w, and diff.
    """
    sums = samples.groupBy(key).agg(F.sum(F.col("w") * F.col("diff") * F.col("diff")).alias("e2"), F.sum("w").alias("area"))
    return sums.select(key, F.sqrt("e2").alias("l2"), F.sqrt(F.col("e2") / F.col("area")).alias("normalised"))


def dorfler(metrics: DataFrame, key: str, metric: str, theta: float) -> DataFrame:
    """The elements that together hold the share ``theta`` of the squared metric, largest first.

    All that tie with the last one needed are taken; the largest always is. Running totals are summed in logarithmic cells of the metric,
    then in ``MARK_CELLS`` parts of the cell that matters, and in as many parts of that part: what one task orders at last are values
    that agree to nine digits, one row for each.
    """
    m2 = F.col(metric) * F.col(metric)
    rows = metrics.select(key, metric).where(F.col(metric).isNotNull())
    run = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def crossing(cells: DataFrame) -> DataFrame:
        """One row: the cell where the running total passes the goal, and what lies before it (``cells``: cell, s, before, goal)."""
        upto = F.col("before") + F.sum("s").over(run)
        passed = cells.withColumn("upto", upto).where("upto - s < goal")
        return passed.agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("s")).alias("before"), "goal"), "cell").alias("x")).select("x.*")

    low = F.pow(F.lit(2.0), F.col("c0") / 64.0)
    part = (F.col(metric) - low) / (low * (2.0 ** (1 / 64) - 1))  # place within the first cell, from 0 to 1
    placed = rows.withColumn("c0", F.floor(F.log2(F.greatest(F.col(metric), F.lit(1e-300))) * 64).cast("long"))
    placed = placed.withColumn("c1", F.floor(part * MARK_CELLS).cast("long")).withColumn("c2", F.floor((part * MARK_CELLS - F.col("c1")) * MARK_CELLS).cast("long"))
    sums = placed.groupBy(F.col("c0").alias("cell")).agg(F.sum(m2).alias("s"))
    at = crossing(sums.withColumns({"before": F.lit(0.0), "goal": theta * F.sum("s").over(Window.partitionBy())}))
    inside = placed
    for name, finer in (("c0", "c1"), ("c1", "c2")):
        held = at.select(F.col("cell").alias(name), "before", "goal")
        inside = inside.drop("before", "goal").join(F.broadcast(held), name)  # one row
        at = crossing(inside.groupBy(F.col(finer).alias("cell")).agg(F.sum(m2).alias("s"), F.first("before").alias("before"), F.first("goal").alias("goal")))
    last = inside.drop("before", "goal").join(F.broadcast(at.select(F.col("cell").alias("c2"), "before", "goal")), "c2")
    last = last.groupBy(metric).agg(F.sum(m2).alias("m2__"), F.first("before").alias("before"), F.first("goal").alias("goal"))  # ties need no order
    order = Window.orderBy(F.desc(metric)).rowsBetween(Window.unboundedPreceding, -1)
    cutoff = last.withColumn("b__", F.col("before") + F.coalesce(F.sum("m2__").over(order), F.lit(0.0))).where("b__ < goal").agg(F.min(metric).alias("cutoff"))
    limit = cutoff.crossJoin(rows.agg(F.max(metric).alias("best"))).select(F.coalesce("cutoff", "best").alias("cutoff"))  # one row each
    return rows.crossJoin(F.broadcast(limit)).where(F.col(metric) >= F.col("cutoff") * (1 - 1e-12)).select(key, metric)


def coarsening_metric(now: DataFrame, before: DataFrame, key: str = "elem") -> DataFrame:
    """(key, mean_difference, volume_change) of samples (key, q, w, z) against those of the last round."""
    past = before.select(key, "q", F.col("z").alias("old"))
    sums = now.join(past, [key, "q"], "left").groupBy(key).agg(F.sum(F.col("w") * F.abs(F.col("z") - F.coalesce("old", F.col("z")))).alias("s"), F.sum("w").alias("area"))
    return sums.select(key, (F.col("s") / F.col("area")).alias("mean_difference"), F.col("s").alias("volume_change"))


def gather(dofs: DataFrame, x: DataFrame) -> DataFrame:
    """(elem, coefficients): each element's values in local order."""
    values = dofs.join(x.select(F.col("i").alias("dof"), "v"), "dof")
    return values.groupBy("elem").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "v"))), lambda s: s["v"]).alias("coefficients"))


def hanging_constraints(near: DataFrame, degree: int) -> DataFrame:
    """(leaf, local, master_leaf, master_local, w): fine edge coefficients from the coarse edge's.

    ``near`` is the mesh's adjacency. The corner that both elements share is no slave. Weights of zero are left out.
    """
    from tidalframe.functions.basis import extraction

    n = degree + 1
    rows = {"half": [], "r": [], "c": [], "w": []}
    for half in (0, 1):
        matrix = extraction(degree, half)
        for r in range(n):
            if r == (0 if half == 0 else degree):
                continue
            for c in range(n):
                if abs(matrix[r, c]) > 1e-14:
                    for name, value in zip(rows, (half, r, c, float(matrix[r, c])), strict=True):
                        rows[name].append(value)

    def place(edge: str, at: str) -> Column:
        e, k = F.col(edge), F.col(at)
        return F.when(e == 0, k * n).when(e == 1, k * n + degree).when(e == 2, k).otherwise(k + degree * n).cast("int")

    hanging = near.where("kind = 'fine_to_coarse'").select("*", F.inline(literal_rows(rows))).where("half = sub")
    return hanging.select("leaf", "edge", place("edge", "r").alias("local"), F.col("neighbour").alias("master_leaf"), place("neighbour_edge", "c").alias("master_local"), "w")


def children_mean(values: DataFrame) -> DataFrame:
    """Each parent's value as the mean of its children's: (lx, ly, ix, iy, v) one level up."""
    up = values.select((F.col("lx") - 1).alias("lx"), (F.col("ly") - 1).alias("ly"), F.floor(F.col("ix") / 2).cast("long").alias("ix"), F.floor(F.col("iy") / 2).cast("long").alias("iy"), "v")
    return up.groupBy("lx", "ly", "ix", "iy").agg(F.avg("v").alias("v"))


def first_match(rows: DataFrame, rules: DataFrame, on: str, priority: str, value: str) -> DataFrame:
    """Rows with the value of the first rule for their key; rules are reduced before they meet the rows."""
    best = rules.groupBy(on).agg(F.min_by(value, priority).alias(value))
    return rows.join(best, on, "left")


def take_each(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, in order."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank__") <= most).drop("rank__")


def violation(constraints: DataFrame, x: DataFrame) -> DataFrame:
    """One row: the norm of what constraint rows (row, col, v) leave of x (i, v)."""
    left = constraints.join(x.select(F.col("i").alias("col"), F.col("v").alias("x")), "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("r"))
    return left.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))


def indicator_marks(metrics: DataFrame, key: str, metric: str, refine: float, coarsen: float) -> DataFrame:
    """(key, indicator, action): the metric by its largest value; 1 refine, -1 coarsen, 0 keep."""
    top = metrics.agg(F.max(metric).alias("top"))
    rows = metrics.crossJoin(F.broadcast(top)).select(key, F.when(F.col("top") > 0, F.col(metric) / F.col("top")).otherwise(0.0).alias("indicator"))
    return rows.select(key, "indicator", F.when(F.col("indicator") > refine, 1).when(F.col("indicator") < coarsen, -1).otherwise(0).alias("action"))


def edge_slope_constraints(degree: int) -> list[tuple[int, int, float]]:
    """(side, local, w) of the condition that slopes across a shared edge agree, for conforming cells of one size.

    Side 0 is the cell left of the edge, side 1 the one right of it; one row of the condition takes
    the coefficients next to the edge in the same row of both cells.
    """
    return [(0, degree - 1, -1.0), (0, degree, 1.0), (1, 0, 1.0), (1, 1, -1.0)]


def slope_jumps(dofs: DataFrame, near: DataFrame, degree: int) -> DataFrame:
    """(row, col, v): slope continuity across the conforming vertical edges of a mesh.

    A row for each edge and coefficient row: what the slopes differ by, in global unknowns.
    """
    n = degree + 1
    terms = F.inline(literal_rows({"side": [s for s, _, _ in edge_slope_constraints(degree) for _ in range(n)], "local": [a + n * r for _, a, _ in edge_slope_constraints(degree) for r in range(n)], "r": [r for _ in range(4) for r in range(n)], "v": [w for _, _, w in edge_slope_constraints(degree) for _ in range(n)]}))
    pairs = near.where("kind = 'conforming' AND edge = 1").select("leaf", "neighbour", terms)
    rows = pairs.withColumn("elem", F.when(F.col("side") == 0, F.col("leaf")).otherwise(F.col("neighbour"))).join(dofs.hint("merge"), ["elem", "local"])
    return rows.groupBy("leaf", "r", F.col("dof").alias("col")).agg(F.sum("v").alias("v")).where("v <> 0").select((F.col("leaf") * n + F.col("r")).alias("row"), "col", "v")
