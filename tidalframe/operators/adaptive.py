"""An adaptive fit of scattered depths: solve on a mesh, measure, mark, refine, and again, each round from the last one's solution.

The surface is bilinear on the leaves of a graded quadtree and continuous; corners that hang on a coarser neighbour's edge follow its ends.
It minimises the weighted squared misfit to the samples plus ``smoothing`` times the squared slope, so cells without samples are
determined too. Mesh, unknowns, system and coefficients of a round are tables; the driver holds one line a round.

It stops at the first of: ``threshold`` (no cell's misfit is larger), ``elements`` (as many as allowed), ``nothing to refine`` (all that
is marked is as deep as allowed or has too few samples), ``rounds``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators import fit, large, mesh
from tidalframe.sources.tables import materialise

HISTORY = "round int, elements long, unknowns long, iterations int, warm double, most double, mean double, marked long, reason string"
#: The squared slope of a bilinear cell, which doesn't depend on its size; corners x fastest.
SLOPE = tuple(v / 6 for v in (4, -1, -1, -2, -1, 4, -2, -1, -1, -2, 4, -1, -2, -1, -1, 4))


@dataclass
class Round:
    """``warm``: the residual that the start left, over the right side's size."""

    round: int
    elements: int
    unknowns: int
    iterations: int
    warm: float
    most: float
    mean: float
    marked: int
    reason: str


def corners(leaves: DataFrame) -> DataFrame:
    """(elem, local, x, y), x fastest."""
    at = leaves.select(F.col("leaf").alias("elem"), "xmin", "xmax", "ymin", "ymax", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("local"))
    return at.select("elem", "local", F.when(F.col("local") % 2 == 1, F.col("xmax")).otherwise(F.col("xmin")).alias("x"), F.when(F.col("local") >= 2, F.col("ymax")).otherwise(F.col("ymin")).alias("y"))


def hanging(leaves: DataFrame, dofs: DataFrame, deepest: int, most_rounds: int = 32) -> DataFrame:
    """(slave, master, w): corners on a coarser neighbour's edge; masters that hang themselves are replaced by theirs."""
    local = fit.hanging_constraints(mesh.adjacency(leaves, deepest), 1)
    slave = dofs.select(F.col("elem").alias("leaf"), "local", F.col("dof").alias("slave"))
    master = dofs.select(F.col("elem").alias("master_leaf"), F.col("local").alias("master_local"), F.col("dof").alias("master"))
    out = materialise(local.join(slave, ["leaf", "local"]).join(master, ["master_leaf", "master_local"]).select("slave", "master", "w").distinct(), "hanging")
    for _ in range(most_rounds):
        again = out.select(F.col("slave").alias("master"), F.col("master").alias("its"), F.col("w").alias("more"))
        if out.join(again, "master", "left_semi").isEmpty():
            return out
        deeper = out.join(again, "master", "left").select("slave", F.coalesce("its", "master").alias("master"), (F.col("w") * F.coalesce("more", F.lit(1.0))).alias("w"))
        out = materialise(deeper.groupBy("slave", "master").agg(F.sum("w").alias("w")), "hanging")
    raise RuntimeError("hanging corners form a circle")


def warm_start(leaves: DataFrame, dofs: DataFrame, before: DataFrame | None) -> DataFrame | None:
    """(i, v): what the last round's surface (KEY, box, coefficients) is at each unknown; a leaf finds itself or its nearest ancestor there."""
    if before is None:
        return None
    up = leaves.select("leaf", "lx", "ly", "ix", "iy", F.explode(F.sequence(F.lit(0), F.col("lx"))).alias("up"))
    here = up.select("leaf", (F.col("lx") - F.col("up")).cast("int").alias("lx"), F.expr("shiftright(ix, CAST(up AS INT))").alias("ix"), F.expr("shiftright(iy, CAST(up AS INT))").alias("iy"))
    old = here.join(before.select(F.col("lx").cast("int").alias("lx"), "ix", "iy", "xmin", "xmax", "ymin", "ymax", "coefficients"), ["lx", "ix", "iy"]).withColumnRenamed("leaf", "elem")  # leaves cover, so one matches
    at = corners(leaves).join(old.select("elem", F.col("xmin").alias("x0"), F.col("xmax").alias("x1"), F.col("ymin").alias("y0"), F.col("ymax").alias("y1"), "coefficients"), "elem")
    u, v = (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    c = [F.col("coefficients")[k] for k in range(4)]
    value = (c[0] * (1 - u) + c[1] * u) * (1 - v) + (c[2] * (1 - u) + c[3] * u) * v
    return at.select("elem", "local", value.alias("v")).join(dofs, ["elem", "local"]).groupBy(F.col("dof").alias("i")).agg(F.min("v").alias("v"))


def located(samples: DataFrame, leaves: DataFrame, box: Sequence[float], levels: Sequence[int]) -> DataFrame:
    """(elem, u, v, w, z) of the samples (id, x, y, z, w) inside of the box."""
    found = mesh.locate(samples, leaves, box, levels, ("id",)).where("leaf >= 0")
    at = samples.join(found, "id").join(leaves.select("leaf", "xmin", "xmax", "ymin", "ymax"), "leaf")
    return at.select(F.col("leaf").alias("elem"), ((F.col("x") - F.col("xmin")) / (F.col("xmax") - F.col("xmin"))).alias("u"), ((F.col("y") - F.col("ymin")) / (F.col("ymax") - F.col("ymin"))).alias("v"), "w", "z")


def solve_on(leaves: DataFrame, here: DataFrame, deepest: int, smoothing: float, tolerance: float, before: DataFrame | None) -> tuple[DataFrame, int, list[float], float]:
    """(leaf, coefficients), the number of free unknowns, residual norms and the right side's size."""
    dofs = materialise(fit.conforming_dofs(corners(leaves)), "dofs")
    slaves = hanging(leaves, dofs, deepest)
    matrix, load = fit.normal_equations(here, dofs, 1)
    pairs = F.posexplode(F.array(*[F.lit(v) for v in SLOPE])).alias("p", "k")
    local = leaves.select(F.col("leaf").alias("elem"), pairs).select("elem", F.floor(F.col("p") / 4).cast("int").alias("a"), (F.col("p") % 4).alias("c"), (F.col("k") * smoothing).alias("v"))
    rows, columns = (dofs.select("elem", F.col("local").alias(a), F.col("dof").alias(i)) for a, i in (("a", "i"), ("c", "j")))
    stiff = local.join(rows, ["elem", "a"]).join(columns, ["elem", "c"]).select("i", "j", "v")
    system = materialise(fit.condense(fit.assemble(matrix.unionByName(stiff), 0.0), slaves), "system")
    every = dofs.select(F.col("dof").alias("i")).distinct().join(load, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
    right = materialise(fit.condense_load(every, slaves), "right")
    start = warm_start(leaves, dofs, before)
    x, norms = large.conjugate_gradients(system, right, start=start, tolerance=tolerance)
    size = right.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
    values = materialise(fit.gather(dofs, fit.expand(x, slaves)), "values")
    return values.select(F.col("elem").alias("leaf"), "coefficients"), right.count(), norms, size


def misfit(here: DataFrame, values: DataFrame) -> DataFrame:
    """(leaf, n, error): samples of each leaf and their weighted root mean square misfit."""
    c = [F.col("coefficients")[k] for k in range(4)]
    u, v = F.col("u"), F.col("v")
    off = F.col("z") - ((c[0] * (1 - u) + c[1] * u) * (1 - v) + (c[2] * (1 - u) + c[3] * u) * v)
    rows = here.withColumnRenamed("elem", "leaf").join(values, "leaf").select("leaf", "w", off.alias("off"))
    return rows.groupBy("leaf").agg(F.count("w").alias("n"), F.sqrt(F.sum(F.col("w") * F.col("off") * F.col("off")) / F.sum("w")).alias("error"))


def adaptive_fit(samples: DataFrame, box: Sequence[float], base: int, deepest: int, threshold: float, theta: float = 0.5, smoothing: float = 1e-3, few: int = 4, most_elements: int = 1 << 40, most_rounds: int = 8, tolerance: float = 1e-8) -> tuple[DataFrame, list[Round]]:
    """The last round's leaves (leaf, KEY, box, coefficients), and the history. ``samples``: id, x, y, z, w; positions or values that are
    null leave a sample out."""
    spark, levels = samples.sparkSession, range(base, deepest + 1)
    samples = materialise(samples.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND w > 0").select("id", "x", "y", "z", "w"), "samples")
    splits, before, history = None, None, []
    for k in range(most_rounds):
        cells = mesh.uniform(spark, base, base) if splits is None else mesh.leaves_of(spark, splits, base)
        leaves = materialise(mesh.with_boxes(mesh.numbered(cells, deepest), box), "leaves")
        here = materialise(located(samples, leaves, box, levels), "located")
        values, unknowns, norms, size = solve_on(leaves, here, deepest, smoothing, tolerance, before)
        before = materialise(leaves.join(values, "leaf"), "surface")
        found = materialise(misfit(here, values), "misfit")
        top, mean = found.agg(F.max("error"), F.avg("error")).first()
        count = leaves.count()
        reason = "threshold" if (top or 0.0) <= threshold else "elements" if count >= most_elements else ""
        marked = None
        if not reason:
            chosen = fit.dorfler(found, "leaf", "error", theta).join(found.select("leaf", "n"), "leaf").where(f"n >= {few}").join(leaves, "leaf").where(f"lx < {deepest}")
            marked = materialise(chosen.select(F.col("lx").cast("int").alias("level"), "ix", "iy"), "marked")
        n = 0 if marked is None else marked.count()
        reason = reason or ("" if n else "nothing to refine") or ("rounds" if k == most_rounds - 1 else "")
        history.append(Round(k, count, unknowns, len(norms) - 1, norms[0] / size if size else 0.0, float(top or 0.0), float(mean or 0.0), n, reason))
        if reason:
            break
        wanted = marked if splits is None else splits.unionByName(marked)
        splits = materialise(mesh.graded_splits(wanted, base), "splits")
    return before, history


def history_frame(spark, history: Sequence[Round]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in history], HISTORY)  # a row a round
