"""Tables of a benchmark report: ratios, statistics, pivots, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratios(history: DataFrame, key: str, order: Sequence[str], residual: str) -> DataFrame:
    """Each residual over the one before it; after a zero it is infinite, or no number if it is zero too."""
    along = Window.partitionBy(key).orderBy(*order)
    last = F.col("last__")
    ratio = F.when(last == 0, F.col(residual) * F.pow(last, F.lit(-1.0))).otherwise(F.col(residual) / last)  # a plain division by zero raises
    return history.select(key, *order, residual, F.lag(residual).over(along).alias("last__")).select(key, *order, residual, ratio.alias("ratio"))


def convergence_rate(history: DataFrame, key: str, order: Sequence[str], residual: str, most: float | None = 10.0) -> DataFrame:
    """Mean ratio of consecutive residuals, of those above 0 and below ``most``."""
    good = F.col("ratio") > 0 if most is None else (F.col("ratio") > 0) & (F.col("ratio") < most)
    return ratios(history, key, order, residual).where(good).groupBy(key).agg(F.avg("ratio").alias("rate"), F.count("ratio").alias("n"))


def statistics(rows: DataFrame, key: str, value: str, marked: str | None = None) -> DataFrame:
    """Count, range, mean, median, population deviation and percentiles of the positive values."""
    v = F.col(value)
    cuts = [F.percentile(v, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.75, 0.90, 0.99)]
    more = [] if marked is None else [F.count_if(F.col(marked)).alias("marked"), F.min(F.when(F.col(marked), v)).alias("marked_min"), F.max(F.when(F.col(marked), v)).alias("marked_max")]
    return rows.where(v > 0).groupBy(key).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), *cuts, *more)


def pivot_first(rows: DataFrame, index: str, columns: str, value: str, names: Sequence[str], order: str) -> DataFrame:
    """One row for each index, one column for each name: the value of least ``order``."""
    firsts = rows.groupBy(index, columns).agg(F.min_by(value, order).alias("v"))
    return firsts.groupBy(index).pivot(columns, list(names)).agg(F.first("v"))


def pairs(values: DataFrame, item: str, name: str, value: str) -> DataFrame:
    """Every two names (a < b) over their common items: L2, relative and largest difference."""
    left = values.select(item, F.col(name).alias("a"), F.col(value).alias("x"))
    right = values.select(item, F.col(name).alias("b"), F.col(value).alias("y"))
    d = F.col("x") - F.col("y")
    joined = left.join(right, item).where("a < b")
    sums = joined.groupBy("a", "b").agg(F.sqrt(F.sum(d * d)).alias("l2"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"), F.max(F.abs(d)).alias("largest"))
    top = F.greatest("na", "nb")
    return sums.select("a", "b", "l2", F.when(top > 1e-14, F.col("l2") / top).otherwise(F.lit(0.0)).alias("relative"), "largest")


def first_last(history: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    at = F.struct(*order)
    return history.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(value).alias("n"))


def preferred_order(name: Column, preferred: Sequence[str]) -> Column:
    """Sort key: listed names in their order, then the rest."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), name)
    return F.when(at > 0, at).otherwise(F.lit(len(preferred) + 1)).cast("int")


#: How metrics are written; fixed values. All others have two decimals in scientific form.
WHOLE = ("schur_cg_iterations", "qinv_apply_calls", "iterations", "total_solve_ms", "total_ms")
THREE = ("solution_l2_norm", "objective_value")
FOUR = ("data_residual", "regularization_energy")


def _scientific(value: Column) -> Column:
    """Two decimals in scientific form, ties to even."""
    size = F.abs(value)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(0).cast("int")
    power = power + F.when(F.bround(size / F.pow(F.lit(10.0), power), 2) >= 10, 1).when((size > 0) & (size / F.pow(F.lit(10.0), power) < 1), -1).otherwise(0)
    return F.format_string("%.2fe%s%02d", F.bround(value / F.pow(F.lit(10.0), power), 2), F.when(power < 0, "-").otherwise("+"), F.abs(power))


def formatted(name: Column, value: Column) -> Column:
    """A metric as text: counts and times cut to whole numbers, norms with three, residuals with four decimals; ties to even."""
    return (
        F.when(name.isin(*WHOLE), value.cast("long").cast("string"))
        .when(name.isin(*THREE), F.format_string("%.3f", F.bround(value, 3)))
        .when(name.isin(*FOUR), F.format_string("%.4f", F.bround(value, 4)))
        .otherwise(_scientific(value))
    )


def complexity_lines(rows: DataFrame, size: str, time: str, powers: Sequence[float] = (1.0, 1.5, 2.0)) -> DataFrame:
    """At each size the times that growth by each power predicts from the mean at the smallest size."""
    small = rows.agg(F.min(size).alias("s0"))
    base = rows.crossJoin(F.broadcast(small)).where(F.col(size) == F.col("s0")).agg(F.first("s0").alias("s0"), F.avg(time).alias("t0"))
    lines = [(F.col("t0") * F.pow(F.col(size) / F.col("s0"), F.lit(float(p)))).alias(f"line{k}") for k, p in enumerate(powers)]
    return rows.select(size).distinct().crossJoin(F.broadcast(base)).select(size, *lines)


def rms(rows: DataFrame, key: str, weight: str, diff: str) -> DataFrame:
    """Weighted root mean square."""
    return rows.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(diff) * F.col(diff)) / F.sum(weight)).alias("rms"))
