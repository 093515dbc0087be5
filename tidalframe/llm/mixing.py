"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents come in a shuffled order (by the MD5 of doc_id and text, so rows that repeat either
still spread), pass after pass. A
copy's virtual finish time is the number of its source's words up to and with it, divided by the
source's target; sorting all copies by that time and cutting at the total budget serves every
source in step with its weight.

Running totals never need a source in one task: a source is cut into 4096 buckets of its order,
bucket totals are summed by a window over those few rows, and only the rest is summed inside a
bucket. The cut is found the same way: a histogram of finish times (two levels of 4096 cells)
finds the cell where the budget runs out, and only that cell is sorted.

Edge cases: a null or wordless text has size 0 and is never taken; a null source is a source of
its own, last in order; rows that repeat a doc_id count each for itself; an empty table gives an
empty result; other columns are ignored, or carried along by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise, prepare

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
CELLS = 4096

#: Order of copies: virtual finish time, then whatever tells them apart.
KEY = ["v", "pass", "gone", "source", "h", "doc_id", "size"]

WORD = r"[^\x20\x09-\x0D]+"


def _targets(totals: DataFrame, weights: Sequence[int], share: float, passes: int) -> DataFrame:
    """One row per source with its size, target and the budget: water filling with caps.

    In ascending order of cap per weight, a source is capped if even the level at its turn, with
    all before it capped, reaches its cap.
    """
    rank = Window.orderBy("gone", "source")
    fill = Window.orderBy("ratio", "gone", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    rows = totals.withColumn("w", F.element_at(kinds, ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * passes).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / left
    rows = rows.withColumn("full", level >= F.col("ratio"))
    capped = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("budget") - capped) / free)
    return rows.select("sk", "source_size", target.alias("target"), "budget")


def _cut(timed: DataFrame, key: list[str], passes: int) -> DataFrame:
    """One row: the sort key of the last copy within the budget (null if none is)."""
    copies = timed.where("size > 0 AND target > 0").select("budget", "gone", "source", "h", "doc_id", "size", F.explode(F.col("times")).alias("t")).select("*", "t.*").drop("t")
    cell: Column = F.least(F.floor(F.col("v") * CELLS), F.lit(2 * CELLS)).cast("long")
    fine: Column = F.greatest(F.lit(0), F.least(F.floor((F.col("v") * CELLS - F.col("cell")) * CELLS), F.lit(CELLS - 1))).cast("long")
    copies = copies.withColumn("cell", cell).withColumn("fine", fine)

    def crossing(rows: DataFrame, by: str, done: Column) -> DataFrame:
        """The first cell whose running total passes the budget, and the total before it."""
        run = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = rows.groupBy(by).agg(F.sum("size").alias("s"), F.max("budget").alias("budget"), F.max(done).alias("done"))
        counted = counted.withColumn("upto", F.col("done") + F.sum("s").over(run))
        return counted.where("upto > budget").agg(F.min_by(F.struct(F.col(by), (F.col("upto") - F.col("s")).alias("done")), F.col(by)).alias("x")).select(f"x.{by}", "x.done")

    first = materialise(crossing(copies, "cell", F.lit(0).cast("long")).select(F.col("cell").alias("c1"), F.col("done").alias("d1")), "cut")
    inner = copies.crossJoin(F.broadcast(first)).where("cell = c1")
    second = materialise(crossing(inner, "fine", F.col("d1")).select(F.col("fine").alias("c2"), F.col("done").alias("d2")), "cut")
    last = inner.crossJoin(F.broadcast(second)).where("fine = c2")
    run = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = last.withColumn("all", F.col("d2") + F.sum("size").over(run)).where("all <= budget")
    end = kept.agg(F.max(F.struct(*key)).alias("end"))
    one = lambda x, c: F.broadcast(x.agg(F.max(c).alias(c)))
    return materialise(end.crossJoin(one(first, "c1")).crossJoin(one(second, "c2")), "cut")


def _sized(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Each row's place in its source's order and its size, with the ``carry`` columns as ``row``."""
    source = docs["source"].cast("string")
    doc_id = docs["doc_id"].cast("long")
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), source.isNull().cast("int").alias("gone"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("sk"),
        F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary")).alias("h"),
        *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []),
    ).withColumn("bucket", F.substring("h", 1, 3))


def _timed(rows: DataFrame, bases: DataFrame, passes: int) -> DataFrame:
    inside = Window.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("size").over(inside)).join(bases, ["sk", "bucket"])
    time = lambda k: ((F.col("base") + F.col("within") + F.lit(k) * F.col("source_size")) / F.col("target"))
    return rows.withColumn("times", F.array(*[F.struct(time(k).alias("v"), F.lit(k).alias("pass")) for k in range(passes)]))


def _mix(docs: DataFrame, weights: Sequence[int], share: float, passes: int, carry: Sequence[str]) -> DataFrame:
    """The rows with their target and ``picked`` times.

    Sizes are counted once and written without texts; bucket totals, targets and the cut come
    from that table, and each is a small table itself, so no plan repeats another.
    """
    prepare(docs.sparkSession)
    slim = materialise(_sized(docs, ()), "sizes")
    per = materialise(slim.groupBy("sk", "bucket").agg(F.sum("size").alias("s"), F.max("source").alias("source"), F.max("gone").alias("gone")), "buckets")
    totals = per.groupBy("sk").agg(F.sum("s").alias("source_size"), F.max("source").alias("source"), F.max("gone").alias("gone"))
    before = F.sum("s").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s")
    bases = materialise(per.select("sk", "bucket", before.alias("base")).join(_targets(totals, weights, share, passes), "sk"), "bases")
    cut = _cut(_timed(slim, bases, passes), KEY, passes)
    return _taken(_timed(_sized(docs, carry) if carry else slim, bases, passes), KEY, cut)


def _taken(timed: DataFrame, key: list[str], cut: DataFrame) -> DataFrame:
    """The rows with ``picked``: the times at which they are taken."""
    rows = timed.crossJoin(F.broadcast(cut))  # one row
    cell = lambda t: F.least(F.floor(t["v"] * CELLS), F.lit(2 * CELLS)).cast("long")
    fine = lambda t: F.greatest(F.lit(0), F.least(F.floor((t["v"] * CELLS - cell(t)) * CELLS), F.lit(CELLS - 1))).cast("long")
    mine = lambda t: F.struct(*[t[k] if k in ("v", "pass") else F.col(k) for k in key])
    before = lambda t: F.col("c1").isNull() | (cell(t) < F.col("c1")) | ((cell(t) == F.col("c1")) & (F.col("c2").isNull() | (fine(t) < F.col("c2")) | ((fine(t) == F.col("c2")) & F.coalesce(mine(t) <= F.col("end"), F.lit(False)))))
    picked = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter("times", before)).otherwise(F.filter("times", lambda _: F.lit(False)))
    return rows.withColumn("picked", picked)


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    out = _mix(docs, weights, share, passes, ())
    return out.select("doc_id", "size", "source_size", "target", (F.size("picked") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, once for each time they are
    taken, range-sorted by virtual finish time."""
    out = _mix(docs, weights, share, passes, docs.columns).select("row", "gone", "source", "h", "doc_id", "size", F.explode("picked").alias("t"))
    return out.orderBy("t.v", "t.pass", "gone", "source", "h", "doc_id", "size").select("row.*")
