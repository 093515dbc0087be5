"""Shards along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

1. Each dimension (by default language, source and size) is quantised to equal depth: a value's coordinate is
   the share of rows with smaller values, in ``2 ** BITS`` steps. Values are counted first, so a hot value is one row,
   and only the first value of each step (at most ``2 ** BITS`` of them) is sent to the rows.
2. A row's place is the Hilbert index of its coordinates (entry point and direction of the curve are carried from bit to bit),
   then doc_id, size and checksum, which divide a hot cell.
3. Slim rows without texts are range-partitioned by that place; counts and sizes per partition are summed over those
   few partitions, the rest inside each, so neither a cell nor a shard ever meets in one task.
4. Shard k holds the rows whose middle byte lies in the k-th of ``shards`` equal parts of all bytes. The cut runs are thus
   within one row's size of equal (law ``bytes``), and neighbours on the curve share shards, files and row groups, whose
   least and largest values then prune by any of the dimensions.

Edge cases: a null or empty text has size 8 and checksum 0; a null in a dimension is its smallest value; rows without a
doc_id come first in their cell; rows that repeat count each for themselves, and those that agree in place are
numbered in any order; with fewer rows than shards, or one row of more bytes than a shard's part, some shards are empty; an
empty table gives an empty result; other columns are ignored by ``hilbert_shards`` and kept by ``write_shards``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import materialise, partitions, prepare

SHARDS = 24
#: Bits of a coordinate.
BITS = 5
DIMENSIONS = ("lang", "source")
#: Bytes that a row weighs besides its text.
ROW_BYTES = 8
#: Bytes of slim rows as the optimizer counts them, and of whole rows, in a partition; fewest and most partitions of slim rows.
SLIM_BYTES, FILE_BYTES = 8 << 20, 256 << 20
FEWEST, MOST = 8, 200_000

#: Order of rows along the curve.
PLACE = ["curve", "doc_id", "size", "text_crc32"]


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve: axes are longs of ``bits`` bits each."""
    n = len(axes)
    if not 2 <= n <= 8 or n * bits > 62:
        raise ValueError("a curve takes 2 to 8 axes of 62 bits in all")
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    table = lambda of: F.array(*[F.lit(of(w)).cast("long") for w in range(1 << n)])
    trail = lambda w: (w ^ (w + 1)).bit_length() - 1  # set bits at the end
    inverse = table(gray.index)
    entry = table(lambda w: gray[2 * ((w - 1) // 2)] if w else 0)
    turn = table(lambda w: 0 if not w else trail(w - 1 if w % 2 == 0 else w) % n)
    mask = (1 << n) - 1
    left = lambda x, k: (F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftright", x, n - k))).bitwiseAND(F.lit(mask))
    right = lambda x, k: (F.call_function("shiftright", x, k).bitwiseOR(F.call_function("shiftleft", x, n - k))).bitwiseAND(F.lit(mask))

    def step(state: Column, bit: Column) -> Column:
        digit = F.lit(0).cast("long")
        for k, axis in enumerate(axes):
            digit = digit + F.call_function("shiftleft", F.call_function("shiftright", axis, bit).bitwiseAND(F.lit(1).cast("long")), F.lit(k))
        by = ((state["d"] + 1) % n).cast("int")
        w = F.get(inverse, right(digit.bitwiseXOR(state["e"]), by).cast("int")).cast("int")
        return F.struct(
            (F.call_function("shiftleft", state["h"], F.lit(n)) + w).alias("h"),
            state["e"].bitwiseXOR(left(F.get(entry, w), by)).alias("e"),
            ((state["d"] + F.get(turn, w) + 1) % n).cast("long").alias("d"),
        )

    start = F.struct(*[F.lit(0).cast("long").alias(x) for x in "hed"])
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, step, lambda s: s["h"])


def _slices(rows: DataFrame) -> int:
    """Partitions of a written table of slim rows."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(FEWEST, size // SLIM_BYTES), MOST))


def ranked(rows: DataFrame, order: Sequence[str], weight: str, slices: int) -> DataFrame:
    """Add ``rank``, the number of rows before each in ``order``, and ``before``, their summed ``weight``, with ``every`` of the whole table."""
    placed = materialise(rows.repartitionByRange(slices, *order).withColumn("part", F.spark_partition_id()), "ranged").repartition(slices, "part")
    sums = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(run), F.lit(0)).alias("w0"), F.sum("w").over(Window.partitionBy()).alias("every"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(bases), "part")  # a row a partition
    out = out.withColumns({"rank": F.col("n0") + F.row_number().over(inside) - 1, "before": F.col("w0") + F.sum(weight).over(inside) - F.col(weight)})
    return out.drop("part", "n0", "w0")


def _steps(rows: DataFrame, column: str, bits: int, slices: int) -> DataFrame:
    """One row: ``column``_steps, the first value of each step with its coordinate, in order (null values aside: they are 0)."""
    counts = rows.groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    at = ranked(counts, ["x"], "n", slices).select("x", F.expr(f"(before * {1 << bits}L) div every").alias("at"))
    firsts = at.where("x IS NOT NULL").groupBy("at").agg(F.min("x").alias("x"))  # at most 2 ** bits rows
    return firsts.agg(F.array_sort(F.collect_list(F.struct("x", "at"))).alias(f"{column}_steps"))


def _coordinate(value: Column, steps: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(steps, lambda s: s["x"] <= value), F.lit(-1))["at"], F.lit(0)).cast("long")


def _slim(docs: DataFrame, dimensions: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """What a row's place depends on, without its text; ``carry`` columns as ``row``."""
    text = docs["text"].cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    axes = [docs[c].alias(f"axis{k}") for k, c in enumerate(dimensions)]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *axes, size.alias(f"axis{len(axes)}"), *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))


def _on_curve(rows: DataFrame, steps: DataFrame, count: int, bits: int) -> DataFrame:
    """Add ``curve``; the steps are one row of at most ``2 ** bits`` values a dimension."""
    axes = [_coordinate(F.col(f"axis{k}"), F.col(f"axis{k}_steps")).alias(f"at{k}") for k in range(count)]
    at = rows.crossJoin(F.broadcast(steps)).select(*rows.columns, *axes)
    return at.withColumn("curve", hilbert_index([F.col(f"at{k}") for k in range(count)], bits))


def _plan(docs: DataFrame, shards: int, dimensions: Sequence[str], bits: int) -> tuple[DataFrame, DataFrame, int]:
    """The slim rows with rank and shard, the steps of all dimensions, and how many dimensions there are."""
    prepare(docs.sparkSession)
    slim, count = materialise(_slim(docs, dimensions), "slim"), len(dimensions) + 1
    slices = _slices(slim)
    steps = _steps(slim, "axis0", bits, slices)
    for k in range(1, count):
        steps = steps.crossJoin(_steps(slim, f"axis{k}", bits, slices))  # one row each
    steps = materialise(steps, "steps")
    placed = ranked(_on_curve(slim, steps, count, bits).select(*PLACE, *[f"at{k}" for k in range(count)]), PLACE, "size", slices)
    shard = F.expr(f"((2 * before + size) * {int(shards)}L) div (2 * every)").cast("int")
    return materialise(placed.withColumn("shard", shard).drop("before", "every"), "sharded"), steps, count


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the coordinates ``at0``, ``at1``, ..."""
    rows, _, count = _plan(docs, shards, dimensions, bits)
    first = rows.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *[f"at{k}" for k in range(count)])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> str:
    """Write whole rows to ``path``, a folder a shard, sorted along the curve; returns the name of the folder column.

    The first place of each shard (a row a shard) deals the rows out, so texts are shuffled once. Rows that agree in place
    stay together.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(x for k in range(len(taken) + 1) if (x := "shard" + "_" * k) not in taken)
    rows, steps, count = _plan(docs, shards, dimensions, bits)
    place = F.struct(*PLACE)
    firsts = rows.groupBy("shard").agg(F.min(place).alias("first")).agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("firsts"))
    whole = _on_curve(_slim(docs, dimensions, docs.columns), steps, count, bits).crossJoin(F.broadcast(firsts))
    shard = F.element_at(F.filter("firsts", lambda f: f["first"] <= place), -1)["shard"]
    dealt = whole.select("row", *PLACE, shard.alias("dealt"))
    dealt = dealt.repartitionByRange(max(shards, partitions(docs, FILE_BYTES)), "dealt", *PLACE).sortWithinPartitions("dealt", *PLACE)
    dealt.select("row.*", F.col("dealt").alias(name)).write.mode("overwrite").partitionBy(name).parquet(path)
    return name
