"""Hard negatives by ball-tree branch and bound.

1. Each task turns its rows into ball trees of ``TREE_ROWS`` rows, without a shuffle, so no label, id or copy makes one task
   larger; the trees are a table, a row a tree.
2. Anchors are numbered and taken in blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES``. A block, which is all that is broadcast, is
   searched in all trees twice: for the best rows of its anchors' labels (positives), then for the best rows
   of other labels in the score window of each positive. A task keeps its best rows over all of its trees and prunes by them, and
   emits at most k rows a query; the best k of all tasks are ranked by Spark.
3. A block's results are a table of their own, so a lost executor costs a part of one block.

Scores are exact: inner products of integers, in doubles where all sums are below 2**53 and in Python's integers beyond; scores
beyond a long count as its ends.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; a missing
component of a shorter vector is 0, an empty vector scores 0 with all; rows that repeat an id count each for themselves, as
anchors too, but none is a positive of another; with a negative positive score the window is empty; anchors without a positive or negative
have no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm import ball_tree
from tidalframe.llm.common import lean, materialise, partitions, prepare, scratch_dir
from tidalframe.llm.sharding import ranked

#: Most rows of a tree, and bytes of its vectors as doubles; likewise of a block of anchors.
TREE_ROWS, TREE_BYTES = 8192, 8 << 20
BLOCK, BLOCK_BYTES = 4096, 8 << 20
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in hundredths of the positive's.
WINDOW = (30, 90)
SCALE = 256.0

_TREE = "ids array<bigint>, labels array<bigint>, rows binary, lo array<bigint>, hi array<bigint>, lefts array<bigint>, rights array<bigint>, least array<bigint>, most array<bigint>, radius array<double>, centre binary, small boolean"
_LISTS = (("ids", "ids"), ("labels", "labels"), ("lo", "lo"), ("hi", "hi"), ("lefts", "left"), ("rights", "right"), ("least", "least"), ("most", "most"), ("radius", "radius"))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component as doubles, rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(flat, -1e300, 1e300)
    return out


def _packed(tree: ball_tree.Tree) -> pa.RecordBatch:
    small = bool(np.abs(tree.rows).max(initial=0) < 2**31)
    lists = {name: pa.array([getattr(tree, of)]) for name, of in _LISTS}
    blobs = {"rows": pa.array([tree.rows.astype(np.int32 if small else np.float64).tobytes()], pa.binary()), "centre": pa.array([tree.centre.tobytes()], pa.binary()), "small": pa.array([small])}
    names = [x.split()[0] for x in _TREE.split(", ")]
    return pa.RecordBatch.from_arrays([(lists | blobs)[n] for n in names], names=names)


def _unpacked(batch: pa.RecordBatch, i: int, width: int) -> ball_tree.Tree:
    lists = {of: batch.column(name)[i].values.to_numpy() for name, of in _LISTS}
    rows = np.frombuffer(batch.column("rows")[i].as_py(), dtype=np.int32 if batch.column("small")[i].as_py() else np.float64)
    return ball_tree.Tree(**lists, rows=rows.reshape(-1, width).astype(np.float64), centre=np.frombuffer(batch.column("centre")[i].as_py()).reshape(-1, width))


def _plant(width: int, most: int):
    """Trees of at most ``most`` rows each from the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return _packed(ball_tree.build(*(rows.column(c).to_numpy() for c in ("vec_id", "label")), _whole(rows.column("v"), width)))

        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == most:
                    yield tree()
        if sum(b.num_rows for b in held):
            yield tree()

    return run


def _best(width: int, block, k: int, same: bool):
    """(query, score, id) of the best rows of each query of the block in the trees of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ball_tree.Search(**block.value, k=k, same=same)
        for batch in batches:
            for i in range(batch.num_rows):
                search.visit(_unpacked(batch, i, width))
        query, score, ids = search.results()
        for lo in range(0, len(query), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (query, score, ids)], names=["query", "score", "id"])

    return run


def _searched(trees: DataFrame, width: int, block: dict, k: int, same: bool, name: str) -> DataFrame:
    """(query, score, id, rank) over all trees; the block is broadcast."""
    sent = trees.sparkSession.sparkContext.broadcast(block)
    found = trees.mapInArrow(lean(_best(width, sent, k, same)), "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)
    sent.destroy()
    return out


def window_of(score: np.ndarray, window: tuple[int, int] = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score s with window[0] * score <= 100 * s <= window[1] * score."""
    whole = score.tolist()
    return np.array([-(-window[0] * s // 100) for s in whole], dtype=np.int64), np.array([window[1] * s // 100 for s in whole], dtype=np.int64)


def hard_negatives(rows: DataFrame, anchor_every: int = 100, relabel_every: int = 0, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """Per anchor (``vec_id`` divisible by ``anchor_every``), positive and rank: anchor_id, positive_id, rank, negative_id and both scores.

    Where ``relabel_every`` is given, rows whose id it divides are first moved on to the next of ten labels.
    """
    spark = rows.sparkSession
    prepare(spark)
    vec_id, label = rows["vec_id"].cast("long"), rows["label"].cast("long")
    if relabel_every:
        label = F.when(vec_id % relabel_every == 0, (label + 1) % 10).otherwise(label)
    given = rows.select(vec_id.alias("vec_id"), label.alias("label"), F.transform(rows["embedding"], lambda x: x.cast("double")).alias("v"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = given.agg(F.max(F.size("v"))).first()[0] or 1
    trees = materialise(given.mapInArrow(lean(_plant(width, max(1, min(TREE_ROWS, TREE_BYTES // (8 * width))))), _TREE), "trees")
    anchors = given.where(F.col("vec_id") % anchor_every == 0).withColumns({"uid": F.monotonically_increasing_id(), "one": F.lit(1)})
    anchors = materialise(ranked(anchors, ["uid"], "one", partitions(anchors, TREE_BYTES)).select("rank", "vec_id", "label", "v"), "anchors")
    count, size = anchors.count(), max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    folder = f"{scratch_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for at in range(0, count, size):
        part = anchors.where(F.col("rank").between(at, at + size - 1)).toArrow()
        ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
        block = {"anchors": _whole(part.column("v"), width), "ids": ids, "labels": labels}
        ends = np.iinfo(np.int64)
        each = {"of": np.arange(len(ids)), "lo": np.full(len(ids), ends.min), "hi": np.full(len(ids), ends.max)}
        near = _searched(trees, width, block | each, positives, True, "positives").orderBy("query", "rank").toArrow()  # few a query
        of, score, who = (near.column(c).to_numpy() for c in ("query", "score", "id"))
        lo, hi = window_of(score, window)
        far = _searched(trees, width, block | {"of": of, "lo": lo, "hi": hi}, negatives, False, "negatives")
        asked = spark.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor_id": ids[of], "positive_id": who, "positive_score": score}), "query long, anchor_id long, positive_id long, positive_score long")
        out = far.join(F.broadcast(asked), "query").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.parquet(f"{folder}/block={at // size}")
    return spark.read.schema(kind).parquet(folder).drop("block") if count else spark.createDataFrame([], kind)
