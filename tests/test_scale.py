"""Plans and parts that keep drivers and tasks small on large tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidalframe.operators import large, mesh
from tidalframe.plans import registry
from tidalframe.sinks import grids


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_slope_constraints_broadcast_nothing(spark, sf_dir):
    assert "BroadcastExchange" not in plan(registry.QUERIES["slope_constraints"](spark, sf_dir))


def test_adjacency_broadcasts_nothing(spark):
    cells = mesh.uniform(spark, 2, 2).withColumn("leaf", F.col("iy") * 4 + F.col("ix"))
    frame = mesh.adjacency(cells, 2)
    assert "BroadcastExchange" not in plan(frame) and frame.groupBy("kind").count().orderBy("kind").collect() == [("boundary", 16), ("conforming", 48)]


def test_gradients_sum_nothing_per_question(spark, tmp_path):
    spark.createDataFrame([(k, n, float(k * k + 3 * n)) for k in range(64) for n in range(64)], "o_custkey long, o_orderkey long, o_totalprice double").toPandas().to_parquet(tmp_path / "orders.parquet")
    spark.createDataFrame([(7, 900.0), (7, 900.0), (8, 5000.0), (9, -1000.0)], "c_custkey long, c_acctbal double").toPandas().to_parquet(tmp_path / "customer.parquet")
    frame = registry.QUERIES["central_gradient"](spark, str(tmp_path))
    got, want = same(frame, connect(str(tmp_path)), registry.ORACLE_SQL["central_gradient"])
    assert got == want and len(got) == 3
    text = plan(registry.QUERIES["central_gradient"](spark, str(tmp_path)))
    assert "pivotfirst" not in text and text.count("BroadcastExchange") == 1


def test_grid_parts_grow_with_the_table(spark, tmp_path):
    nodes = F.array(*[F.lit(float(k)) for k in range(8)])
    cells = spark.range(300).select(F.col("id").alias("elem"), nodes.alias("x"), nodes.alias("y"), nodes.alias("z"), nodes.alias("v"))
    files = grids.write_pieces(cells, str(tmp_path), "g", grids.HEXAHEDRON, ("v",), parts=2, encoding="ascii", most=1000)
    held = [int(re.search(r'NumberOfCells="(\d+)"', (tmp_path / f).read_text())[1]) for f in files]
    assert sum(held) == 300 and max(held) <= 75 and (tmp_path / "g.pvtu").read_text().count("<Piece ") == len(files)


def test_small_matrices_have_few_buckets(spark):
    matrix = spark.range(100).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    kept = large.held(matrix, "matrix")
    assert kept.count() == 100 and len(kept.inputFiles()) == 1
    large.drop(kept)
