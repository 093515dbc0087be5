"""Reading tables and cutting lineage through the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else, on one machine only, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return root or "/tmp/checkpoints"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to, and read from, the folder that driver and executors share, a folder a value of ``by``."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, float]]:
    """``materialise`` with sums over the rows, taken while they are written; sums of nothing are 0."""
    seen = Observation()
    out = materialise(df.observe(seen, *[F.sum(c).alias(n) for n, c in sums.items()]), name)
    return out, {n: v or 0.0 for n, v in seen.get.items()}


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its number in ``order`` from 0 on as ``name``, and the number of rows as ``total``.

    Rows are range-partitioned by sampled cuts and written; a window sums the few counts per partition and the rest is numbered
    inside each, so crowded corners get partitions of their own.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialise(df.repartitionByRange(slices, *order).withColumn("slice__", F.spark_partition_id()), "ranged")
    counts = placed.groupBy("slice__").agg(F.count(F.lit(1)).alias("n__"))
    run = Window.orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("slice__", F.coalesce(F.sum("n__").over(run), F.lit(0)).alias("base__"), F.sum("n__").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("slice__").orderBy(*order))
    out = placed.withColumn("rank__", inside).join(F.broadcast(bases), "slice__")  # a row a partition
    return out.withColumn(name, (F.col("base__") + F.col("rank__") - 1).cast("long")).drop("slice__", "rank__", "base__")


def bucketed(df: DataFrame, name: str, by: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted ``by`` a column: joins on it don't shuffle the table again.

    The table's name is new with every call; ``drop`` takes it away.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    count = buckets or max(1, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    df.repartition(count, by).write.format("parquet").bucketBy(count, by).sortBy(by).option("path", f"{scratch(spark)}/{unique}").saveAsTable(unique)
    out = spark.table(unique)
    out.bucketed_as = unique
    return out


def drop(df: DataFrame) -> None:
    """Forget a table of ``bucketed`` and delete its files."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{df.bucketed_as}")
    spark.sql(f"DROP TABLE IF EXISTS {df.bucketed_as}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
