"""Job: readings in field notes, incrementally.

    python -m jobs.field_notes --notes /data/documents.parquet --output /data/notes --checkpoint /data/notes.mark [--config ...]

Notes and logs come as text, file by file. A file stream takes the files that no earlier run took (its checkpoint knows them), and
ends when there are no more. Of every note the job counts lines and words and takes out the readings, decimal numbers in
their order; of every source it keeps a digest.

The output has two tables. ``notes`` has a row for each note, partitioned by source and batch; ``sources`` a row for each source, partitioned by
source, made from ``notes`` alone for the sources that a batch touches. Both are written by dynamic partition overwrite: a batch that is
run again after a failure replaces what it wrote. Readings are whole thousandths, so sums don't depend on their order.

Edge cases: a null note has no line, an empty one has one; a null source is a source; notes whose doc_id
comes again count again; without any file nothing is written.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs.field_notes")

CONFIG = Path(__file__).with_suffix(".json")
WORD = r"[^\x20\x09-\x0D]+"
MEASURES = "lines bigint, words bigint, readings bigint, total bigint, low bigint, high bigint, first bigint, last bigint"
NOTES = f"doc_id bigint, lang string, {MEASURES}, source string, batch bigint"
SOURCES = f"documents bigint, {MEASURES}, source string"


def config_of(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def digest_of_notes(notes: DataFrame, number: str) -> DataFrame:
    """Per note: its measures; readings in thousandths."""
    text = notes["text"].cast("string")
    found = F.transform(F.regexp_extract_all(text, F.lit(number), F.lit(0)), lambda s: (s.cast("decimal(12,3)") * 1000).cast("long"))
    rows = notes.select(notes["doc_id"].cast("long").alias("doc_id"), notes["lang"].cast("string").alias("lang"), notes["source"].cast("string").alias("source"), text.alias("text"), F.coalesce(found, F.array().cast("array<bigint>")).alias("r"))
    return rows.select(
        "doc_id", "lang",
        F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.size("r").cast("long").alias("readings"),
        F.aggregate("r", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
        F.array_min("r").alias("low"), F.array_max("r").alias("high"), F.get("r", F.lit(0)).alias("first"), F.try_element_at("r", F.lit(-1)).alias("last"),
        "source",
    )


def digest_of_sources(notes: DataFrame) -> DataFrame:
    """Per source: its measures; the first and last reading are those of the least and greatest doc_id with readings."""
    some = F.col("readings") > 0
    sums = [F.sum(c).alias(c) for c in ("lines", "words", "readings", "total")]
    ends = [of(F.when(some, F.struct("doc_id", c)))[c].alias(c) for of, c in ((F.min, "first"), (F.max, "last"))]
    return notes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *sums, F.min("low").alias("low"), F.max("high").alias("high"), *ends)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_output(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The tables ``notes`` and ``sources``."""
    return spark.read.schema(NOTES).parquet(f"{output}/notes"), spark.read.schema(SOURCES).parquet(f"{output}/sources")


def run(spark: SparkSession, notes: str, output: str, checkpoint: str, config: Mapping) -> dict[str, int]:
    """Take the new files of ``notes``; how many batches, notes and sources that was."""
    told = {"batches": 0, "notes": 0, "sources": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = digest_of_notes(batch, config["number"]).withColumn("batch", F.lit(number).cast("long"))
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(int(config["files_per_source"])))  # a hot source is several files
        _write(rows.repartition("source", spread), f"{output}/notes", "source", "batch")
        every = session.read.schema(NOTES).parquet(f"{output}/notes")
        touched = every.where(F.col("batch") == number).select(F.col("source").alias("touched")).distinct()
        of = every.join(touched, F.col("source").eqNullSafe(F.col("touched")), "left_semi")
        _write(digest_of_sources(of), f"{output}/sources", "source")
        counts = every.where(F.col("batch") == number).agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))).first()
        log.info("batch %s: read %s notes, wrote %s sources to %s", number, *counts, output)
        told.update(batches=told["batches"] + 1, notes=told["notes"] + counts[0], sources=told["sources"] + counts[1])

    schema = spark.read.parquet(notes).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(notes)
    started = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    log.info("took %s from %s", told, notes)
    return told


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=(__doc__ or "").partition("\n")[0])
    parser.add_argument("--notes", required=True, help="Parquet notes (doc_id, lang, source, text): a folder or a pattern of files")
    parser.add_argument("--output", required=True, help="folder of the tables notes and sources")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("field_notes").getOrCreate()
    try:
        run(spark, given.notes, given.output, given.checkpoint, config_of(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
