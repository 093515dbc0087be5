"""The jobs as queries: each runs its job twice into a new folder and returns the whole output, with SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import depth_mesh, field_notes
from tidalframe.sources.tables import scratch


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def job1_depth_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graded mesh with depths of all soundings."""
    folder = _folder(spark, "job1")
    for _ in range(2):
        depth_mesh.run(spark, f"{sf_dir}/lineitem.parquet", folder, depth_mesh.config_of())
    r = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return spark.read.parquet(folder).select("leaf", "lx", "ix", "iy", "xmin", "xmax", "ymin", "ymax", "soundings", r("low"), r("high"), r("depth"), "from_level", "tile")


def job2_field_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes with their measures, and the digests of all sources."""
    folder, mark = _folder(spark, "job2"), _folder(spark, "job2-mark")
    for _ in range(2):
        field_notes.run(spark, f"{sf_dir}/documents.parquet*", folder, mark, field_notes.config_of())
    notes, sources = field_notes.read_output(spark, folder)
    measures = ("lines", "words", "readings", "total", "low", "high", "first", "last")
    one = notes.select(F.lit("note").alias("kind"), "source", "doc_id", "lang", F.lit(1).cast("long").alias("documents"), *measures)
    return one.unionByName(sources.select(F.lit("source").alias("kind"), "source", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "documents", *measures))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_depth_mesh": job1_depth_mesh, "job2_field_notes": job2_field_notes}

ORACLE_SQL: dict[str, str] = {
    "job1_depth_mesh": """
        WITH RECURSIVE p AS (SELECT (l_partkey % 1031)::DOUBLE AS x, ((l_suppkey * 37 + l_orderkey) % 1024)::DOUBLE AS y, l_extendedprice / 977e0 AS z FROM lineitem),
        fine AS (SELECT least(floor(x / 2), 511)::BIGINT AS fx, least(floor(y / 2), 511)::BIGINT AS fy, z FROM p WHERE x BETWEEN 0 AND 1024 AND y BETWEEN 0 AND 1024 AND z IS NOT NULL),
        cell AS (SELECT lx, fx >> (9 - lx) AS ix, fy >> (9 - lx) AS iy, count(*) AS n, sum(z) AS total, min(z) AS low, max(z) AS high FROM fine, range(3, 10) AS l(lx) GROUP BY ALL),
        split AS (
            SELECT lx, ix, iy FROM cell WHERE n >= 8 AND high - low > 85 AND lx < 9
            UNION
            SELECT s.lx - 1, (s.ix + a) >> 1, (s.iy + b) >> 1 FROM split AS s, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS d(a, b)
            WHERE s.lx > 3 AND s.ix + a BETWEEN 0 AND 2 ** s.lx - 1 AND s.iy + b BETWEEN 0 AND 2 ** s.lx - 1),
        every AS (
            SELECT 3 AS lx, i % 8 AS ix, i // 8 AS iy FROM range(64) AS r(i)
            UNION ALL SELECT lx + 1, 2 * ix + a, 2 * iy + b FROM split, range(2) AS p(a), range(2) AS q(b)),
        leaf AS (SELECT *, ix << (9 - lx) AS cx, iy << (9 - lx) AS cy FROM every ANTI JOIN split USING (lx, ix, iy)),
        coded AS (
            SELECT leaf.*, list_sum(list_transform(range(9), lambda k: (((cx >> k) & 1) << (2 * k)) | (((cy >> k) & 1) << (2 * k + 1)))) AS code FROM leaf),
        held AS (SELECT coded.*, n, total, low, high FROM coded LEFT JOIN cell USING (lx, ix, iy)),
        up AS (
            SELECT h.lx, h.ix, h.iy, arg_max(c.total / c.n, c.lx) AS mean, max(c.lx) AS from_level FROM held AS h JOIN cell AS c
            ON c.lx < h.lx AND c.ix = h.ix >> (h.lx - c.lx) AND c.iy = h.iy >> (h.lx - c.lx) WHERE h.n IS NULL GROUP BY h.lx, h.ix, h.iy)
        SELECT row_number() OVER (ORDER BY code) - 1 AS leaf, lx::INT AS lx, ix, iy, ix * 1024e0 / 2 ** lx AS xmin, (ix + 1) * 1024e0 / 2 ** lx AS xmax, iy * 1024e0 / 2 ** lx AS ymin, (iy + 1) * 1024e0 / 2 ** lx AS ymax,
            coalesce(n, 0) AS soundings, round(low, 5) + 0e0 AS low, round(high, 5) + 0e0 AS high, round(coalesce(total / n, mean), 5) + 0e0 AS depth,
            (CASE WHEN n IS NULL THEN from_level ELSE lx END)::INT AS from_level, ((cy >> 7) * 4 + (cx >> 7))::INT AS tile
        FROM held LEFT JOIN up USING (lx, ix, iy)
    """,
    "job2_field_notes": r"""
        WITH d AS (
            SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '\n')) + 1, 0)::BIGINT AS lines, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words,
                coalesce(list_transform(regexp_extract_all(text, '[0-9]{1,9}(?:\.[0-9]{1,3})?'), lambda s: (s::DECIMAL(12, 3) * 1000)::BIGINT), []) AS r FROM documents),
        n AS (
            SELECT *, len(r)::BIGINT AS readings, coalesce(list_sum(r), 0)::BIGINT AS total, list_min(r) AS low, list_max(r) AS high, r[1] AS first, r[-1] AS last FROM d)
        SELECT 'note' AS kind, source, doc_id, lang, 1::BIGINT AS documents, lines, words, readings, total, low, high, first, last FROM n
        UNION ALL SELECT 'source', source, NULL, NULL, count(*), sum(lines)::BIGINT, sum(words)::BIGINT, sum(readings)::BIGINT, sum(total)::BIGINT, min(low), max(high),
            arg_min(first, doc_id) FILTER (readings > 0), arg_max(last, doc_id) FILTER (readings > 0) FROM n GROUP BY source
    """,
}
