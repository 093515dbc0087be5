"""All queries of the core library and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidalframe.plans import criteria, elements, extras, files, fits, meshes, scalars, systems

FLAGSHIP = "dorfler_mark"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _part in (scalars, meshes, fits, extras, criteria, files, elements, systems):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
