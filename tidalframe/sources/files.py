"""Configuration, metric tables by file name, polygons and grids from text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Domain:
    center_x: float = 0.0
    center_y: float = 0.0
    size: float = 1000.0
    nx: int = 8
    ny: int = 8


@dataclass
class Config:
    """Settings of an adaptive fit; ``data_dir`` and ``primary_file`` must be given."""

    data_dir: str
    primary_file: str
    tile_files: list[str] = field(default_factory=list)
    domain: Domain = field(default_factory=Domain)
    error_threshold: float = 0.1
    max_iterations: int = 20
    max_elements: int = 10_000
    max_level: int = 10
    dorfler_theta: float = 0.5
    smoothing: float = 1.0

    @property
    def min_tree_level(self) -> int:
        return int(log2(max(self.domain.nx, self.domain.ny)))


def read_config(path: str) -> Config:
    """The configuration in a file."""
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def parse_config(text: str) -> Config:
    """Missing settings take their defaults; missing required ones, and unknown ones, raise."""
    given = json.loads(text)
    data = given.pop("data", {})
    for name in ("data_dir", "primary_file"):
        if not data.get(name):
            raise ValueError(f"data.{name} is required")
    domain = Domain(**given.pop("domain", {}))
    unknown = set(given) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**data, domain=domain, **given)


def write_config(config: Config, path: str) -> None:
    out = asdict(config)
    data = {k: out.pop(k) for k in ("data_dir", "primary_file", "tile_files")}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"data": data, **out}, f, indent=2)


def choice(name: str, allowed: tuple[str, ...]) -> str:
    """``name`` if it is one of the allowed values, whatever its case; else an error."""
    for a in allowed:
        if a.lower() == name.lower():
            return a
    raise ValueError(f"unknown value {name!r}; expected one of {', '.join(allowed)}")


def choice_column(name: Column, allowed: tuple[str, ...]) -> Column:
    """``choice`` for a column; a row with another value, or null, raises."""
    out = F.raise_error(F.concat(F.lit("unknown value "), F.coalesce(name, F.lit("null")), F.lit(f"; expected one of {', '.join(allowed)}")))
    for a in reversed(allowed):
        out = F.when(F.lower(name) == a.lower(), F.lit(a)).otherwise(out)
    return out


def read_metric_files(spark: SparkSession, glob: str, key_pattern: str, schema: str) -> DataFrame:
    """CSV tables whose key is part of the name or folder of their files, as one table with a ``key`` column."""
    rows = spark.read.csv(glob, header=True, schema=schema)
    return rows.withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_wkt(text: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a POLYGON or MULTIPOLYGON text, each a list of closed rings.

    Rings with fewer than four points are dropped, as are other kinds of geometry.
    """
    kind = re.match(r"\s*(MULTIPOLYGON|POLYGON)\b", text, re.I)
    if not kind:
        return []
    body = text[kind.end() :]
    polygons = re.findall(r"\(\s*(\((?:[^()]*)\)(?:\s*,\s*\([^()]*\))*)\s*\)", body)
    out = []
    for polygon in polygons:
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", polygon):
            points = [(float(a), float(b)) for a, b in re.findall(rf"({_NUMBER})\s+({_NUMBER})", ring)]
            if points and points[0] != points[-1]:
                points.append(points[0])
            if len(points) >= 4:
                rings.append(points)
        if rings:
            out.append(rings)
    return out


def ring_literal(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed, counter-clockwise ring from three points or more."""
    if len(points) < 3:
        raise ValueError("a region needs three points or more")
    ring = list(points) + ([points[0]] if tuple(points[0]) != tuple(points[-1]) else [])
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:], strict=True))
    return ring if area > 0 else ring[::-1]


def pixels_from_grid(values: DataFrame, size_x: int) -> DataFrame:
    """(px, py, val) of rows (pos, val) of a raster stored row by row."""
    return values.select((F.col("pos") % size_x).alias("px"), F.floor(F.col("pos") / size_x).cast("long").alias("py"), F.col("val").cast("float").alias("val"))


def depth_positive(band_name: str, direction: str, low: float, high: float) -> bool:
    """Whether a raster holds depths: by its band's name or direction, or as nothing is negative."""
    return band_name.lower() in ("dybde", "depth") or direction == "Height" or (low >= 0 and high > 0)


def levels_needed(length: float, dx: float) -> int:
    """Halvings until a length is cut to ``dx``."""
    from math import ceil

    return max(0, ceil(log2(length / dx)))


def levels_column(length: Column, dx: Column) -> Column:
    """``levels_needed`` for columns."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length / dx)).cast("int"))


def scattered(rows: DataFrame) -> DataFrame:
    """(x, y, z, w) of scattered points in double precision; a weight that is missing is 1, points without a coordinate go."""
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in rows.columns else F.lit(1.0)
    return rows.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")], w.alias("w")).dropna(subset=["x", "y", "z"])


def parse_geojson(text: str, transform: Callable[[float, float], tuple[float, float]] | None = None) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a GeoJSON text, as ``parse_wkt`` gives them; ``transform`` maps points, and rings it fails on are dropped.

    Polygons and multipolygons count, on their own, in collections and as features; points and lines don't.
    """

    def found(node) -> Iterator[list]:
        kind = node.get("type") if isinstance(node, dict) else None
        if kind == "Polygon":
            yield node.get("coordinates") or []
        elif kind == "MultiPolygon":
            yield from node.get("coordinates") or []
        elif kind == "Feature":
            yield from found(node.get("geometry"))
        elif kind in ("FeatureCollection", "GeometryCollection"):
            for x in node.get("features" if kind == "FeatureCollection" else "geometries") or []:
                yield from found(x)

    out = []
    for polygon in found(json.loads(text)):
        rings = []
        for ring in polygon:
            points = [(float(p[0]), float(p[1])) for p in ring]
            if points and points[0] != points[-1]:
                points.append(points[0])
            if len(points) < 4:
                continue
            try:
                rings.append(points if transform is None else [transform(*p) for p in points])
            except (ArithmeticError, ValueError):
                continue
        if rings:
            out.append(rings)
    return out


def read_polygons(spark: SparkSession, path: str, transform: Callable[[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """(file, polygon, ring, points) of the GeoJSON and WKT files under a path or glob, parsed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                text = content.decode("utf-8-sig")
                polygons = parse_geojson(text, transform) if text.lstrip()[:1] in ("{", "[") else parse_wkt(text)
                rows = [(file, k, r, [{"x": x, "y": y} for x, y in ring]) for k, rings in enumerate(polygons) for r, ring in enumerate(rings)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["file", "polygon", "ring", "points"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, polygon int, ring int, points array<struct<x: double, y: double>>")
