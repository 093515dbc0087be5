"""Writers of the reports and surfaces that other programs read."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.fit import STRIPS, numbered
from tidalframe.sinks.grids import put

#: Most points and rows that a single file's writer gathers.
MOST_POINTS, MOST_ROWS = 2_000_000, 10_000


def write_iterations(rows: DataFrame, path: str, by: str = "iter") -> None:
    """One folder of CSV files for each iteration, written by the executors."""
    rows.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_texts(rows: DataFrame, folder: str, name: str, value: str, suffix: str) -> int:
    """A text file for each row, named by a column, written by the executors; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for n, v in zip(part.column("name").to_pylist(), part.column("value").to_pylist(), strict=True):
                put(f"{folder}/{n}.{suffix}", (v or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["files"])

    found = rows.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value")).mapInArrow(run, "files long")
    return found.agg(F.sum("files")).first()[0] or 0


def quad_grid(points: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(vertex, x, y, z) and (elem, corners) of cells given by corner points (elem, corner, x, y, z).

    Corners within the tolerance are one vertex, numbered by position.
    """
    spot = points.withColumns({"qx": F.round(F.col("x") / tolerance).cast("long"), "qy": F.round(F.col("y") / tolerance).cast("long")})
    vertices = spot.groupBy("qx", "qy").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.avg("z").alias("z"))
    ends = spot.agg(F.min("qy").alias("y0__"), F.max("qy").alias("y1__"))
    strip = F.floor((F.col("qy") - F.col("y0__")) * STRIPS / (F.col("y1__") - F.col("y0__") + 1))
    vertices = numbered(vertices.crossJoin(F.broadcast(ends)), ["qy", "qx"], strip, "vertex")  # one row of ends
    cells = spot.join(vertices.select("qx", "qy", "vertex"), ["qx", "qy"]).groupBy("elem").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "vertex"))), lambda s: s["vertex"]).alias("corners"))
    return vertices.select("vertex", "x", "y", "z"), cells


def write_vtu(vertices: DataFrame, cells: DataFrame, path: str, encoding: str = "ascii") -> None:
    """An unstructured grid of quads with depth as point data; ``encoding`` ascii or base64."""
    n = vertices.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} vertices; one file holds at most {MOST_POINTS}")
    v = vertices.orderBy("vertex").toPandas()
    c = cells.orderBy("elem").toPandas()
    points = np.column_stack([v["x"], v["y"], -v["z"]]).astype("<f8")
    corners = np.array(c["corners"].tolist(), dtype="<i8").reshape(len(c), -1)

    def array(name: str, kind: str, data: np.ndarray, parts: int = 1) -> str:
        if encoding == "base64":
            raw = data.tobytes()
            body = base64.b64encode(struct.pack("<Q", len(raw)) + raw).decode()
            form = "binary"
        else:
            body, form = " ".join(repr(x) for x in data.ravel().tolist()), "ascii"
        return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{parts}" format="{form}">{body}</DataArray>'

    offsets = np.arange(1, len(c) + 1, dtype="<i8") * corners.shape[1]
    text = (
        '<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64"><UnstructuredGrid>'
        f'<Piece NumberOfPoints="{len(v)}" NumberOfCells="{len(c)}"><Points>{array("points", "Float64", points, 3)}</Points>'
        f'<Cells>{array("connectivity", "Int64", corners)}{array("offsets", "Int64", offsets)}{array("types", "UInt8", np.full(len(c), 9, dtype="u1"))}</Cells>'
        f'<PointData Scalars="depth">{array("depth", "Float64", np.asarray(v["z"], dtype="<f8"))}</PointData></Piece></UnstructuredGrid></VTKFile>\n'
    )
    Path(path).write_text(text, encoding="utf-8")


def write_series(files: Sequence[tuple[float, str]], path: str) -> None:
    """An index of grids by time."""
    rows = "".join(f'<DataSet timestep="{t!r}" file="{name}"/>' for t, name in files)
    Path(path).write_text(f'<?xml version="1.0"?>\n<VTKFile type="Collection" version="1.0"><Collection>{rows}</Collection></VTKFile>\n', encoding="utf-8")


# Names, units and standard names of the ocean variables.
OCEAN = {
    "eta": ("m", "sea_surface_height_above_geoid"), "u": ("m s-1", "eastward_sea_water_velocity"), "v": ("m s-1", "northward_sea_water_velocity"),
    "w": ("m s-1", "upward_sea_water_velocity"), "temperature": ("degree_C", "sea_water_temperature"), "salinity": ("1e-3", "sea_water_practical_salinity"),
}


def write_time_series(rows: DataFrame, path: str, time: str = "time_idx") -> None:
    """Fields by time step, a folder for each, with units and names in the columns' metadata."""
    for name, (unit, standard) in OCEAN.items():
        if name in rows.columns:
            rows = rows.withMetadata(name, {"units": unit, "standard_name": standard})
    rows.write.mode("append").partitionBy(time).parquet(path)


def markdown_table(rows: DataFrame, order: str) -> str:
    """A small table as Markdown; refused beyond ``MOST_ROWS`` rows."""
    found = rows.orderBy(order).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"a report shows at most {MOST_ROWS} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in r) + " |" for r in found)])


def write_report(path: str, title: str, sections: Sequence[tuple[str, DataFrame, str]]) -> None:
    """A Markdown report of small tables: (heading, table, order)."""
    parts = [f"# {title}", *[f"## {heading}\n\n{markdown_table(rows, order)}" for heading, rows, order in sections]]
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")


def write_metadata(path: str, attributes: dict) -> None:
    Path(path).write_text(json.dumps(attributes, indent=2, sort_keys=True), encoding="utf-8")
