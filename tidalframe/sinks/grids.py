"""Unstructured grids and chunked arrays, written by the executors: a file a part, an index beside them.

Rows are dealt to parts by a key; a task writes its part's file into the folder that all share, under a name of its own
attempt, and moves it into place, so a repeated task replaces its file and the index never names half of one.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cell kinds of the format: quads, hexahedra, and hexahedra of any order with Lagrange nodes.
QUAD, HEXAHEDRON, LAGRANGE = 9, 12, 72
#: Values, some 100 bytes each as text, that a part holds about; a task makes one part at a time.
PART_VALUES = 1 << 20


def put(path: str, data: bytes) -> None:
    """Write a file, or replace it, as a whole; the path may be a URI."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, name)


class Arrays:
    """Data arrays of one grid file: as text, as base64 in place, or as raw bytes at the end."""

    def __init__(self, encoding: str):
        if encoding not in ("ascii", "base64", "binary"):
            raise ValueError(f"unknown encoding {encoding!r}")
        self.encoding, self.raw = encoding, []
        self.size = 0

    def add(self, name: str, data: np.ndarray, parts: int = 1) -> str:
        kind = {"f8": "Float64", "i8": "Int64", "u1": "UInt8"}[data.dtype.str[1:]]
        head = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{parts}" format='
        if self.encoding == "ascii":
            return f'{head}"ascii">{" ".join(repr(x) for x in data.ravel().tolist())}</DataArray>'
        body = data.tobytes()
        block = struct.pack("<Q", len(body)) + body
        if self.encoding == "base64":
            return f'{head}"binary">{base64.b64encode(block).decode()}</DataArray>'
        self.raw.append(block)
        self.size += len(block)
        return f'{head}"appended" offset="{self.size - len(block)}"/>'

    def tail(self) -> bytes:
        return b'<AppendedData encoding="raw">_' + b"".join(self.raw) + b"</AppendedData>" if self.encoding == "binary" else b""


def piece(points: np.ndarray, cells: np.ndarray, kind: int, point_data: dict[str, np.ndarray], cell_data: dict[str, np.ndarray], encoding: str = "ascii") -> bytes:
    """One grid file. Data of several components have one column each."""
    arrays = Arrays(encoding)

    def fields(data: dict[str, np.ndarray]) -> str:
        return "".join(arrays.add(n, np.ascontiguousarray(v, dtype="<f8"), v.shape[1] if v.ndim > 1 else 1) for n, v in data.items())

    body = (
        f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}"><Points>{arrays.add("points", np.ascontiguousarray(points, dtype="<f8"), 3)}</Points>'
        f'<Cells>{arrays.add("connectivity", np.ascontiguousarray(cells, dtype="<i8"))}{arrays.add("offsets", np.arange(1, len(cells) + 1, dtype="<i8") * cells.shape[1])}{arrays.add("types", np.full(len(cells), kind, dtype="u1"))}</Cells>'
        f"<PointData>{fields(point_data)}</PointData><CellData>{fields(cell_data)}</CellData></Piece></UnstructuredGrid>"
    )
    head = '<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64"><UnstructuredGrid>'
    return (head + body).encode() + arrays.tail() + b"</VTKFile>\n"


def lagrange_order(order: int) -> np.ndarray:
    """Places of a hexahedron's (order + 1)**3 nodes, i fastest, in the format's order: corners, edges, faces, inside."""
    p = order
    corners = [(0, 0), (p, 0), (p, p), (0, p)]
    inner = range(1, p)
    out = [(i, j, k) for k in (0, p) for i, j in corners]
    for k in (0, p):
        out += [(i, 0, k) for i in inner] + [(p, j, k) for j in inner] + [(i, p, k) for i in inner] + [(0, j, k) for j in inner]
    out += [(i, j, k) for i, j in ((0, 0), (p, 0), (0, p), (p, p)) for k in inner]
    out += [(i, j, k) for i in (0, p) for k in inner for j in inner] + [(i, j, k) for j in (0, p) for k in inner for i in inner] + [(i, j, k) for k in (0, p) for j in inner for i in inner]
    out += [(i, j, k) for k in inner for j in inner for i in inner]
    n = p + 1
    return np.array([i + n * (j + n * k) for i, j, k in out], dtype=np.int64) if p else np.zeros(1, dtype=np.int64)


def write_pieces(elements: DataFrame, folder: str, name: str, kind: int, point_data: Sequence[str] = (), vectors: Sequence[tuple[str, Sequence[str]]] = (), cell_data: Sequence[str] = (), parts: int = 8, encoding: str = "base64", order: int = 1, most: int = PART_VALUES) -> list[str]:
    """Write a grid file a part and an index of them; the files' names. There are ``parts`` parts, or as many as keep them at about ``most`` values.

    ``elements``: elem, the node arrays x, y, z and those named in ``point_data``, and the numbers in ``cell_data``. ``vectors`` joins
    point data to vectors of three. With kind ``LAGRANGE`` nodes are put in the format's order. No row reaches the driver but the
    files' names.
    """
    names = [n for n in point_data if n not in {c for _, v in vectors for c in v}]
    take = lagrange_order(order) if kind == LAGRANGE else None

    def write(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        table = table.sort_by("elem").combine_chunks()
        width = len(table.column("x")[0])

        def nodes(c: str) -> np.ndarray:
            flat = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return (flat if take is None else flat[:, take]).ravel()

        points = np.stack([nodes(c) for c in "xyz"], axis=1)
        data = {n: nodes(n) for n in names} | {v: np.stack([nodes(c) for c in of], axis=1) for v, of in vectors}
        cells = np.arange(len(points), dtype=np.int64).reshape(-1, width)
        file = f"{name}_{part:05d}.vtu"
        put(f"{folder}/{file}", piece(points, cells, kind, data, {c: table.column(c).to_numpy().astype(float) for c in cell_data}, encoding))
        return pa.table({"file": [file], "cells": [len(cells)]})

    used = list(dict.fromkeys(["x", "y", "z", *names, *(c for _, v in vectors for c in v)]))
    total = elements.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0
    parts = max(parts, -(-total * (len(used) + 1) // most))  # nodes have numbers too
    rows = elements.select("elem", *[F.col(c).cast("array<double>").alias(c) for c in used], *cell_data, F.pmod(F.xxhash64("elem"), F.lit(parts)).cast("int").alias("part__"))
    files = sorted(r.file for r in rows.groupBy("part__").applyInArrow(write, "file string, cells long").collect())  # a row a part
    fields = lambda few: "".join(f'<PDataArray type="Float64" Name="{n}" NumberOfComponents="{k}"/>' for n, k in few)
    index = (
        '<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64"><PUnstructuredGrid GhostLevel="0">'
        f'<PPoints><PDataArray type="Float64" Name="points" NumberOfComponents="3"/></PPoints><PPointData>{fields([(n, 1) for n in names] + [(v, 3) for v, _ in vectors])}</PPointData>'
        f'<PCellData>{fields((c, 1) for c in cell_data)}</PCellData>{"".join(f"<Piece Source={chr(34)}{f}{chr(34)}/>" for f in files)}</PUnstructuredGrid></VTKFile>\n'
    )
    put(f"{folder}/{name}.pvtu", index.encode())
    return files


def write_ocean(elements: DataFrame, folder: str, name: str, order: int, parts: int = 8) -> list[str]:
    """Ocean fields (eta, u, v, w, temperature, salinity as node arrays) as hexahedra of any order, velocity as a vector."""
    return write_pieces(elements, folder, name, LAGRANGE, ("eta", "temperature", "salinity"), (("velocity", ("u", "v", "w")),), (), parts, "binary", order)


def xdmf(name: str, cells: int, points: int, times: Sequence[float], attributes: dict[str, tuple[int, str]]) -> str:
    """The index of a time series whose bodies lie in ``name``.h5: attributes are (components, Node or Cell)."""
    kind = {1: "Scalar", 3: "Vector"}
    item = lambda dims, at: f'<DataItem Dimensions="{dims}" Format="HDF">{name}.h5:/{at}</DataItem>'
    grids = []
    for k, t in enumerate(times):
        fields = "".join(f'<Attribute Name="{n}" AttributeType="{kind.get(c, "Tensor")}" Center="{center}">{item(f"{points} {c}" if c > 1 else points, f"{n}/{k}")}</Attribute>' for n, (c, center) in attributes.items())
        topology = f'<Topology TopologyType="Hexahedron" NumberOfElements="{cells}">{item(f"{cells} 8", "mesh/connectivity")}</Topology><Geometry GeometryType="XYZ">{item(f"{points} 3", "mesh/coordinates")}</Geometry>'
        grids.append(f'<Grid Name="mesh" GridType="Uniform"><Time Value="{t!r}"/>{topology}{fields}</Grid>')
    return f'<?xml version="1.0"?>\n<Xdmf Version="3.0"><Domain><Grid Name="TimeSeries" GridType="Collection" CollectionType="Temporal">{"".join(grids)}</Grid></Domain></Xdmf>\n'


def write_array(rows: DataFrame, folder: str, shape: Sequence[int], chunks: Sequence[int], index: Sequence[str], value: str, attributes: dict | None = None, codec: str = "gzip", fill: float = float("nan")) -> int:
    """Write ``rows`` (index columns, value) as a chunked array of version 3: a file a chunk, ``zarr.json`` beside them.

    Chunks without a row are left out and read as ``fill``. Returns the number of chunks written.
    """
    import gzip

    if codec not in ("none", "gzip", "zstd"):
        raise ValueError(f"unknown codec {codec!r}")
    shape, chunks = list(shape), list(chunks)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        block = np.full(chunks, fill, dtype="<f8")
        block[tuple(table.column(c).to_numpy() - a * n for c, a, n in zip(index, at, chunks, strict=True))] = table.column(value).to_numpy()
        raw = block.tobytes()
        if codec == "gzip":
            raw = gzip.compress(raw, 5, mtime=0)
        elif codec == "zstd":
            import zstandard

            raw = zstandard.ZstdCompressor(level=3).compress(raw)
        put("/".join([folder, "c", *map(str, at)]), raw)
        return pa.table({"cells": [table.num_rows]})

    places: list[Column] = [F.floor(F.col(c) / n).cast("long").alias(f"c{k}__") for k, (c, n) in enumerate(zip(index, chunks, strict=True))]
    inside = [F.col(c).between(0, n - 1) for c, n in zip(index, shape, strict=True)]
    good = inside[0]
    for test in inside[1:]:
        good &= test
    if not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError("an index lies outside the array")
    written = rows.select(*[F.col(c).cast("long").alias(c) for c in index], F.col(value).cast("double").alias(value), *places).groupBy(*[f"c{k}__" for k in range(len(index))]).applyInArrow(write, "cells long").count()
    compress = {"none": [], "gzip": [{"name": "gzip", "configuration": {"level": 5}}], "zstd": [{"name": "zstd", "configuration": {"level": 3, "checksum": False}}]}[codec]
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN" if np.isnan(fill) else fill,
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, *compress], "attributes": attributes or {}, "dimension_names": list(index),
    }
    put(f"{folder}/zarr.json", json.dumps(meta, indent=2).encode())
    return written


def write_group(folder: str, attributes: dict) -> None:
    """The root of a store, with its attributes."""
    put(f"{folder}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}, indent=2).encode())


def read_chunks(spark: SparkSession, folder: str, meta: dict | None = None) -> DataFrame:
    """(the dimensions' names, value) of every element of an array that isn't missing, decoded by the executors."""
    import gzip

    meta = meta or json.loads(spark.read.text(f"{folder}/zarr.json", wholetext=True).first()[0])
    chunks, shape, names = meta["chunk_grid"]["configuration"]["chunk_shape"], meta["shape"], meta["dimension_names"]
    codecs = {c["name"] for c in meta["codecs"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, raw in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                if "gzip" in codecs:
                    raw = gzip.decompress(raw)
                elif "zstd" in codecs:
                    import zstandard

                    raw = zstandard.ZstdDecompressor().decompress(raw)
                values = np.frombuffer(raw, "<f8")
                at = [int(x) for x in path.split("/")[-len(chunks) :]]
                places = [a * n + k for a, n, k in zip(at, chunks, np.unravel_index(np.arange(values.size), chunks), strict=True)]
                keep = ~np.isnan(values)
                for place, n in zip(places, shape, strict=True):
                    keep &= place < n
                yield pa.RecordBatch.from_arrays([*[pa.array(p[keep]) for p in places], pa.array(values[keep])], names=[*names, "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/c")
    return files.select("path", "content").mapInArrow(run, ", ".join([*(f"{n} long" for n in names), "value double"]))


def read_array(folder: str) -> np.ndarray:
    """A whole array of bounded size, as tests read it back."""
    import gzip
    from itertools import product
    from pathlib import Path

    meta = json.loads(Path(folder, "zarr.json").read_text())
    chunks, names = meta["chunk_grid"]["configuration"]["chunk_shape"], [c["name"] for c in meta["codecs"]]
    out = np.full(meta["shape"], np.nan if meta["fill_value"] == "NaN" else meta["fill_value"])
    for at in product(*(range(-(-n // c)) for n, c in zip(meta["shape"], chunks, strict=True))):
        file = Path(folder, "c", *map(str, at))
        if file.exists():
            raw = file.read_bytes()
            if "gzip" in names:
                raw = gzip.decompress(raw)
            elif "zstd" in names:
                import zstandard

                raw = zstandard.ZstdDecompressor().decompress(raw)
            block = np.frombuffer(raw, "<f8").reshape(chunks)
            place = tuple(slice(a * c, min(n, (a + 1) * c)) for a, c, n in zip(at, chunks, meta["shape"], strict=True))
            out[place] = block[tuple(slice(0, s.stop - s.start) for s in place)]
    return out
