"""Operators against known values, invariants and small recomputations."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.functions import basis, raster, seawater
from tidalframe.functions.dual import COLUMN
from tidalframe.operators import column, fit, mesh, spatial, stepping
from tidalframe.plans import registry
from tidalframe.sinks import writers
from tidalframe.sources import files
from tidalframe.streaming import triggers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_published_density_values(spark):
    # check values of the 1980 equation of state
    rows = spark.createDataFrame([(5.0, 0.0, 0.0, 999.96675), (5.0, 35.0, 0.0, 1027.67547), (25.0, 35.0, 10000.0, 1062.53817)], "t double, s double, p double, rho double")
    for r in rows.select("rho", seawater.unesco(COLUMN, F.col("t"), F.col("s"), F.col("p")).alias("got")).collect():
        assert r.got == pytest.approx(r.rho, abs=1e-4)


def test_projection_origin(spark):
    lon, lat = raster.conic_to_lonlat(COLUMN, F.lit(4_000_000.0), F.lit(2_800_000.0))
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert (r.lon, r.lat) == pytest.approx((10.0, 52.0), abs=1e-9)


@pytest.mark.parametrize("degree", [1, 3, 5])
def test_bases(degree):
    x = np.linspace(0, 1, 7)
    table = basis.bernstein_table(degree, x)
    assert np.allclose(table.sum(axis=1), 1)
    slope = basis.bernstein_slopes(degree, x)
    assert np.allclose(slope, (basis.bernstein_table(degree, x + 1e-6) - basis.bernstein_table(degree, x - 1e-6)) / 2e-6, atol=1e-6)
    whole = basis.bernstein_table(degree, x / 2)
    assert np.allclose(table @ basis.extraction(degree, 0), whole)
    assert np.allclose(table @ basis.extraction(degree, 1), basis.bernstein_table(degree, 0.5 + x / 2))


def test_rules_integrate_polynomials():
    for n in range(1, 7):
        x, w = basis.gauss(n)
        assert np.isclose((w * x ** (2 * n - 1)).sum(), 1 / (2 * n))
    x, w = basis.lobatto(4)
    assert np.isclose((w * x**4).sum(), 2 / 5)
    assert np.allclose(basis.derivative_matrix(x) @ x**3, 3 * x**2)
    with pytest.raises(ValueError):
        basis.gauss(7)


def test_balanced_mesh(spark, sf_dir):
    cells = mesh.balance(mesh.grow(mesh.uniform(spark, 1, 1), (F.col("xmin") <= 1.0) & (F.col("ymin") <= 1.0), 5, (0.0, 64.0, 0.0, 64.0)), 5)
    assert cells.select(F.sum(F.pow(F.lit(0.25), F.col("lx")))).first()[0] == pytest.approx(1.0)
    leaves = mesh.numbered(cells, 5)
    near = mesh.adjacency(leaves, 5).where("neighbour IS NOT NULL")
    level = leaves.select("leaf", "lx")
    gap = near.join(level, "leaf").join(level.select(F.col("leaf").alias("neighbour"), F.col("lx").alias("nlx")), "neighbour").agg(F.max(F.abs(F.col("lx") - F.col("nlx")))).first()[0]
    assert gap == 1


def test_empty_inputs(spark):
    cells = mesh.numbered(mesh.uniform(spark, 1, 1).where("ix < 0"), 1)
    assert mesh.adjacency(cells, 1).count() == 0
    points = spark.createDataFrame([], "id long, x double, y double")
    sites = spark.createDataFrame([], "id long, x double, y double, z double")
    assert spatial.nearest(points, sites, ("id",)).count() == 0
    assert fit.dorfler(spark.createDataFrame([], "e long, m double"), "e", "m", 0.5).count() == 0


@pytest.mark.parametrize(("fan", "sent"), [(2, 0), (4, 1 << 16), (16, 1 << 16)])
def test_nearest_is_brute_force_near_and_far(spark, monkeypatch, fan, sent):
    monkeypatch.setattr(spatial, "FAN", fan)
    monkeypatch.setattr(spatial, "MOST_SENT", sent)
    rng = random.Random(fan)
    # a crowd on one spot, a tight cluster, a grid with ties, and sites without a place
    sites = [(k, 5.0, 5.0, 0.5) for k in range(30)] + [(100 + k, 1 + rng.random() * 1e-6, 1 + rng.random() * 1e-6, 1.0) for k in range(60)]
    sites += [(200 + 7 * i + j, 100.0 + i, 50.0 + j, 2.0) for i in range(7) for j in range(7)]
    lost = [(900, None, 1.0, 0.0), (901, float("nan"), 1.0, 0.0), (902, float("inf"), 1.0, 0.0)]
    points = [(k, rng.choice([0, 1, 100, -1e7, 1e9]) + rng.random(), rng.choice([0, 50, 1e8]) + rng.random()) for k in range(120)]
    points += [(200 + k, 100.5 + k % 6, 50.5 + k // 6) for k in range(36)] + [(300, 5.0, 5.0), (301, None, 0.0), (302, float("nan"), 0.0), (303, 0.0, float("-inf"))]
    got = {r.id: (r.d2, r.site) for r in spatial.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(sites + lost, "id long, x double, y double, z double"), ("id",)).collect()}
    want = {i: min(((x - sx) * (x - sx) + (y - sy) * (y - sy), s) for s, sx, sy, _ in sites) for i, x, y in points if i <= 300}
    assert got == want


def test_nearest_to_one_or_no_site(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id long, x double, y double")
    schema = "id long, x double, y double, z double"
    assert {(r.id, r.site) for r in spatial.nearest(points, spark.createDataFrame([(7, 3.0, 4.0, None)], schema), ("id",)).collect()} == {(1, 7), (2, 7)}
    assert spatial.nearest(points, spark.createDataFrame([], schema), ("id",)).count() == 0


def test_dorfler_takes_ties_and_at_least_one(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0), (4, 1.0)], "e long, m double")
    assert {r.e for r in fit.dorfler(rows, "e", "m", 0.1).collect()} == {1, 2, 3}
    zero = spark.createDataFrame([(1, 0.0)], "e long, m double")
    assert fit.dorfler(zero, "e", "m", 0.5).count() == 1


def test_joins_are_equi_joins(spark, sf_dir):
    for name in ("locate_points", "edge_adjacency", "segment_boxes", "tile_priority", "condense"):
        text = plan(registry.QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(registry.QUERIES["element_l2"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_direct_solution_solves_the_condensed_system(spark, sf_dir):
    from tidalframe.plans.fits import _constraints, _system

    matrix, load = _system(spark, sf_dir)
    con = _constraints(spark)
    ids, a, b = fit.gather_system(fit.condense(matrix, con), fit.condense_load(load, con))
    x = {r.i: r.v for r in registry.QUERIES["direct_solve"](spark, sf_dir).collect()}
    assert np.allclose(a @ np.array([x[i] for i in ids]), b, atol=1e-3 * np.abs(b).max())
    y, history = fit.conjugate_gradients(lambda p: a @ p, b, tolerance=1e-12)
    assert np.allclose(y, np.linalg.solve(a, b), atol=1e-5) and history[-1] < history[0]
    for r in con.groupBy("slave").agg(F.collect_list("master").alias("m")).collect():
        if all(m in x for m in r.m):  # no sample touches the others
            assert x[r.slave] == pytest.approx(sum(x[m] for m in r.m) / 2, abs=1e-5)


def test_constrained_block_and_multigrid_solvers():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(12, 12))
    q, b = m @ m.T + 12 * np.eye(12), rng.normal(size=12)
    a = rng.normal(size=(3, 12))
    x, _ = fit.schur_solve(q, a, b)
    kkt = np.linalg.solve(np.block([[q, a.T], [a, np.zeros((3, 3))]]), np.concatenate([b, np.zeros(3)]))[:12]
    assert np.allclose(x, kkt)
    blocks = [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9], [9, 10, 11]]
    assert [sorted(g) for g in fit.colours(blocks)] == [[0, 2], [1, 3]]
    for kind, omega in (("multiplicative", 1.0), ("coloured", 1.0), ("additive", 0.4)):
        assert np.linalg.norm(b - q @ fit.schwarz(q, b, blocks, kind, omega, 40)) < 1e-3 * np.linalg.norm(b)
    n = 15
    fine = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    up = np.zeros((n, 7))
    for k in range(7):
        up[2 * k : 2 * k + 3, k] = (0.5, 1.0, 0.5)
    levels = fit.galerkin(fine, [up])
    f = rng.normal(size=n)
    y = np.zeros(n)
    for _ in range(12):
        y += fit.v_cycle(levels, [up], f - fine @ y)
    assert np.allclose(fine @ y, f, atol=1e-6)
    solved, _ = fit.conjugate_gradients(lambda p: fine @ p, f, lambda r: fit.v_cycle(levels, [up], r), flexible=True)
    assert np.allclose(fine @ solved, f, atol=1e-6)


def test_thin_plate_energy():
    block = fit.thin_plate_block(3, 2.0, 0.5)
    x = np.array([i / 3 for j in range(4) for i in range(4)])
    assert np.allclose(block @ np.ones(16), 0) and np.allclose(block @ x, 0)
    assert np.linalg.eigvalsh(block).min() > -1e-9


def test_steppers_have_their_order():
    exact = np.exp(-1.0)
    for kind, order in (("euler", 1), ("rk2", 2), ("ssprk3", 3), ("rk4", 4), ("lsrk45", 4), ("dopri5", 5)):
        errors = []
        for n in (8, 16):
            y = np.array([1.0])
            for i in range(n):
                y = stepping.step(kind, lambda t, v: -v, i / n, y, 1 / n)
            errors.append(abs(y[0] - exact))
        assert np.log2(errors[0] / errors[1]) == pytest.approx(order, abs=0.35), kind


def test_refined_field_is_exact_on_cubics(spark):
    x = basis.lobatto(4)[0]
    rows = [(0, i, j, k, float(x[k] ** 3 - x[i])) for i in range(4) for j in range(4) for k in range(4)]
    out = column.refine_field(spark.createDataFrame(rows, "elem long, i int, j int, k int, v double"), "k").collect()
    for r in out:
        z = (x[r.k] + (2 * r.half - 1)) / 2
        assert r.v == pytest.approx(z**3 - x[r.i])


def test_mode_split_keeps_deviations(spark, sf_dir):
    w = (1 / 6, 5 / 6, 5 / 6, 1 / 6)
    state = spark.createDataFrame([(0, 0, 0, k, float(k), 0.0) for k in range(4)], "elem long, i int, j int, k int, u double, eta double")
    out = sorted((r.k, r.u) for r in stepping.split_modes(state, w, 1.0, 4, 40.0).collect())
    assert np.allclose(np.diff([u for _, u in out]), 1.0)
    rest = state.withColumn("u", F.lit(0.0))
    assert all(r.u == 0 and r.eta == 0 for r in stepping.split_modes(rest, w, 1.0, 4, 40.0).collect())


def test_adaptive_history(spark, sf_dir):
    rows = registry.QUERIES["adaptive_history"](spark, sf_dir).orderBy("round").collect()
    assert [r.elements for r in rows] == sorted(r.elements for r in rows)
    assert rows[-1].reason and all(not r.reason for r in rows[:-1])


def test_interval_triggers_stream_as_in_batch(spark, tmp_path):
    rows = [(u, float(t)) for u in (1, 2) for t in range(0, 50, 3 + u)]
    spark.createDataFrame(rows, "key long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, t double").parquet(str(tmp_path / "in"))
    q = triggers.triggers(stream, 10.0).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM fired").collect())
    finally:
        q.stop()
    assert got == sorted(tuple(r) for r in triggers.triggers_batch(spark.createDataFrame(rows, "key long, t double"), 10.0).collect())


def test_config_and_geometry(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"data": {"data_dir": "/d", "primary_file": "p"}, "domain": {"nx": 16, "ny": 9}, "max_level": 7}))
    config = files.read_config(str(path))
    assert config.min_tree_level == 4 and config.max_level == 7 and config.dorfler_theta == 0.5
    files.write_config(config, str(tmp_path / "d.json"))
    assert files.read_config(str(tmp_path / "d.json")) == config
    for bad in ({"data": {"data_dir": "/d"}}, {"data": {"data_dir": "/d", "primary_file": "p"}, "oops": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.read_config(str(path))
    assert files.choice("direct", ("Direct", "Iterative")) == "Direct"
    with pytest.raises(ValueError):
        files.choice("x", ("Direct",))
    polygons = files.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6.5e0 6, 5 5), (1 1, 2 2)))")
    assert [len(p) for p in polygons] == [1, 1] and files.parse_wkt("LINESTRING (0 0, 1 1)") == []
    assert files.ring_literal([(0, 0), (0, 1), (1, 1)])[1] == (1, 1)
    assert files.levels_needed(1000, 10) == 7
    assert files.depth_positive("Dybde", "", -1, 1) and not files.depth_positive("b", "", -1, 1)


def test_writers(spark, tmp_path, sf_dir):
    corners = [(e, c, float(e + c % 2), float(c // 2), 1.0 + e) for e in range(2) for c in range(4)]
    vertices, cells = writers.quad_grid(spark.createDataFrame(corners, "elem long, corner int, x double, y double, z double"), 1e-6)
    assert vertices.count() == 6
    for encoding in ("ascii", "base64"):
        writers.write_vtu(vertices, cells, str(tmp_path / f"{encoding}.vtu"), encoding)
        import xml.etree.ElementTree as tree

        piece = tree.parse(tmp_path / f"{encoding}.vtu").getroot()[0][0]
        assert piece.attrib == {"NumberOfPoints": "6", "NumberOfCells": "2"}
    writers.write_series([(0.0, "a.vtu"), (1.0, "b.vtu")], str(tmp_path / "s.pvd"))
    rows = spark.createDataFrame([(1, 0.5, 0), (2, 0.25, 1)], "element_id long, l2_error double, iter int")
    writers.write_iterations(rows, str(tmp_path / "errors"))
    assert spark.read.csv(str(tmp_path / "errors"), header=True).count() == 2
    writers.write_csv(rows, str(tmp_path / "solver_metrics_direct.csv"))
    back = files.read_metric_files(spark, str(tmp_path / "solver_metrics_direct.csv"), r"part-(\d+)", "element_id long, l2_error double, iter int")
    assert back.count() == 2 and "key" in back.columns
    writers.write_report(str(tmp_path / "r.md"), "Report", [("Errors", rows, "element_id")])
    assert "| 1 | 0.5 | 0 |" in (tmp_path / "r.md").read_text()
    writers.write_time_series(rows.withColumn("eta", F.lit(0.1)), str(tmp_path / "series"), "iter")
    assert spark.read.parquet(str(tmp_path / "series")).schema["eta"].metadata["units"] == "m"


def test_tendencies_against_numpy(spark):
    from tidalframe.operators import tendencies

    rng = np.random.default_rng(8)
    q = {n: rng.normal(size=64) + (20 if n == "h" else 0) for n in tendencies.FIELDS}
    rows = spark.createDataFrame([(1, *[q[n].tolist() for n in tendencies.FIELDS])], "id long, " + ", ".join(f"{n} array<double>" for n in tendencies.FIELDS))
    got = tendencies.primitive(rows, "id", nu_h=0.3, nu_v=0.2, kappa=0.1).first()
    d = basis.derivative_matrix(basis.lobatto(4)[0])
    g = {n: x.reshape(4, 4, 4) for n, x in q.items()}  # k, j, i
    dx, dy, dz = (lambda a: np.einsum("rc,kjc->kjr", d, a)), (lambda a: np.einsum("rc,kci->kri", d, a)), (lambda a: np.einsum("rc,cji->rji", d, a))
    h, u, v, o = g["h"], g["u"], g["v"], g["omega"]
    advect = lambda a: dx(a * u) + dy(a * v) + dz(a * o)
    dhu = -advect(h * u) + g["f"] * h * v - 9.81 * h * dx(g["eta"]) + 0.3 * h * (dx(dx(u)) + dy(dy(u))) + 0.2 * dz(dz(u)) / h
    dhv = -advect(h * v) - g["f"] * h * u - 9.81 * h * dy(g["eta"]) + 0.3 * h * (dx(dx(v)) + dy(dy(v))) + 0.2 * dz(dz(v)) / h
    dht = -advect(h * g["t"]) + 0.1 * dz(dz(g["t"])) / h
    w = basis.lobatto(4)[1] / 2
    bar = lambda a: np.broadcast_to(np.einsum("k,kji->ji", w, a), (4, 4, 4))
    deta = -(dx(bar(h * u)) + dy(bar(h * v)))
    for name, want in (("dhu", dhu), ("dhv", dhv), ("dht", dht), ("deta", deta)):
        assert np.allclose(got[name], want.ravel()), name


def tiff(values: np.ndarray, order: str = "<", deflate: bool = False) -> bytes:
    """A small raster file of float strips of two rows."""
    import struct
    import zlib

    h, w = values.shape
    parts = [values[k : k + 2].astype(order + "f4").tobytes() for k in range(0, h, 2)]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    n = len(parts)
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, n, None), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, n, None), (339, 3, 1, 3), (33550, 12, 3, None), (33922, 12, 6, None), (42113, 2, 6, None)]
    extra = 8 + 2 + 12 * len(entries) + 4
    start = extra + 8 * n + 72 + 6
    ends = np.cumsum([len(p) for p in parts])
    offsets = [start + int(e) - len(p) for e, p in zip(ends, parts)]
    blobs = {273: struct.pack(f"{order}{n}I", *offsets), 279: struct.pack(f"{order}{n}I", *map(len, parts)), 33550: struct.pack(order + "3d", 2.0, 3.0, 0.0), 33922: struct.pack(order + "6d", 0, 0, 0, 100.0, 400.0, 0), 42113: b"-9999\0"}
    body, tail, at = b"", b"", extra
    for tag, kind, count, value in entries:
        if tag in blobs:
            if len(blobs[tag]) > 4:
                field = struct.pack(order + "I", at)
                tail, at = tail + blobs[tag], at + len(blobs[tag])
            else:
                field = blobs[tag].ljust(4, b"\0")
        else:
            field = struct.pack(order + ("I" if kind == 4 else "H2x"), value)
        body += struct.pack(order + "HHI", tag, kind, count) + field
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + body + b"\0" * 4 + tail
    return out.ljust(start, b"\0") + b"".join(parts)


def test_raster_files(spark, tmp_path):
    from tidalframe.sources import geotiff

    values = np.arange(15, dtype=float).reshape(5, 3)
    values[4, 2] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(values))
    (tmp_path / "b.tif").write_bytes(tiff(values - 20, ">", True))
    pixels = geotiff.read_pixels(spark, str(tmp_path / "*.tif"))
    got = {(r.raster[-5:], r.px, r.py): r.val for r in pixels.collect()}
    assert got == {("a.tif", x, y): values[y, x] for x in range(3) for y in range(5)} | {("b.tif", x, y): values[y, x] - 20 for x in range(3) for y in range(5)}
    heads = geotiff.read_headers(spark, str(tmp_path / "*.tif"))
    r = heads.orderBy("raster").first()
    assert (r.sx, r.sy, r.gt, r.nodata) == (3, 5, [100.0, 2.0, 0.0, 400.0, 0.0, -3.0], -9999.0) and (r.xmin, r.xmax, r.ymin, r.ymax) == (100, 106, 385, 400)
    assert {s.raster[-5:]: s.depth_positive for s in geotiff.depth_sign(pixels, heads).collect()} == {"a.tif": True, "b.tif": False}
    with pytest.raises(ValueError):
        geotiff.header(b"no raster")


def test_grid_files_in_parts(spark, tmp_path):
    import re
    import xml.etree.ElementTree as xml

    from tidalframe.sinks import grids

    n = 3
    rows = [(e, [float(e + k % n) for k in range(n**3)], [float(k // n % n) for k in range(n**3)], [float(k // n**2) for k in range(n**3)], [float(e * 100 + k) for k in range(n**3)], float(e) / 2) for e in range(5)]
    frame = spark.createDataFrame(rows, "elem long, x array<double>, y array<double>, z array<double>, t array<double>, size double")
    order = grids.lagrange_order(n - 1)
    assert sorted(order.tolist()) == list(range(n**3)) and order[:8].tolist() == [0, 2, 8, 6, 18, 20, 26, 24] and order[8] == 1 and order[-1] == 13
    for encoding in ("ascii", "base64", "binary"):
        folder = str(tmp_path / encoding)
        files = grids.write_pieces(frame, folder, "g", grids.LAGRANGE, ("t",), (), ("size",), 2, encoding, n - 1)
        index = xml.parse(f"{folder}/g.pvtu")
        assert [p.get("Source") for p in index.iter("Piece")] == files and 1 <= len(files) <= 2
        assert sum(int(re.search(rb'NumberOfCells="(\d+)"', open(f"{folder}/{f}", "rb").read())[1]) for f in files) == 5
    values = sorted(float(v) for f in files_of(tmp_path / "ascii") for a in xml.parse(f).iter("DataArray") if a.get("Name") == "t" for v in a.text.split())
    assert values == sorted(v for r in rows for v in r[4])
    ocean = frame.select("elem", "x", "y", "z", *[frame["t"].alias(c) for c in ("eta", "u", "v", "w", "temperature", "salinity")])
    assert grids.write_ocean(ocean, str(tmp_path / "ocean"), "o", n - 1, 1) == ["o_00000.vtu"]
    root = xml.fromstring(grids.xdmf("run", 5, 135, [0.0, 0.5], {"eta": (1, "Node"), "velocity": (3, "Node")}))
    assert [t.get("Value") for t in root.iter("Time")] == ["0.0", "0.5"] and sum(1 for _ in root.iter("Attribute")) == 4


def files_of(folder):
    return sorted(folder.glob("*.vtu"))


def test_chunked_arrays(spark, tmp_path):
    from tidalframe.sinks import grids

    rows = [(t, c, float(100 * t + c)) for t in range(3) for c in range(150) if c != 70 or t]
    frame = spark.createDataFrame(rows, "time long, cell long, v double")
    want = np.full((3, 200), np.nan)
    for t, c, v in rows:
        want[t, c] = v
    for codec in ("none", "gzip", "zstd"):
        folder = str(tmp_path / codec)
        assert grids.write_array(frame, folder, (3, 200), (1, 64), ("time", "cell"), "v", {"units": "m"}, codec) == 9
        assert np.array_equal(grids.read_array(folder), want, equal_nan=True)
    with pytest.raises(ValueError, match="outside"):
        grids.write_array(frame, str(tmp_path / "x"), (2, 200), (1, 64), ("time", "cell"), "v")
    grids.write_group(str(tmp_path / "store"), {"Conventions": "CF-1.8"})
    assert (tmp_path / "store" / "zarr.json").exists()


def tiled_tiff(values: np.ndarray, kind: str, compression: int, predictor: int, tile: int, bands: int = 1) -> bytes:
    """A tiled image of the given coding; further bands hold noise."""
    import struct
    import zlib

    from tidalframe.sources import geotiff

    height, width = values.shape
    across, down = -(-width // tile), -(-height // tile)
    body, offsets, counts = b"", [], []
    for k in range(across * down):
        x, y = k % across * tile, k // across * tile
        whole = np.zeros((tile, tile, bands), dtype=kind)
        part = values[y : y + tile, x : x + tile]
        whole[: part.shape[0], : part.shape[1], 0] = part
        whole[:, :, 1:] = 7
        if predictor == 2:
            whole = np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1]))
        raw = whole.astype("<" + kind).tobytes()
        if predictor == 3:
            size = whole.dtype.itemsize
            planes = np.frombuffer(whole.astype(">" + kind).tobytes(), np.uint8).reshape(tile, tile * bands, size).transpose(0, 2, 1).reshape(tile, size * tile, bands)
            raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
        if compression == 8:
            raw = zlib.compress(raw)
        elif compression == 32773:
            raw = b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
        offsets.append(8 + len(body))
        counts.append(len(raw))
        body += raw
    body += b"\0" * (len(body) % 2)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [np.dtype(kind).itemsize * 8]), (259, 3, [compression]), (277, 3, [bands]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts), (339, 3, [{"f": 3, "i": 2, "u": 1}[kind[0]]])]
    at = 8 + len(body)
    extra, entries = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, code, data in tags:
        raw = struct.pack("<" + geotiff.SIZES[code][0] * len(data), *data)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, code, len(data), start + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, code, len(data)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


def test_tiled_and_coded_rasters(spark, tmp_path):
    from tidalframe.sources import geotiff

    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (37, 21))
    cases = [("f4", 1, 1), ("f4", 8, 3), ("f8", 8, 1), ("i2", 8, 2), ("i4", 32773, 1), ("i2", 1, 2)]
    for k, (kind, compression, predictor) in enumerate(cases):
        (tmp_path / f"{k}.tif").write_bytes(tiled_tiff(values.astype(kind), kind, compression, predictor, 16, 1 + k % 2))
    got = {}
    for r in geotiff.read_pixels(spark, str(tmp_path / "*.tif")).collect():
        got.setdefault(r.raster[-5:], np.zeros(values.shape))[r.py, r.px] = r.val
    assert sorted(got) == [f"{k}.tif" for k in range(len(cases))]
    for name, found in got.items():
        assert (found == values).all(), cases[int(name[0])]
    coded = bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])  # a published example, in 9-bit codes
    assert geotiff.unlzw(coded) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_vector_files(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4]]
    feature = lambda g: {"type": "Feature", "properties": {}, "geometry": g}
    shapes = [{"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1]]]}, {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPolygon", "coordinates": [[ring], [[[9, 9], [-1, 9], [9, 8]]]]}, None]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(g) for g in shapes]}))
    (tmp_path / "b.wkt").write_text("POLYGON ((0 0, 1 0, 1 1, 0 0))")
    rows = files.read_polygons(spark, str(tmp_path / "*")).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.polygon, r.ring, len(r.points)) for r in rows) == [("a.geojson", 0, 0, 5), ("a.geojson", 1, 0, 5), ("a.geojson", 2, 0, 4), ("b.wkt", 0, 0, 4)]

    def root(x, y):
        if x < 0:
            raise ValueError("no root")
        return x**0.5, y

    moved = files.parse_geojson(json.dumps(shapes[2]), root)
    assert [len(p) for p in moved] == [1] and moved[0][0][1] == (2.0, 0.0)
