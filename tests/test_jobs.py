"""The jobs: against SQL, run again, over growing input, after a failure, and from the command line."""

from __future__ import annotations

import json
import math
import os
import subprocess
import sys
import uuid
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import depth_mesh, field_notes, queries
from tests.oracle import connect, same


def folder(name: str) -> str:
    return f"/tmp/checkpoints/test-{name}-{uuid.uuid4().hex}"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs(name, spark, sf_dir):
    got, want = same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
    assert got == want and len(got) > 200


def test_jobs_are_registered():
    import __spark_entry__ as entry

    assert {"job1_depth_mesh", "job2_field_notes"} <= set(entry.queries()) & set(entry.oracle_sql())


# depth_mesh

PLAIN = {"x": "x", "y": "y", "z": "z", "box": [0.0, 16.0, 0.0, 16.0], "base": 1, "deepest": 4, "tolerance": 1.0, "few": 2, "tile_level": 1}


def meshed(spark, rows, config=PLAIN):
    path, out = folder("soundings"), folder("mesh")
    spark.createDataFrame(rows, "x double, y double, z double, tile int, n string").write.parquet(path)
    told = depth_mesh.run(spark, path, out, config)
    return told, spark.read.parquet(out).collect()


def test_mesh_covers_the_box_and_is_graded(spark):
    rows = [(0.3 + 0.01 * k, 0.4, float(k), 1, "a") for k in range(9)] + [(15.9, 15.9, 3.0, None, None)] * 3
    told, leaves = meshed(spark, rows)
    assert told == {"kept": 12, "leaves": len(leaves), "empty": sum(r.soundings == 0 for r in leaves)}
    assert sum((r.xmax - r.xmin) * (r.ymax - r.ymin) for r in leaves) == 256.0
    assert sorted(r.leaf for r in leaves) == list(range(len(leaves)))
    level = {(r.ix << (4 - r.lx), r.iy << (4 - r.lx)): r.lx for r in leaves}
    cells = {(x + i, y + j): k for (x, y), k in level.items() for i in range(1 << (4 - k)) for j in range(1 << (4 - k))}
    assert len(cells) == 256
    assert all(abs(k - cells.get((x + a, y + b), k)) <= 1 for (x, y), k in cells.items() for a, b in ((1, 0), (0, 1)))
    assert max(level.values()) == 4
    at = {(r.lx, r.ix, r.iy): r for r in leaves}
    assert at[(4, 0, 0)].depth == 4.0 and at[(4, 0, 0)].soundings == 9
    assert at[(4, 1, 1)].soundings == 0 and (at[(4, 1, 1)].depth, at[(4, 1, 1)].from_level) == (4.0, 3)
    assert at[(1, 1, 1)].depth == 3.0 and at[(1, 0, 1)].depth is None


def test_mesh_matches_brute_force_splits(spark):
    rows = [(float(k * 7 % 16) + 0.5, float(k * k % 16) + 0.25, math.sin(k) * 3, k, "x") for k in range(300)]
    _, leaves = meshed(spark, rows)
    held = defaultdict(list)
    for x, y, z, *_ in rows:
        for k in range(1, 5):
            held[(k, int(x) >> (4 - k), int(y) >> (4 - k))].append(z)
    split = {c for c, z in held.items() if c[0] < 4 and len(z) >= 2 and max(z) - min(z) > 1.0}
    todo = list(split)
    while todo:
        k, i, j = todo.pop()
        for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            up = (k - 1, (i + a) >> 1, (j + b) >> 1)
            if k > 1 and 0 <= i + a < 1 << k and 0 <= j + b < 1 << k and up not in split:
                split.add(up)
                todo.append(up)
    every = {(1, i, j) for i in range(2) for j in range(2)} | {(k + 1, 2 * i + a, 2 * j + b) for k, i, j in split for a in (0, 1) for b in (0, 1)}
    assert {(r.lx, r.ix, r.iy) for r in leaves} == every - split
    for r in leaves:
        z = held.get((r.lx, r.ix, r.iy), [])
        assert r.soundings == len(z)
        assert not z or math.isclose(r.depth, sum(z) / len(z), abs_tol=1e-12)


def test_bad_soundings_are_counted_and_left_out(spark):
    nan, inf = math.nan, math.inf
    rows = [(1.0, 1.0, 5.0, 0, ""), (None, 1.0, 5.0, 0, ""), (1.0, 1.0, None, 0, ""), (1.0, nan, 5.0, 0, ""), (1.0, 1.0, inf, 0, ""), (17.0, 1.0, 5.0, 0, ""), (16.0, 16.0, 7.0, 0, "")]
    told, leaves = meshed(spark, rows)
    assert told == {"kept": 2, "missing": 2, "not finite": 2, "outside": 1, "leaves": 4, "empty": 2}
    assert {(r.ix, r.iy): r.depth for r in leaves} == {(0, 0): 5.0, (1, 1): 7.0, (0, 1): None, (1, 0): None}
    told, leaves = meshed(spark, [])
    assert told == {"leaves": 4, "empty": 4}
    with pytest.raises(ValueError, match="rise"):
        meshed(spark, [], PLAIN | {"tile_level": 3})


def test_mesh_runs_again_with_the_same_result(spark, sf_dir):
    out = folder("again")
    first = depth_mesh.run(spark, f"{sf_dir}/lineitem.parquet", out, depth_mesh.config_of())
    before = sorted(map(str, spark.read.parquet(out).collect()))
    assert depth_mesh.run(spark, f"{sf_dir}/lineitem.parquet", out, depth_mesh.config_of()) == first
    assert sorted(map(str, spark.read.parquet(out).collect())) == before
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


# field_notes

NOTES = "doc_id long, text string, lang string, source string, n_chars long, batch string, r int"


def put(spark, path, rows):
    spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], NOTES).coalesce(1).write.mode("append").parquet(path)


def state(spark, out):
    notes, sources = field_notes.read_output(spark, out)
    return sorted(map(str, notes.drop("batch").collect())), sorted(map(str, sources.collect()))


def test_only_new_notes_are_taken(spark):
    path, out, mark = folder("notes"), folder("out"), folder("mark")
    put(spark, path, [(1, "depth 12.5 m\nthen 7", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "no reading", "en", "b")])
    run = lambda: field_notes.run(spark, path, out, mark, field_notes.config_of())
    assert run() == {"batches": 1, "notes": 4, "sources": 3}
    first = state(spark, out)
    assert run() == {"batches": 0, "notes": 0, "sources": 0}
    assert state(spark, out) == first
    untouched = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{out}/sources/source=b").select("path", "modificationTime").collect()}
    put(spark, path, [(0, "0.5 first", "en", "a"), (9, "3 4 5.125 9999999999", "de", "c"), (1, "depth 12.5 m\nthen 7", "en", "a")])
    assert run() == {"batches": 1, "notes": 3, "sources": 2}
    notes, sources = field_notes.read_output(spark, out)
    assert notes.count() == 7
    got = {r.source: (r.documents, r.lines, r.words, r.readings, r.total, r.low, r.high, r.first, r.last) for r in sources.collect()}
    assert got == {
        "a": (4, 5, 12, 5, 39500, 500, 12500, 500, 7000), "b": (1, 1, 2, 0, 0, None, None, None, None), None: (1, 1, 0, 0, 0, None, None, None, None),
        "c": (1, 1, 4, 5, 1000000020125, 3000, 999999999000, 3000, 9000),
    }
    assert untouched == {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{out}/sources/source=b").select("path", "modificationTime").collect()}
    whole, apart = folder("out"), folder("mark")
    field_notes.run(spark, path, whole, apart, field_notes.config_of())
    assert state(spark, out) == state(spark, whole)


def test_a_batch_that_failed_is_run_again(spark, monkeypatch):
    path, out, mark = folder("notes"), folder("out"), folder("mark")
    put(spark, path, [(k, f"{k}.5 and {k}", "en", f"s{k % 3}") for k in range(30)])
    real = field_notes.digest_of_sources

    def broken(notes):
        raise RuntimeError("lost")

    monkeypatch.setattr(field_notes, "digest_of_sources", broken)
    with pytest.raises(Exception, match="lost"):
        field_notes.run(spark, path, out, mark, field_notes.config_of())
    monkeypatch.setattr(field_notes, "digest_of_sources", real)
    assert field_notes.run(spark, path, out, mark, field_notes.config_of()) == {"batches": 1, "notes": 30, "sources": 3}
    notes, sources = field_notes.read_output(spark, out)
    assert notes.count() == 30 and sources.agg(F.sum("readings"), F.sum("documents")).first() == (60, 30)


def test_many_files_are_taken_in_several_batches(spark):
    path, out, mark = folder("notes"), folder("out"), folder("mark")
    for k in range(5):
        put(spark, path, [(10 * k + j, f"{j}", "en", "hot") for j in range(10)])
    assert field_notes.run(spark, path, out, mark, field_notes.config_of() | {"files_per_batch": 2}) == {"batches": 3, "notes": 50, "sources": 3}
    assert field_notes.read_output(spark, out)[1].first().total == 5 * 45000


def test_command_lines(sf_dir):
    root = Path(__file__).resolve().parents[1]
    out, config = folder("cli"), Path(folder("config") + ".json")
    config.parent.mkdir(parents=True, exist_ok=True)
    config.write_text(json.dumps(depth_mesh.config_of() | {"deepest": 4}))
    call = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    done = call("jobs.depth_mesh", "--soundings", f"{sf_dir}/lineitem.parquet", "--output", out, "--config", str(config))
    assert done.returncode == 0 and "read 6000 soundings" in done.stderr and "wrote 112 leaves" in done.stderr, done.stderr[-2000:]
    done = call("jobs.field_notes", "--notes", f"{sf_dir}/documents.parquet*", "--output", folder("cli"), "--checkpoint", folder("mark"))
    assert done.returncode == 0 and "read 200 notes" in done.stderr, done.stderr[-2000:]
