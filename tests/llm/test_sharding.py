"""Hilbert shards against brute force, and as files that prune."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import corpus
from tests.oracle import connect, same
from tidalframe.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string, lang string, bucket int, shard string, Row string, size double, axis0 int, curve string"


def rows_of(extra=()):
    wide = [(i, t, s, (None, "de", "en", "fr")[k % 4], b, "x", "y", 0.5, 7, "z") for k, (i, t, s, _, b) in enumerate(corpus())]
    return [*wide, *extra]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, axes, bits):
    cells = spark.range(1 << (axes * bits)).select(*[F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"a{k}") for k in range(axes)])
    path = sorted(tuple(r) for r in cells.select(sharding.hilbert_index([F.col(f"a{k}") for k in range(axes)], bits), *cells.columns).collect())
    assert [p[0] for p in path] == list(range(1 << (axes * bits)))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_axes_are_checked():
    with pytest.raises(ValueError, match="axes"):
        sharding.hilbert_index([F.lit(1)], 3)


def coordinate(values):
    """Equal depth by counting."""
    order = lambda v: (v is not None, v if v is not None else 0 if not any(isinstance(x, str) for x in values) else "")
    return [32 * sum(order(x) < order(v) for x in values) // len(values) for v in values]


def test_shards_are_equal_runs_of_the_curve(spark, docs):
    for shards in (24, 5, 1):
        out = sharding.hilbert_shards(docs, shards).collect()
        given = rows_of()
        sizes = [len((t or "").encode()) + 8 for _, t, *_ in given]
        key = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        want = defaultdict(list)
        for (i, t, *_), a, b, c in zip(given, coordinate([g[3] for g in given]), coordinate([g[2] for g in given]), coordinate(sizes), strict=True):
            want[key(i, t)].append((a, b, c))
        got = defaultdict(list)
        for r in out:
            got[(r.doc_id, r["size"], r.text_crc32)].append((r.at0, r.at1, r.at2))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        order = sorted(out, key=lambda r: (r.shard, r.slot))
        place = [(r.curve, r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in order]
        assert place == sorted(place)
        by = defaultdict(list)
        for r in order:
            by[r.shard].append(r)
        for shard, part in by.items():
            assert 0 <= shard < shards
            assert [r.slot for r in part] == list(range(len(part)))
        totals = [sum(r["size"] for r in by[k]) for k in range(shards)]
        assert max(abs(x - sum(sizes) / shards) for x in totals) <= max(sizes)
        assert all(r.law == "bytes" and r.grown_shard is None for r in out)


def test_hot_value_and_repeated_rows(spark):
    hot = [(7, "same text", "hot", "en")] * 60 + [(k, f"text {k}", "hot", None) for k in range(60)]
    out = sharding.hilbert_shards(spark.createDataFrame(hot, "doc_id long, text string, source string, lang string"), 6).collect()
    totals = defaultdict(int)
    for r in out:
        totals[r.shard] += r["size"]
    assert len(out) == 120
    assert max(totals.values()) - min(totals.values()) <= 2 * max(r["size"] for r in out)


def test_nothing_and_nulls_only(spark):
    kind = "doc_id long, text string, source string, lang string"
    assert sharding.hilbert_shards(spark.createDataFrame([], kind)).collect() == []
    out = sharding.hilbert_shards(spark.createDataFrame([(None, None, None, None)] * 3, kind), 3).collect()
    assert sorted((r.shard, r.slot, r["size"], r.text_crc32) for r in out) == [(0, 0, 8, 0), (1, 0, 8, 0), (2, 0, 8, 0)]


def test_written_shards_keep_rows_and_prune(spark, docs, sf_dir):
    path = f"/tmp/checkpoints/shards-{uuid.uuid4().hex}"
    name = sharding.write_shards(docs, path, 5)
    back = spark.read.parquet(path)
    assert name == "shard_"
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = sharding.write_shards(whole, path, 24)
    dealt = spark.read.parquet(path)
    assert {r.doc_id: r[name] for r in dealt.collect()} == {r.doc_id: r.shard for r in sharding.hilbert_shards(whole).collect()}
    least = dealt.groupBy(name).agg(F.min("lang").alias("a"), F.max("lang").alias("b"), F.min("source").alias("c"), F.max("source").alias("d")).collect()
    spread = lambda lo, hi, v: sum(r[lo] <= v <= r[hi] for r in least)
    assert spread("a", "b", "de") < 24 and spread("c", "d", "src3") < 24
    assert sum(r.a == r.b for r in least) >= 8


def test_registered_query(spark, sf_dir):
    got, want = same(queries.op11_hilbert_shards(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op11_hilbert_shards"])
    assert got == want and len(got) == 200
