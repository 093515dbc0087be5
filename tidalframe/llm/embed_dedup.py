"""Near-duplicate embeddings by a robust-pruned flat graph, built on overlapping shards.

1. Equal vectors form a class, represented by its smallest id; a class of any size is one node.
2. Cluster centres are fitted on a bounded sample; every node joins the shards of its ``overlap`` nearest
   centres, whatever the size of the table. A shard of over ``SHARD_MOST`` nodes gets centres of its own, level by level, as long as that divides the work, and
   each node keeps its nearest ``overlap`` shards of all levels, so copies don't grow with the table; what is too dense to be
   divided is cut by hash into parts.
3. Each part of a shard builds a robust-pruned graph over its nodes (``flat_graph``), and a node's adjacency
   lists from all its shards are united.
4. Every node of a part walks the united graph of each part of its shard, greedily from the medoids and its own links, and
   expands the range. This yields candidate groups; inside them every pair is verified by its cosine in double
   precision. A pair that meets in several shards counts in the first of them, at both ends.
5. A task emits a spanning forest of its verified links, from which components are made.
6. Recall, as each linked node's share of its links found, is audited in every run and logged: ``PROBES`` vectors, turned away from
   drawn nodes by angles up to the threshold's, go through the same shards, graphs and searches as the nodes do, and count for nothing
   else; their links, and those of ``AUDITED`` drawn nodes on which the centres were not fitted, are compared with brute force. So recall
   is measured where the table itself has few links or none. Below ``RECALL``, for the probes or for the nodes, the overlap grows, and past
   ``OVERLAP_MOST`` all pairs of nodes are compared, block by block.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; rows with a null id link with nothing and have no
component; rows that repeat an id count as separate vectors with one component; an empty table
gives an empty result; other columns are ignored. Floats and doubles are compared as given, other numbers as doubles.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm import flat_graph
from tidalframe.llm.common import lean, lean_group, materialise, prepare
from tidalframe.llm.components import connected_components

#: Vectors on which centres are fitted; nodes and probes of the audit.
SAMPLE, AUDITED, PROBES = 8192, 128, 128
#: Nodes wanted in a shard, most that one task takes of it, bytes of their vectors at most, and most shards that one is divided into.
SHARD, SHARD_MOST, SHARD_BYTES, FAN = 1024, 6144, 48 << 20, 512
#: Levels of division; members of a large shard that fit its centres in one task.
LEVELS, PART = 5, 1 << 16
OVERLAP, OVERLAP_MOST = 4, 8
QUERIES = 128
RECALL = 0.95
#: What single precision may cost a dot product; candidates are verified in double precision.
SLACK = 1e-4

_log = logging.getLogger(__name__)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows as unit vectors in double precision, padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # squares stay finite
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    pick = np.random.default_rng(11).permutation(len(vectors))[:count]
    have = vectors[pick].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(vectors[i : i + 2048] @ have.T, axis=1) for i in range(0, len(vectors), 2048)])
        sums = np.zeros_like(have)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        have = np.where(norm > 0, sums / np.maximum(norm, 1e-300), have)
    return have


def _shards(middle: np.ndarray, v: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vector joins the shard of each centre, and the angles between them."""
    overlap = min(overlap, len(middle))
    angle = np.arccos(np.clip(v @ middle.T, -1, 1))
    take = np.zeros(angle.shape, dtype=bool)
    take[np.arange(len(take))[:, None], np.argpartition(angle, overlap - 1, axis=1)[:, :overlap]] = True
    return take, angle


def _assign(middle: np.ndarray, overlap: int):
    """(shard, node, angle) of every shard a node joins; shards of the first level are numbered from ``FAN`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                take, angle = _shards(middle, _unit(part.column("v"), middle.shape[1]), overlap)
                row, shard = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(shard + FAN), part.column("node").take(pa.array(row)), pa.array(angle[row, shard])], names=["shard", "node", "angle"])

    return run


def _fit(width: int, overlap: int):
    """Centres for the members of a large shard, from a sample; none if they wouldn't halve the pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, size = _unit(table.column("v"), width), table.column("size_")[0].as_py()
        count = min(FAN, max(2, -(-size // SHARD)), len(x))
        middle = centres(x, count, 4)
        inside = _shards(middle, x, 1)[0].sum(axis=0)
        pays = len(x) > count and 2 * overlap * float((inside.astype(float) ** 2).sum()) <= float(len(x)) ** 2
        return pa.table({"shard": pa.array([key[0].as_py()]), "middle": pa.array([middle.tobytes() if pays else None], pa.binary())})

    return run


def _divide(width: int, overlap: int):
    """The members of a part of a large shard, dealt to the shards it is divided into (numbered ``FAN`` * shard and on)."""

    def run(key: tuple, members: pa.Table, fitted: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        middle = np.frombuffer(fitted.column("middle")[0].as_py()).reshape(-1, width)
        ids, found, angles = [], [], []
        for lo in range(0, members.num_rows, 4096):
            part = members.slice(lo, 4096).combine_chunks()
            take, angle = _shards(middle, _unit(part.column("v"), width), overlap)
            row, sub = np.nonzero(take)
            ids.append(part.column("node").to_numpy()[row])
            found.append(sub + FAN * shard)
            angles.append(angle[row, sub])
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"shard": np.concatenate(found or none), "node": np.concatenate(ids or none), "angle": np.concatenate(angles or none).astype(float)})

    return run


def _divided(members: DataFrame, nodes: DataFrame, width: int, overlap: int, most: int) -> DataFrame:
    """``members`` (shard, node, angle) with every shard of over ``most`` nodes divided, as long as that pays."""
    stuck = None
    for _ in range(LEVELS):
        large = members.groupBy("shard").agg(F.count("node").alias("size_")).where(F.col("size_") > most)
        large = materialise(large if stuck is None else large.join(stuck, "shard", "left_anti"), "large")
        if large.isEmpty():
            break
        inside = members.join(large, "shard").join(nodes.select("node", "v"), "node")
        draw = F.pmod(F.xxhash64("node", F.lit("draw")), F.lit(1 << 30)) < F.ceil(F.lit(float(1 << 30) * SAMPLE / 2) / F.col("size_"))
        fitted = materialise(inside.where(draw).groupBy("shard").applyInArrow(lean_group(_fit(width, overlap)), "shard long, middle binary"), "fitted")
        whole = large.join(fitted.where("middle IS NOT NULL"), "shard", "left_anti").select("shard")
        stuck = materialise(whole if stuck is None else stuck.union(whole), "stuck")
        fitted = fitted.where("middle IS NOT NULL")
        if fitted.isEmpty():
            break
        parts = F.ceil(F.col("size_") / PART).cast("int")
        places = fitted.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "middle")
        dealt = inside.join(fitted.select("shard"), "shard", "left_semi").select("shard", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "v")
        new = dealt.groupBy("shard", "part").cogroup(places.groupBy("shard", "part")).applyInArrow(_divide(width, overlap), "shard long, node long, angle double")
        every = members.join(fitted.select("shard"), "shard", "left_anti").select("shard", "node", "angle").unionByName(new)
        nearest = every.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("angle", "shard"))), 1, overlap).alias("x"))  # few for each node
        members = materialise(nearest.select("node", F.explode("x").alias("x")).select("x.shard", "node", "x.angle"), "members")
    return members


class _Forest:
    """Which nodes hang together, and a link for each union: a spanning forest of all links seen."""

    def __init__(self, count: int):
        self.label = np.arange(count)
        self.links: list[tuple[int, int]] = []

    def join(self, node: int, others: np.ndarray) -> None:
        mine = self.label[node]
        labels = self.label[others]
        if (labels == mine).all():
            return
        apart, at = np.unique(labels, return_index=True)
        self.links += [(node, int(others[k])) for x, k in zip(apart, at, strict=True) if x != mine]
        self.label[np.isin(self.label, apart)] = mine


def _earlier(left: pa.Array, right: pa.Array, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Incidence of the rows of both sides with the shards before ``shard`` that occur on both."""
    flat, sizes = zip(*((x.flatten().to_numpy(), np.asarray(x.value_lengths())) for x in (left, right)), strict=True)
    common = np.intersect1d(flat[0], flat[1])
    common = common[common < shard]
    out = []
    for values, size in zip(flat, sizes, strict=True):
        have = np.zeros((len(size), len(common)), dtype=np.float32)
        here = np.isin(values, common)
        have[np.repeat(np.arange(len(size)), size)[here], np.searchsorted(common, values[here])] = 1
        out.append(have)
    return out[0], out[1]


def _links(width: int):
    """A part's robust-pruned graph, as adjacency lists."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        links = flat_graph.build(_unit(table.column("v"), width).astype(np.float32))
        on = links >= 0
        ends = np.concatenate([[0], np.cumsum(on.sum(axis=1))]).astype(np.int32)
        return pa.table({"node": ids, "near": pa.ListArray.from_arrays(ends, pa.array(ids[links[on]]))})

    return run


def _within(ids: np.ndarray, near: pa.Array) -> np.ndarray:
    """Adjacency lists by id as a table of places among ``ids``; what is not among them is left out."""
    flat, sizes = near.flatten().to_numpy(), np.asarray(pc.fill_null(near.value_lengths(), 0), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    at = order[np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)]
    here = ids[at] == flat
    row, at = np.repeat(np.arange(len(ids)), sizes)[here], at[here]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))])
    out = np.full((len(ids), max(1, int(np.diff(first).max(initial=0)))), -1, dtype=np.int32)
    out[row, np.arange(len(row)) - first[row]] = at
    return out


def _search(width: int, threshold: float, exact: bool):
    """Links between parts i and j of a shard: found by walking j's graph, or all compared (``exact``); verified."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, i, j = (k.as_py() for k in key)
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        left = table.filter(pa.array(role == 0)).combine_chunks()
        right = left if i == j else table.filter(pa.array(role == 1)).combine_chunks()
        (node, ids, size, many), (names, who, sizes, others) = ([t.column(c).to_numpy() for c in ("node", "vec_id", "size", "m")] for t in (left, right))
        q, x = _unit(left.column("v"), width), _unit(right.column("v"), width)
        offset = 0 if i == j else len(ids)
        labels = flat_graph.Labels(offset + len(who))
        if exact:
            labels.of[:] = 0
        else:
            links = _within(names, right.column("near").combine_chunks())
            own = np.arange(len(ids)) if i == j else np.full(len(ids), -1)
            flat_graph.range_search(x.astype(np.float32), links, q.astype(np.float32), own, threshold - SLACK, np.arange(len(ids)), labels, offset)
        before, prior = _earlier(*(t.column("shards").combine_chunks() for t in (left, right)), shard)
        found, back = np.zeros(len(ids), dtype=np.int64), np.zeros(len(who), dtype=np.int64)
        forest = _Forest(offset + len(who))
        group, there = labels.of[: len(ids)], labels.of[offset:]
        by, order = np.argsort(group, kind="stable"), np.argsort(there, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(group[by])) + 1).tolist(), len(by)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # the candidates of a group are verified with each other
            lo, hi = np.searchsorted(there, [group[by[a]], group[by[a]] + 1], sorter=order)
            mine, theirs = by[a:b], order[lo:hi]
            if not len(theirs) or (i == j and len(mine) == 1):
                continue
            v, w, told = x[theirs], size[mine], sizes[theirs]
            for k in range(0, len(mine), QUERIES):
                some = mine[k : k + QUERIES]
                near = q[some] @ v.T >= threshold
                near &= (w[k : k + QUERIES, None] == told[None, :]) & (ids[some, None] != who[None, theirs])
                if i == j:
                    near &= some[:, None] != theirs[None, :]
                real = near & (many[some, None] > 0) & (others[None, theirs] > 0)  # probes hold nothing together
                for r in np.flatnonzero(real.any(axis=1)).tolist():
                    forest.join(int(some[r]), offset + theirs[real[r]])
                if before.shape[1]:
                    near &= before[some] @ prior[theirs].T == 0  # a pair counts in the first shard that both are in
                found[some] += near @ others[theirs]
                if i != j:
                    back[theirs] += many[some] @ near
        links, every, name = np.concatenate([found, back]), np.concatenate([node, names]), np.concatenate([ids, who])
        some = np.flatnonzero(links)
        joined = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        counts = pa.table({"node": every[some], "n": links[some], "a": pa.nulls(len(some), pa.int64()), "b": pa.nulls(len(some), pa.int64())})
        none = pa.nulls(len(joined), pa.int64())
        return pa.concat_tables([counts, pa.table({"node": none, "n": none, "a": name[joined[:, 0]], "b": name[joined[:, 1]]})])

    return run


def _brute(width: int, q: np.ndarray, size: np.ndarray, ids: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q), dtype=np.int64)
        for part in batches:
            if not part.num_rows:
                continue
            x, sizes, who, many = _unit(part.column("v"), width), *(part.column(c).to_numpy() for c in ("size", "vec_id", "m"))
            for lo in range(0, len(q), 1024):
                near = (q[lo : lo + 1024] @ x.T >= threshold) & (size[lo : lo + 1024, None] == sizes[None, :])
                near &= ids[lo : lo + 1024, None] != who[None, :]
                total[lo : lo + 1024] += near @ many
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(total)], names=["k", "n"])

    return run


def _truth(nodes: DataFrame, drawn: pa.Table, width: int, threshold: float) -> dict[int, list[int]]:
    """True link counts by vec_id of the ``drawn`` vectors that have any."""
    truth: dict[int, list[int]] = {}
    ids = drawn.column("vec_id").to_numpy()
    brute = nodes.mapInArrow(lean(_brute(width, _unit(drawn.column("v"), width), drawn.column("size").to_numpy(), ids, threshold)), "k long, n long")
    for k, n in brute.groupBy("k").agg(F.sum("n").alias("n")).where("n > 0").collect():  # at most as many as are drawn
        truth.setdefault(int(ids[k]), []).append(n)
    return truth


def probes_of(drawn: pa.Table, width: int, threshold: float, first: int) -> pa.Table:
    """(node, vec_id, m, size, v): a vector beside each drawn one, at evenly spread angles up to the threshold's; none counts as a row (m = 0)."""
    x, sizes = _unit(drawn.column("v"), width), drawn.column("size").to_numpy()
    rng = np.random.default_rng(29)
    turn = rng.normal(size=x.shape) * (np.arange(width)[None, :] < sizes[:, None])
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    long = np.linalg.norm(turn, axis=1, keepdims=True)
    turn = np.where(long > 1e-9, turn / np.maximum(long, 1e-300), 0.0)
    angle = 0.98 * np.arccos(np.clip(threshold, -1, 1)) * (rng.permutation(len(x))[:, None] + 0.5) / max(1, len(x))
    beside = np.cos(angle) * x + np.sin(angle) * turn
    return pa.table({"node": -1 - np.arange(len(x)), "vec_id": first + np.arange(len(x)), "m": np.zeros(len(x), dtype=np.int64), "size": pa.array(sizes, pa.int32()), "v": pa.array([v[:k].tolist() for v, k in zip(beside, sizes, strict=True)], pa.list_(pa.float64()))})


def mean_recall(truth: dict[int, list[int]], got: dict[int, int]) -> float:
    """Share of its links that a node with links has, on average: each node counts once, however many copies its links have."""
    return float(np.mean([min(1.0, got.get(i, 0) / sum(n)) for i, n in truth.items()])) if truth else 1.0


def _found(nodes: DataFrame, members: DataFrame, width: int, threshold: float, most: int, exact: bool) -> DataFrame:
    """(node, n) of verified links, and (a, b), ids of links that span what is linked."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("node") / most).cast("int").alias("subs"))
    lists = members.groupBy("node").agg(F.collect_set("shard").alias("shards"))  # a node joins few shards
    placed = members.select("shard", "node").join(sizes, "shard").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")).join(lists, "node").join(nodes, "node")
    if exact:
        placed = placed.withColumn("near", F.lit(None).cast("array<bigint>"))
    else:
        built = placed.groupBy("shard", "sub").applyInArrow(lean_group(_links(width)), "node long, near array<long>")
        united = materialise(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        placed = placed.join(united, "node")
    asks = F.transform(F.sequence(F.col("sub"), F.col("subs") - 1), lambda j: F.struct(F.lit(0).alias("role"), F.col("sub").alias("i"), j.alias("j")))
    told = F.transform(F.filter(F.sequence(F.lit(0), F.col("sub")), lambda i: i < F.col("sub")), lambda i: F.struct(F.lit(1).alias("role"), i.alias("i"), F.col("sub").alias("j")))
    work = placed.withColumn("x", F.explode(F.concat(asks, told))).select("shard", "shards", "x.*", "node", "vec_id", "m", "size", "v", "near")
    return materialise(work.groupBy("shard", "i", "j").applyInArrow(lean_group(_search(width, threshold, exact)), "node long, n long, a long, b long"), "found")


def near_vectors(rows: DataFrame, threshold: float = 0.95, overlap: int = OVERLAP, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = "float" if kind == "array<float>" else "double"
    e = F.transform(rows["embedding"], lambda x: x.cast(kind))
    given = rows.select(rows["vec_id"].cast("long").alias("vec_id"), e.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    given = given.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0).cast(kind))))  # -0.0 and 0.0 are one value
    classes = given.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("vec_id").alias("m"))
    named = classes.withColumn("node", F.monotonically_increasing_id())  # rows of one id may hold several vectors
    nodes = materialise(named.select("node", "vec_id", "m", F.size("v").cast("int").alias("size"), "v"), "nodes")
    count, width = nodes.agg(F.count("vec_id"), F.max("size")).first()
    if not count:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    picked = nodes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE + AUDITED + PROBES).toArrow()
    sample = _unit(picked.slice(0, SAMPLE).column("v"), width)
    drawn = picked.slice(max(0, min(SAMPLE, picked.num_rows - AUDITED - PROBES)))  # not those the centres are fitted on, unless the table has no others
    low, high = nodes.agg(F.min("vec_id"), F.max("vec_id")).first()
    beside = probes_of(drawn.slice(0, PROBES), width, threshold, low - PROBES if low - PROBES >= -(1 << 63) else high + 1)
    probes = spark.createDataFrame(beside, "node long, vec_id long, m long, size int, v array<double>").withColumn("v", F.col("v").cast(f"array<{kind}>"))
    searched = materialise(nodes.unionByName(probes), "searched")
    truths = {"probes": _truth(nodes, beside, width, threshold), "nodes": _truth(nodes, drawn.slice(PROBES if drawn.num_rows > PROBES else 0), width, threshold)}
    asked = sorted({i for t in truths.values() for i in t})
    most = max(QUERIES, min(SHARD_MOST, SHARD_BYTES // (8 * width)))
    middle = centres(sample, max(1, min(FAN, len(sample), -(-count // SHARD))))
    first = overlap
    while True:
        members = materialise(searched.mapInArrow(lean(_assign(middle, overlap)), "shard long, node long, angle double"), "members")
        exact = overlap > OVERLAP_MOST or (overlap > max(first, len(middle)))
        if exact:
            members = searched.select(F.lit(0).cast("long").alias("shard"), "node")
        else:
            members = _divided(members, searched, width, overlap, most)
        found = _found(searched, members, width, threshold, most, exact)
        degrees = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
        if exact:  # all pairs were compared
            break
        got = dict(searched.select("node", "vec_id").where(F.col("vec_id").isin(asked)).join(degrees, "node").groupBy("vec_id").agg(F.sum("n")).collect())
        have = {name: mean_recall(t, got) for name, t in truths.items()}
        _log.info("recall at overlap %s: %s", overlap, ", ".join(f"{have[k]:.4f} of {len(t)} linked {k}" for k, t in truths.items()))
        if min(have.values()) >= recall:
            break
        overlap += 2
    together = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    placed = nodes.select("node", "vec_id", "m", "v").join(degrees, "node", "left").join(together.withColumnRenamed("node", "id_"), F.col("vec_id") == F.col("id_"), "left")
    placed = placed.select("v", F.coalesce("component", "vec_id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("links"))
    out = given.join(placed, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
