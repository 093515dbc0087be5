"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every whole text gets its shingle set, a signature of 128 minima and a content key; documents
   with the same words form a class, represented by the smallest doc_id.
2. Signatures are cut into 32 bands of 4; representatives that agree in a band share a bucket.
3. In each bucket every member is paired with a pivot, never with every other member. Pairs
   are compared in batches of signature positions: with m of n positions equal and a uniform prior, the
   posterior chance that the similarity reaches the threshold is that of a binomial tail, and a pair is
   dropped as soon as that chance falls below ``MISS``. Survivors are verified on full shingle
   sets.
4. Buckets whose members are now in several components get the missing comparisons: members
   outside the bucket's main component against all members, on signatures, in blocks of bounded
   size. Components that may be linked by what Bayes leaves form a family; in each family members outside the main
   component are compared with all, again in blocks, and what Bayes leaves is verified on
   full sets until it unites them. So every banded pair is in one component or was compared.
5. Links give components; copies follow their class.

A pair of similarity 0.8 is missed by all bands with chance (1 - 0.8**4)**32, about 5e-8.

Edge cases: a null or wordless text has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; a row with a null doc_id has no component and is kept; rows
that repeat a doc_id each get the component of their own text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import document_texts, lean, lean_group, materialise, partitions, prepare, slices
from tidalframe.llm.components import connected_components
from tidalframe.llm.textbytes import Words, mix, window_hashes

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Bucket members compared in one task, on either side.
BLOCK = 512
#: Orders by which buckets choose pivots.
PIVOTS = 4

_MULTIPLIERS = np.random.default_rng(20240501).integers(0, 1 << 63, size=(2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bayes_floors(threshold: float, miss: float = MISS, batch: int = BATCH, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(n, fewest equal positions among the first n with which a pair goes on)."""
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:  # P(similarity >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Distinct shingle hashes of each text, sorted within it; n + 1 offsets; content keys (None: no words).

    A-Z are lower-cased; fewer words than ``width`` make one shingle.
    """
    words = Words(column)
    data = words.data
    upper = (data >= 0x41) & (data <= 0x5A)
    words.data = np.where(upper, data + np.uint8(32), data)
    h = words.hashes()
    windows = window_hashes(h, width)
    sets, keys = [], []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if a == b:
            sets.append(windows[:0])
            keys.append(None)
            continue
        keys.append(hashlib.blake2b(words.data[words.start[a] : words.end[b - 1]].tobytes(), digest_size=16).digest())
        sets.append(np.unique(windows[a : b - width + 1]) if b - a >= width else window_hashes(h[a:b], int(b - a)) ^ np.uint64(b - a))
    offsets = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else h[:0]), offsets, keys


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima of each non-empty set: rows of ``HASHES`` uint32."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, HASHES), dtype=np.uint32)
    if len(full):
        at = offsets[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(hashes * _MULTIPLIERS[0, k] + _MULTIPLIERS[1, k], at) >> np.uint64(32)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, offsets, keys = shingle_sets(part.column("text"), width)
            sig = signatures(hashes, offsets)
            sigs = [s.tobytes() if k is not None else None for s, k in zip(sig, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "th", "n", "key", "sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, offsets, keys = shingle_sets(part.column("text"), width)
            rows = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "key", "hashes"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), HASHES)


def _sifted(threshold: float):
    floors = bayes_floors(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x, y = _matrix(part.column("sig_a")), _matrix(part.column("sig_b"))
            on, equal = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
            for n, least in floors:
                equal[on] += (x[on, n - BATCH : n] == y[on, n - BATCH : n]).sum(axis=1)
                on = on[equal[on] >= least]
            yield part.select(["a", "b"]).take(pa.array(on))

    return run


class _Sets:
    """Disjoint sets that begin with the members of each label together."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        self.up = list(range(int(self.of.max()) + 1))

    def find(self, i: int) -> int:
        x = int(self.of[i])
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(i), self.find(j)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _blocks(numerator: int, denominator: int, exact: bool):
    """Compare the askers (role 0) of a block with the told (role 1) of other components.

    What Bayes leaves is taken in order of estimated similarity, and a pair counts only if it unites two
    sets that were apart, so a task returns fewer links than it has rows. ``exact`` verifies
    each such pair on full sets first.
    """
    threshold = numerator / denominator
    floors = bayes_floors(threshold)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
        sig = _matrix(table.column("sig").combine_chunks())
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes").combine_chunks()] if exact else []
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        together = _Sets(comp)
        found: list[tuple[int, int]] = []
        for lo in range(0, len(left), 64):
            some = left[lo : lo + 64]
            i, j = np.nonzero(comp[some][:, None] != comp[right][None, :])
            a, b = some[i], right[j]
            close = denominator * np.minimum(n[a], n[b]) >= numerator * np.maximum(n[a], n[b])
            a, b = a[close], b[close]
            equal = np.zeros(len(a), dtype=np.int64)
            for upto, least in floors:
                equal = equal + (sig[a, upto - BATCH : upto] == sig[b, upto - BATCH : upto]).sum(axis=1)
                on = equal >= least
                a, b, equal = a[on], b[on], equal[on]
            for k in np.argsort(-equal, kind="stable").tolist():
                x, y = int(a[k]), int(b[k])
                if together.find(x) != together.find(y) and (not exact or similar(hashes[x], hashes[y], numerator, denominator)):
                    together.join(x, y)
                    found.append((int(rep[x]), int(rep[y])))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return run


def similar(p: np.ndarray, q: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    both = int((q[at] == p).sum())
    return denominator * both >= numerator * (len(p) + len(q) - both)


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = []
            for x, y in zip(part.column("hashes_a"), part.column("hashes_b"), strict=True):
                good.append(similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), numerator, denominator))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(lean(_verified(numerator, denominator)), "a long, b long")


def _compared(rows: DataFrame, key: str, sets: DataFrame, numerator: int, denominator: int, exact: bool) -> DataFrame:
    """Links between the members of a group that lie outside its main component and all its members.

    ``rows``: the group's key, rep, component, main, size, most. Both sides are dealt into blocks,
    and each pair of blocks is a task.
    """
    spot = F.xxhash64("rep")
    inner, outer = (F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int") for n in (F.col("size"), F.col("size") - F.col("most")))
    mine = lambda count: F.pmod(spot, count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    asks = rows.where("component <> main").select(key, "rep", "component", F.lit(0).alias("role"), mine(outer).alias("i"), every(inner).alias("j"))
    told = rows.select(key, "rep", "component", F.lit(1).alias("role"), mine(inner).alias("j"), every(outer).alias("i")).select(key, "rep", "component", "role", "i", "j")
    work = asks.union(told).join(sets, "rep")
    return work.groupBy(key, "i", "j").applyInArrow(lean_group(_blocks(numerator, denominator, exact)), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept; and text_hash, which tells rows of one doc_id apart.

    Documents are linked where ``denominator * intersection >= numerator * union`` of their
    ``width``-word shingle sets.
    """
    prepare(docs.sparkSession)
    threshold = numerator / denominator
    given = document_texts(docs)
    signed = materialise(given.withColumn("th", F.xxhash64("text")).mapInArrow(lean(_sign(width)), "doc_id long, th long, n long, key binary, sig binary"), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = usable.groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"))
    reps = materialise(classes.select("key", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig")), "classes")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct((b % PIVOTS).alias("turn"), F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")))).alias("x")
    banded = reps.select("rep", band).select("rep", "x.turn", "x.bucket")
    chosen = banded.groupBy("bucket").agg(F.count("rep").alias("size"), F.min_by("rep", F.xxhash64("rep", "turn")).alias("pivot")).where("size > 1")
    members = materialise(banded.select("rep", "bucket").join(chosen, "bucket").distinct(), "buckets")

    active = members.select("rep").distinct()
    wanted = reps.join(active, "rep", "left_semi")
    texts = given.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").repartition(partitions(given, 8 << 20))
    hashed = texts.mapInArrow(lean(_sets(width)), "doc_id long, key binary, hashes binary")
    hashed = hashed.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "key"]).dropDuplicates(["rep", "key"])
    sets = materialise(hashed.select("rep", "n", "sig", "hashes"), "sets")

    pairs = members.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(left, "a").join(right, "b").where(denominator * F.least("n_a", "n_b") >= numerator * F.greatest("n_a", "n_b"))
    sifted = sized.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_sifted(threshold)), "a long, b long")
    links = materialise(_verify(sifted, sets, numerator, denominator), "links")
    first = connected_components(links)

    seen = members.join(first, members["rep"] == first["node"], "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    seen = materialise(seen, "seen")
    parts = seen.groupBy("bucket", "component").agg(F.count("rep").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark"))
    mixed = parts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most"), F.sum("mark").alias("mark")).where("most < size")
    once = mixed.groupBy("mark", "size").agg(F.min(F.struct("bucket", "main", "most")).alias("x")).select("x.*", "size")  # buckets with the same members
    near = _compared(seen.join(once, "bucket"), "bucket", sets.select("rep", "n", "sig"), numerator, denominator, exact=False)
    near = materialise(near.distinct(), "near")
    found = first
    if not near.isEmpty():
        known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
        families = connected_components(known.union(near)).withColumnRenamed("component", "family")
        kin = sets.select("rep").join(families, F.col("rep") == F.col("node")).select("rep", "family")
        kin = kin.join(first, F.col("rep") == F.col("node"), "left").select("family", "rep", F.coalesce("component", "rep").alias("component"))
        parts = kin.groupBy("family", "component").agg(F.count("rep").alias("c"))
        split = parts.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).where("most < size")
        extra = materialise(_compared(kin.join(split, "family"), "family", sets, numerator, denominator, exact=True), "links")
        if not extra.isEmpty():
            found = connected_components(known.union(extra))

    placed = reps.select("key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "th", "n", "key").join(placed, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    named = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("th").alias("text_hash"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all their columns."""
    gone = near_duplicates(docs, width, numerator, denominator).where("NOT kept").select(F.col("doc_id").alias("id__"), F.col("text_hash").alias("th__")).distinct()
    marked = docs.withColumn("th__", F.xxhash64(docs["text"].cast("string")))
    id_ = marked["doc_id"].cast("long")
    stays = marked.join(gone, (id_ == gone["id__"]) & (marked["th__"] == gone["th__"]), "left_anti")
    copies = stays.where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id", "th__"])
    return copies.unionByName(stays.where("doc_id IS NULL OR text IS NULL")).drop("th__")
