"""Repeated byte strings by common-prefix interval trees of an enhanced suffix array.

Every ``length``-byte window has an anchor: its ``SEED``-gram of least hash. Runs of windows with one anchor travel, as
in super-k-mers, to the anchor's bucket. A bucket's suffix array holds the suffixes that start at
its anchors, with the common prefixes of neighbours; a stack scan turns it into the tree of
common-prefix intervals. In each interval the occurrences are ordered by their left contexts, and a second stack scan over
what neighbours there have in common gives the groups that differ in the next byte to the left, if only because a run
begins there: left-diverse groups. One of them is a maximal repeat if its occurrences differ to the right too, which they
do unless a longer prefix holds all of them. ``maximal_repeats`` lists these groups with all their occurrences;
``remove_repeats`` needs of each occurrence only the farthest left and right that a group of ``length`` bytes reaches.

Equal windows have equal anchors at equal offsets, so they always meet in one bucket, and the
tree finds them exactly: for two occurrences, their lowest common interval has their
common prefix, and its left comparison their common left context. Groups are maximal within the run of their anchor, so a
longer repeat comes as several groups that overlap.

Hot groups: rows with the same text are represented by one of them; if such a text has ``length`` bytes or
more, all of it is a repeat. Of equal runs in one chunk of text one travels, as all are repeats. A bucket's task
does the same with what it holds, and hands on, window by window, what differs and still is too much (``hot``).

Edge cases: a null or short text has no windows; texts may hold any bytes, NUL included; rows that repeat a doc_id are
separate texts; a null doc_id is a text like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm import hot
from tidalframe.llm.common import document_texts, lean, partitions, prepare, slices
from tidalframe.llm.textbytes import column_bytes, gather, minimisers, mix, powers, range_hashes, same_ranges

LENGTH = 200
SEED = 20
CUT_BYTES = 2 << 20
BUCKET_BYTES = 768 << 10
_BASE = 0xBF58476D1CE4E5B9
_NONE = -(1 << 63)


def gram_hashes(data: np.ndarray, width: int, step: int = 1 << 19) -> np.ndarray:
    """Hashes of all ``width`` consecutive bytes."""
    n = len(data) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    for lo in range(0, max(0, n), step):
        part = data[lo : min(len(data), lo + step + width - 1)].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=sums[1:])
        k = len(part) - width + 1
        out[lo : lo + k] = mix((sums[width:] - sums[:-width]) * powers(inverse, k))
    return out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED, grams: np.ndarray | None = None):
    """First byte, end, anchor and bucket hash of each run of windows with one anchor; ``grams``: their hashes, where known."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    grams = gram_hashes(data, seed) if grams is None else grams
    anchor = minimisers(grams, length - seed + 1)
    room = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(room, offsets[:-1], 1)
    row = np.cumsum(room)[:-1] - 1
    inside = row[:n] == row[length - 1 :]
    change = np.ones(n, dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])
    last = np.ones(n, dtype=bool)
    last[:-1] = change[1:] | ~inside[1:]
    first = np.flatnonzero(change & inside)
    at = anchor[first]
    return first, np.flatnonzero(last & inside) + length, at, grams[at]


def _pack(docs, marks, pos, anchor, data, offsets) -> bytes:
    head = np.array([len(docs)], dtype=np.int64)
    parts = (head, docs.astype(np.int64), marks.astype(np.int64), pos.astype(np.int32), anchor.astype(np.int32), np.diff(offsets).astype(np.int32), data)
    return zstandard.ZstdCompressor(level=5).compress(b"".join(x.tobytes() for x in parts))


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, -1, at)]


def equals(key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that equal another one, and those among them but for one of each kind; ``key`` hashes them."""
    order = np.argsort(key, kind="stable")
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    some, by = order[~opens], lead[~opens]
    sizes = ends[some] - starts[some]
    good = (sizes == ends[by] - starts[by]) & same_ranges(data, starts[some], starts[by], sizes)
    twice, more = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    more[some[good]] = True
    twice[some[good]] = twice[by[good]] = True
    return twice, more


def _cut(length: int, seed: int, buckets: int, thin: bool = True):
    """Blocks of runs by bucket; with ``thin``, of equal runs only one, and the spans of all of them in a block apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CUT_BYTES):
            data, offsets = column_bytes(part.column("text"))
            grams = gram_hashes(data, seed)
            first, end, anchor, hashes = anchored_runs(data, offsets, length, seed, grams)
            if not len(first):
                continue
            row = np.searchsorted(offsets, first, side="right") - 1
            docs = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
            marks = part.column("th").to_numpy(zero_copy_only=False)[row]
            pos = first - offsets[row]
            key = mix(hashes ^ mix(grams[first] + np.uint64(1)) ^ mix(grams[end - seed] + np.uint64(2)) ^ ((end - first) << 20 | (anchor - first)).astype(np.uint64))
            twice, more = equals(key, data, first, end)
            if thin and twice.any():  # found already: these go along in a bucket of their own
                at, upto = hot.joined(row[twice], pos[twice], (pos + end - first)[twice])
                block = _pack(docs[twice][at], marks[twice][at], pos[twice][at], np.zeros(len(at)), np.zeros(0, dtype=np.uint8), np.concatenate([[0], np.cumsum(upto)]))
                yield pa.RecordBatch.from_arrays([pa.array([buckets + int(hashes[0] % np.uint64(buckets))], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])
                first, end, anchor, hashes, docs, marks, pos = (x[~more] for x in (first, end, anchor, hashes, docs, marks, pos))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            first, end, anchor, bucket, docs, marks, pos = (x[by] for x in (first, end, anchor, bucket, docs, marks, pos))
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            blocks = [_pack(docs[a:b], marks[a:b], pos[a:b], anchor[a:b] - first[a:b], *gather(data, first[a:b], end[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return run


def _grid(data: np.ndarray, start: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on, forwards or backwards, zero beyond ``sizes``."""
    at = np.arange(width)[None, :]
    where = np.clip(start[:, None] + step * at, 0, max(0, len(data) - 1))
    return np.where(at < sizes[:, None], data[where], 0).astype(np.uint8)


def _order(grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the rows as strings of the given sizes. Padding looks like NUL bytes, so shorter ones come first."""
    short = np.argsort(sizes, kind="stable")
    return short[np.argsort(np.ascontiguousarray(grid).view(f"S{grid.shape[1]}").ravel()[short], kind="stable")]


def _common(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, ``m`` at most."""
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, m)


def prefix_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(prefix, first, last) of the common-prefix intervals of a suffix array, by a stack scan.

    ``lcp[i]`` is the common prefix of suffixes i and i + 1. Inner intervals come first; only
    those with a prefix of at least ``least`` are listed.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), 0]):
        low = i
        while stack and stack[-1][0] > value:
            top, low = stack.pop()
            if top >= least:
                out.append((top, low, i))
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, low))
    return out


class Suffixes:
    """The suffix array of packed runs from their anchors on, where an anchor occurs twice, and its interval tree.

    ``rows``: the runs, in the order of their suffixes; ``lcp``: what neighbours have in common; ``left``: the bytes
    before each anchor, backwards; ``rank``: their order.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, length: int, seed: int):
        n = len(anchor)
        place = offsets[:-1] + anchor
        grams = _grid(data, place, np.full(n, seed), seed, 1)
        order = _order(grams, np.full(n, seed))
        same = (grams[order[1:]] == grams[order[:-1]]).all(axis=1)
        some = np.zeros(n, dtype=bool)
        some[order[1:][same]] = some[order[:-1][same]] = True
        rows = np.flatnonzero(some)
        ahead = np.minimum(offsets[1:][rows] - place[rows], length)
        behind = anchor[rows].astype(np.int64)
        right = _grid(data, place[rows], ahead, length, 1)
        order = _order(right, ahead)
        right, self.rows, ahead, self.behind = right[order], rows[order], ahead[order], behind[order]
        self.lcp = _common(right[1:], right[:-1], np.minimum(ahead[1:], ahead[:-1]))
        del right
        self.left = _grid(data, place[self.rows] - 1, self.behind, length - seed, -1)
        self.rank = np.empty(len(rows), dtype=np.int64)
        self.rank[_order(self.left, self.behind)] = np.arange(len(rows))
        self.intervals = prefix_intervals(self.lcp, seed) if len(rows) else []

    def common_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _common(self.left[a], self.left[b], np.minimum(self.behind[a], self.behind[b]))

    def by_left(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of an interval by left context, and what neighbours have in common there."""
        group = lo + np.argsort(self.rank[lo : hi + 1])
        return group, self.common_left(group[1:], group[:-1])


def maximal_groups(tree: Suffixes, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes left of the anchor, bytes from the anchor on, runs) of each maximal repeat of ``length`` bytes or more."""
    for prefix, lo, hi in tree.intervals:
        group, common = tree.by_left(lo, hi)
        inner = prefix_intervals(common, max(1, length - prefix))
        if prefix >= length and (not len(common) or common.min() == 0):
            inner.append((0, 0, len(group) - 1))  # nothing in common to the left
        for reach, a, b in inner:
            some = group[a : b + 1]  # left-diverse: the next byte to the left differs, or a run begins
            first, last = some.min(), some.max()
            if tree.lcp[first:last].min() == prefix:  # right-diverse: no longer prefix holds all of them
                yield reach, prefix, tree.rows[some]


def repeat_extents(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """How far the maximal repeats of ``length`` bytes reach left and right of each run's anchor (0, 0: none)."""
    n = len(anchor)
    best_left, best_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    tree = Suffixes(data, offsets, anchor, length, seed)
    found_left, found_right = np.zeros(len(tree.rows), dtype=np.int64), np.zeros(len(tree.rows), dtype=np.int64)
    pairs = np.array([x for x in tree.intervals if x[2] - x[1] == 1], dtype=np.int64).reshape(-1, 3)
    if len(pairs):
        p, a, b = pairs.T
        reach = tree.common_left(a, b)
        good = reach + p >= length
        for side in (a[good], b[good]):
            np.maximum.at(found_left, side, reach[good])
            np.maximum.at(found_right, side, p[good])
    for prefix, lo, hi in tree.intervals:
        if hi - lo == 1:
            continue
        group, common = tree.by_left(lo, hi)
        reach = np.concatenate([[0], common, [0]])
        reach = np.maximum(reach[1:], reach[:-1])  # of the innermost left-diverse group of each
        good = reach + prefix >= length
        at = group[good]
        found_left[at] = np.maximum(found_left[at], reach[good])
        found_right[at] = np.maximum(found_right[at], prefix)
    best_left[tree.rows], best_right[tree.rows] = found_left, found_right
    return best_left, best_right


class _Held:
    """Runs of a bucket."""

    def __init__(self, blocks: list[bytes]):
        parts = [_unpack(b) for b in blocks]
        self.docs, self.marks, self.pos, self.anchor, sizes, self.data = (np.concatenate([p[k] for p in parts]) for k in range(6))
        self.offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=self.offsets[1:])

    def found(self, length: int, seed: int) -> pa.RecordBatch:
        left, right = repeat_extents(self.data, self.offsets, self.anchor, length, seed)
        on = np.flatnonzero(right)
        at = self.pos[on].astype(np.int64) + self.anchor[on]
        return hot.spans(self.docs[on], self.marks[on], at - left[on], at + right[on])

    def thinned(self) -> tuple[pa.RecordBatch, bytes]:
        """Spans of the runs that equal another, and what is left with one of each kind."""
        starts, ends = self.offsets[:-1], self.offsets[1:]
        twice, more = equals(range_hashes(self.data, starts, ends) ^ mix(self.anchor.astype(np.uint64)), self.data, starts, ends)
        out = hot.spans(self.docs[twice], self.marks[twice], self.pos[twice], self.pos[twice] + (ends - starts)[twice])
        keep = ~more
        return out, _pack(self.docs[keep], self.marks[keep], self.pos[keep], self.anchor[keep], *gather(self.data, starts[keep], ends[keep]))

    def windows(self, length: int) -> Iterator[pa.RecordBatch]:
        """All windows, to be handed on."""
        base, other = 0xD1342543DE82EF95, 0xDA942042E4DD58B5
        for lo in range(0, len(self.docs), 4096):
            hi = min(len(self.docs), lo + 4096)
            edges = self.offsets[lo : hi + 1] - self.offsets[lo]
            data = self.data[self.offsets[lo] : self.offsets[hi]].astype(np.uint64) + np.uint64(1)
            n = len(data) - length + 1
            row = np.searchsorted(edges, np.arange(max(0, n)), side="right") - 1
            at = np.flatnonzero(edges[row + 1] - np.arange(max(0, n)) >= length)
            hashes = []
            for b in (base, other):
                sums = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(data * powers(b, len(data)), out=sums[1:])
                hashes.append(mix((sums[at + length] - sums[at]) * powers(pow(b, -1, 1 << 64), len(data))[at]))
            r = row[at]
            yield hot.hand_on(*hashes, self.docs[lo + r], self.marks[lo + r], self.pos[lo + r] + at - edges[r])


def _twice(docs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows that aren't alone in their group."""
    return np.bincount(group)[group] > 1


def _find(length: int, seed: int, buckets: int, hold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in hot.by_key(batches, "bucket"):
            if bucket >= buckets:
                for block in blocks:
                    docs, marks, pos, _, ends, _ = _unpack(block)
                    yield hot.spans(docs, marks, pos, ends)
                continue
            held, size, over = [], 0, False
            for block in blocks:
                held.append(block)
                size += zstandard.frame_content_size(block)
                if size > hold:
                    out, rest = _Held(held).thinned()
                    yield out
                    held, size = [rest], zstandard.frame_content_size(rest)
                    if size > hold // 2:
                        yield from _Held(held).windows(length)
                        held, size, over = [], 0, True
            if held and over:
                yield from _Held(held).windows(length)
            elif held:
                yield _Held(held).found(length, seed)

    return run


def _list(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in hot.by_key(batches, "bucket"):
            have = _Held(list(blocks))
            for reach, prefix, runs in maximal_groups(Suffixes(have.data, have.offsets, have.anchor, length, seed), length):
                at = have.offsets[runs[0]] + have.anchor[runs[0]]
                name = hashlib.sha256(have.data[at - reach : at + prefix].tobytes()).hexdigest()
                start = have.pos[runs].astype(np.int64) + have.anchor[runs] - reach
                columns = [pa.array([name] * len(runs)), pa.array(np.full(len(runs), reach + prefix)), pa.array(have.docs[runs]), pa.array(have.marks[runs]), pa.array(start)]
                yield pa.RecordBatch.from_arrays(columns, names=["repeat", "n_bytes", "doc_id", "text_hash", "start"])

    return run


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            spans, whole = part.column("spans").to_pylist(), part.column("whole").to_pylist()
            sizes, removed, runs, sums, kept = [], [], [], [], []
            for i, text in enumerate(part.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                cuts: list[list[int]] = []
                if whole[i] and len(raw) >= length:
                    cuts = [[0, len(raw)]]
                else:
                    for s, e in sorted((x["s"], x["e"]) for x in spans[i] or ()):
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], e)
                        else:
                            cuts.append([s, e])
                left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)], strict=True))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(len(cuts))
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(sums, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run


def maximal_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per occurrence of a maximal repeat of ``length`` bytes or more: repeat (SHA-256 of its bytes), n_bytes, doc_id,
    text_hash, start. Rows with one doc_id and text count once; a bucket is held by one task here, hot or not."""
    prepare(docs.sparkSession)
    given = document_texts(docs).withColumn("th", F.xxhash64("text")).select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), "th", "text")
    buckets = partitions(given, BUCKET_BYTES)
    sent = given.where("text IS NOT NULL").groupBy("doc_id", "th").agg(F.min("text").alias("text"))
    blocks = sent.mapInArrow(lean(_cut(length, seed, buckets, thin=False)), "bucket int, block binary")
    groups = blocks.repartition(partitions(given, 6 << 20), "bucket").sortWithinPartitions("bucket")
    found = groups.mapInArrow(lean(_list(length, seed)), "repeat string, n_bytes long, doc_id long, text_hash long, start long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NONE, F.col("doc_id")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in
    the same text or another. Two exchanges carry text: the documents (one exchange, read twice)
    and the anchored runs.
    """
    prepare(docs.sparkSession)
    given = document_texts(docs).withColumn("th", F.xxhash64("text"))  # tells rows of one doc_id apart, and spreads them
    given = given.select(F.coalesce("doc_id", F.lit(_NONE)).alias("did"), "th", "text")
    p = partitions(given, 6 << 20)
    buckets = partitions(given, BUCKET_BYTES)
    classes = given.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha"), "th").agg(F.min("did").alias("rep"), F.count("text").alias("c"))
    leads = classes.groupBy("rep", F.col("th").alias("lead_th")).agg(F.max("c").alias("c"))
    rows = given.repartition(p, "did", "th")
    rows = rows.join(leads, (rows["did"] == leads["rep"]) & (rows["th"] == leads["lead_th"]), "left")
    rows = rows.withColumn("copy", F.col("rep").isNull()).withColumn("whole", F.col("copy") | (F.col("c") > 1))
    sent = rows.select(F.col("did").alias("doc_id"), "th", F.when(~F.col("copy"), F.col("text")).alias("text"))  # no filter: it would sink below the exchange
    blocks = sent.mapInArrow(lean(_cut(length, seed, buckets)), "bucket int, block binary")
    found = blocks.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_find(length, seed, buckets, hot.HOLD_BYTES)), hot.FOUND)
    by_doc = hot.merged(found, p, length, _twice)
    joined = rows.join(by_doc, (rows["did"] == by_doc["of"]) & (rows["th"] == by_doc["of_th"]), "left")
    joined = joined.select(F.when(F.col("did") != _NONE, F.col("did")).alias("doc_id"), "text", "whole", "spans")
    return joined.mapInArrow(lean(_keep(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
