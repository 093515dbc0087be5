"""Hot buckets: windows of a bucket too large for one task, dealt once more by their own hash.

A bucket's task hands on what it cannot hold, window by window: two 64-bit hashes, document, text mark and
position. Equal windows meet again in one of ``SUBS`` smaller buckets, and nothing else needs to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import lean

#: Bytes of a bucket that a task holds before it thins them out, and hands them on where that doesn't help.
HOLD_BYTES = 48 << 20
SUBS = 1 << 14
#: What a bucket's task returns: spans, or blocks of windows for another bucket.
FOUND = "doc_id long, th long, s int, e int, sub int, block binary"

_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("pos", "<i4")])


def spans(docs: np.ndarray, marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Found spans in the form of ``FOUND``."""
    columns = [pa.array(docs.astype(np.int64)), pa.array(marks.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())], names=["doc_id", "th", "s", "e", "sub", "block"])


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of overlapping spans of one row, in order: the first of each, and its end."""
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(first)
    return at, end[np.append(at[1:], len(row)) - 1] if len(at) else end[:0]


def hand_on(a: np.ndarray, b: np.ndarray, docs: np.ndarray, marks: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Windows by their two hashes, as blocks for the second round of buckets."""
    rows = np.empty(len(a), dtype=_WINDOW)
    rows["a"], rows["b"], rows["doc"], rows["th"], rows["pos"] = a, b, docs, marks, pos
    sub = (a % np.uint64(SUBS)).astype(np.int32)
    order = np.argsort(sub, kind="stable")
    rows, sub = rows[order], sub[order]
    edges = [0, *(np.flatnonzero(sub[1:] != sub[:-1]) + 1).tolist(), len(sub)] if len(sub) else [0]
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = [press(rows[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    none = [pa.nulls(len(blocks), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays([*none, pa.array(sub[edges[:-1]]), pa.array(blocks, pa.binary())], names=["doc_id", "th", "s", "e", "sub", "block"])


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each key of rows sorted by it, with its blocks."""
    rows = ((k, b) for batch in batches for k, b in zip(batch.column(key).to_pylist(), batch.column("block").to_pylist(), strict=True))
    last = next(rows, None)

    def run() -> Iterator[bytes]:
        nonlocal last
        mine = last[0]
        while last is not None and last[0] == mine:
            yield last[1]
            last = next(rows, None)

    while last is not None:
        now = last[0]
        blocks = run()
        yield now, blocks
        for _ in blocks:  # what the caller left
            pass


def repeated_windows(width: int, flag: Callable[[np.ndarray, np.ndarray], np.ndarray], hold: int):
    """Spans as they come, and those of the windows that ``flag`` picks from rows sorted by hash, given the group of each.

    Where a bucket is larger than a task holds, rows that are decided, but for one of each window, are dropped.
    """
    names = ["doc_id", "th", "s", "e"]

    def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["b"], rows["a"]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
        return rows, np.cumsum(new) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def windows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                span = pc.is_null(batch.column("sub"))
                known.append(batch.filter(span).select(names))
                yield batch.filter(pc.invert(span))

        for _, blocks in by_key(windows(), "sub"):
            held, size = [], 0
            for block in blocks:
                held.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=_WINDOW))
                size += held[-1].nbytes
                if size > hold:
                    rows, group = settle(np.concatenate(held))
                    hit = flag(rows["doc"], group)
                    yield spans(rows["doc"][hit], rows["th"][hit], rows["pos"][hit], rows["pos"][hit] + width).select(names)
                    first = np.ones(len(rows), dtype=bool)
                    first[1:] = group[1:] != group[:-1]
                    held = [rows[~hit | first]]  # one of each window, and those not decided yet
                    size = held[0].nbytes // 2
            if held:
                rows, group = settle(np.concatenate(held))
                hit = flag(rows["doc"], group)
                yield spans(rows["doc"][hit], rows["th"][hit], rows["pos"][hit], rows["pos"][hit] + width).select(names)
        yield from known

    return run


def merged(found: DataFrame, p: int, width: int, flag: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(of, of_th, spans): all spans of each document, from rows in the form of ``FOUND``.

    One exchange brings spans to their documents' place and windows to theirs, so nothing is computed twice.
    """
    dealt = found.repartition(p, F.coalesce(F.col("sub").cast("long"), F.xxhash64("doc_id", "th"))).sortWithinPartitions("sub")
    spans = dealt.mapInArrow(lean(repeated_windows(width, flag, HOLD_BYTES)), "doc_id long, th long, s int, e int")
    return spans.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
