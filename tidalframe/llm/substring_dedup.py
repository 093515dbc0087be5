"""Substring deduplication by super-k-mers.

Each document's windows of ``width`` words are cut into super-k-mers: runs of consecutive windows
that share their minimiser, the ``seed``-word gram of least hash. A super-k-mer travels as one packed string to the
bucket of its minimiser, so equal windows meet in one bucket; there sorting groups the windows
exactly (hashes order them, bytes confirm them). All that one chunk of text sends to a bucket is
one compressed block.

Hot groups: documents with the same text are represented by the smallest doc_id, so a text that a third of
all rows share is cut once. Of equal super-k-mers in one chunk only those of the smallest doc_id travel; the others
are repeats for certain. A bucket's task does the same with what it holds, so a passage in any number of documents takes
little room; what differs and still is too much is dealt once more, window by window (``hot``). The long words win the
minimiser order, which keeps very common short words from drawing a bucket to themselves.

Edge cases: a null text has no words; a row with a null doc_id is returned unchanged and counts
for nothing; rows that repeat a doc_id with the same or another text are judged row by row, and
never against their own doc_id; an empty table gives an empty result; other columns are ignored.
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
from tidalframe.llm.textbytes import Words, gather, minimisers, mix, powers, range_hashes, same_ranges, sliding, window_hashes

WIDTH = 13
SEED = 2
#: Words of at most this many bytes yield to longer ones as minimisers.
SHORT = 5
#: Bytes of text whose super-k-mers are sent together.
CUT_BYTES = 3 << 20
#: Bytes of the table for each bucket; a bucket is sorted in one go.
BUCKET_BYTES = 768 << 10


def super_kmers(words: Words, width: int = WIDTH, seed: int = SEED, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and bucket of each super-k-mer; ``hashes`` of the words, where known."""
    none = np.zeros(0, dtype=np.int64)
    n = len(words) - width + 1
    if n <= 0:
        return none, none, none.astype(np.uint64)
    grams = window_hashes(words.hashes() if hashes is None else hashes, seed)
    size = words.end - words.start
    short = sliding(size, seed, np.maximum) <= SHORT
    order = (grams >> np.uint64(1)) | (short.astype(np.uint64) << np.uint64(63))
    least = minimisers(order, width - seed + 1)
    inside = words.row[:n] == words.row[width - 1 :]
    change = np.ones(n, dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (words.row[1:n] != words.row[: n - 1])
    opens = np.flatnonzero(change & inside)
    lasts = np.ones(n, dtype=bool)
    lasts[:-1] = change[1:] | ~inside[1:]
    closes = np.flatnonzero(lasts & inside)
    return opens, closes + width - 1, grams[least[opens]]


def pack(docs: np.ndarray, marks: np.ndarray, pos: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> bytes:
    """One compressed block of super-k-mers."""
    head = np.array([len(docs)], dtype=np.int64)
    parts = (head, docs.astype(np.int64), marks.astype(np.int64), pos.astype(np.int32), np.diff(offsets).astype(np.int32), data)
    return zstandard.ZstdCompressor(level=5).compress(b"".join(x.tobytes() for x in parts))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``pack`` was given, with sizes instead of offsets."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8
    out = []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out[0], out[1], out[2], out[3], np.frombuffer(raw, np.uint8, -1, at)


def surplus(words: Words, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each super-k-mer equals one of a smaller doc_id among those given."""
    base = 0x9FB21C651E98DF25
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    key = mix((sums[last + 1] - sums[first]) * powers(pow(base, -1, 1 << 64), len(hashes))[first] + (last - first).astype(np.uint64))
    order = np.lexsort((docs, key))
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    hit = docs[order] > docs[lead]
    some, by = order[hit], lead[hit]
    out = np.zeros(len(first), dtype=bool)
    a, b = words.start[first[some]], words.start[first[by]]
    sizes = words.end[last[some]] - a
    out[some] = (sizes == words.end[last[by]] - b) & same_ranges(words.data, a, b, sizes)
    return out


def _cut(width: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CUT_BYTES):
            words = Words(part.column("text"))
            own = words.hashes()
            first, last, hashes = super_kmers(words, width, seed, own)
            if not len(first):
                continue
            row = words.row[first]
            docs = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
            marks = part.column("th").to_numpy(zero_copy_only=False)[row]
            pos = first - words.first[row]
            gone = surplus(words, own, first, last, docs)
            if gone.any():  # found already: these go along in a bucket of their own
                at, end = hot.joined(row[gone], pos[gone], (pos + last - first + 1)[gone])
                block = pack(docs[gone][at], marks[gone][at], pos[gone][at], np.zeros(0, dtype=np.uint8), np.concatenate([[0], np.cumsum(end)]))
                yield pa.RecordBatch.from_arrays([pa.array([buckets + int(hashes[0] % np.uint64(buckets))], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])
                first, last, hashes, docs, marks, pos = (x[~gone] for x in (first, last, hashes, docs, marks, pos))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            first, last, bucket, docs, marks, pos = (x[by] for x in (first, last, bucket, docs, marks, pos))
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            blocks = [pack(docs[a:b], marks[a:b], pos[a:b], *gather(words.data, words.start[first[a:b]], words.end[last[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return run


def packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and super-k-mer of each word of packed super-k-mers."""
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[offsets] = True
    blank = data == 0x20
    starts = np.flatnonzero(~blank & (opens[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (opens[1:] | np.concatenate([blank[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def repeated(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a smaller doc_id holds too: super-k-mer, first window, windows.

    ``docs`` is ascending; ``data`` and ``offsets`` hold the packed super-k-mers.
    """
    starts, ends, row = packed_words(data, offsets)
    hashes = window_hashes(range_hashes(data, starts, ends), width)
    n = len(hashes)
    spots = np.flatnonzero(row[:n] == row[width - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    if not len(spots):
        return spots, spots, spots
    hashes = hashes[spots]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    where = np.flatnonzero(head)
    lead = order[where[np.cumsum(head) - 1]]  # the first of the group: the smallest doc_id
    again = docs[row[spots[order]]] > docs[row[spots[lead]]]
    hit, by = order[again], lead[again]
    a, b = starts[spots[hit]], starts[spots[by]]
    sizes = ends[spots[hit] + width - 1] - a
    same = (sizes == ends[spots[by] + width - 1] - b) & same_ranges(data, a, b, sizes)
    flag = np.zeros(len(spots), dtype=bool)
    flag[hit[same]] = True
    for h in np.unique(hashes[hit[~same]]):  # one hash, several windows: compare the strings
        least: dict[bytes, int] = {}
        for i in np.flatnonzero(hashes == h):
            w = spots[i]
            text = data[starts[w] : ends[w + width - 1]].tobytes()
            flag[i] = docs[row[w]] > least.setdefault(text, docs[row[w]])
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on, on
    split = np.ones(len(on), dtype=bool)
    split[1:] = (spots[on[1:]] != spots[on[:-1]] + 1) | (row[spots[on[1:]]] != row[spots[on[:-1]]])
    begin = on[split]
    count = np.diff(np.append(np.flatnonzero(split), len(on)))
    r = row[spots[begin]]
    return r, spots[begin] - np.searchsorted(starts, offsets[r]), count


class _Held:
    """Super-k-mers of a bucket, by ascending doc_id."""

    def __init__(self, blocks: list[bytes]):
        parts = [unpack(b) for b in blocks]
        ids, marks, pos, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
        data = np.concatenate([p[4] for p in parts])
        offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        by = np.argsort(ids, kind="stable")
        self.ids, self.marks, self.pos = ids[by], marks[by], pos[by]
        self.data, self.offsets = gather(data, offsets[:-1][by], offsets[1:][by])

    def found(self, width: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of repeated windows, and those windows as runs."""
        r, first, n = repeated(self.ids, self.data, self.offsets, width)
        start = self.pos[r].astype(np.int64) + first
        return hot.spans(self.ids[r], self.marks[r], start, start + n + width - 1), r, first, n

    def rest(self, r: np.ndarray, n: np.ndarray, width: int) -> bytes:
        """The super-k-mers that aren't repeats as a whole, packed."""
        words = np.bincount(packed_words(self.data, self.offsets)[2], minlength=len(self.ids))
        keep = np.bincount(r, n, minlength=len(self.ids)) < words - width + 1
        return pack(self.ids[keep], self.marks[keep], self.pos[keep], *gather(self.data, self.offsets[:-1][keep], self.offsets[1:][keep]))

    def windows(self, width: int) -> pa.RecordBatch:
        """All windows, to be handed on."""
        starts, ends, row = packed_words(self.data, self.offsets)
        own = range_hashes(self.data, starts, ends)
        a, b = window_hashes(own, width), window_hashes(mix(own ^ np.uint64(0x2545F4914F6CDD1D)), width)
        at = np.flatnonzero(row[: len(a)] == row[width - 1 :])
        r = row[at]
        return hot.hand_on(a[at], b[at], self.ids[r], self.marks[r], self.pos[r] + at - np.searchsorted(starts, self.offsets[r]))


def _count(width: int, buckets: int, hold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in hot.by_key(batches, "bucket"):
            if bucket >= buckets:
                for block in blocks:
                    ids, marks, pos, ends, _ = unpack(block)
                    yield hot.spans(ids, marks, pos, ends)
                continue
            held, size, over = [], 0, False
            for block in blocks:
                held.append(block)
                size += zstandard.frame_content_size(block)
                if size > hold:
                    have = _Held(held)
                    out, r, _, n = have.found(width)
                    yield out
                    rest = have.rest(r, n, width)
                    held, size = [rest], zstandard.frame_content_size(rest)
                    if size > hold // 2:
                        yield _Held(held).windows(width)
                        held, size, over = [], 0, True
            if held:
                have = _Held(held)
                yield have.windows(width) if over else have.found(width)[0]

    return run


def _later(docs: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows of a larger doc_id than the first of their group."""
    return docs > docs[np.searchsorted(group, group)]


def _keep():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, sums, n_words, n_removed = part.column("doc_id"), [], [], []
            cover, whole = part.column("spans").to_pylist(), part.column("whole").to_pylist()
            kept_texts = []
            for i, text in enumerate(part.column("text")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                gone = np.zeros(len(words), dtype=bool)
                if whole[i] is not None and len(words) >= whole[i]:
                    gone[:] = True
                for span in cover[i] or ():
                    gone[span["s"] : span["e"]] = True
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller doc_id. Two exchanges carry text: the documents (one exchange, read twice)
    and the super-k-mers by minimiser.
    """
    prepare(docs.sparkSession)
    given = document_texts(docs).withColumn("th", F.xxhash64("text"))  # tells rows of one doc_id apart, and spreads them
    p = partitions(given, 6 << 20)
    buckets = partitions(given, BUCKET_BYTES)
    classes = given.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha"), "th").agg(F.min("doc_id").alias("rep"))
    leads = classes.select("rep", F.col("th").alias("lead_th")).distinct()
    rows = given.repartition(p, "doc_id", "th")
    rows = rows.join(leads, (rows["doc_id"] == leads["rep"]) & (rows["th"] == leads["lead_th"]), "left").withColumn("copy", F.col("rep").isNull())
    sent = rows.select("doc_id", "th", F.when(~F.col("copy"), F.col("text")).alias("text"))  # no filter: it would sink below the exchange
    blocks = sent.mapInArrow(lean(_cut(width, seed, buckets)), "bucket int, block binary")
    found = blocks.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_count(width, buckets, hot.HOLD_BYTES)), hot.FOUND)
    by_doc = hot.merged(found, p, width, _later)
    whole = F.when(F.col("copy") & F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.lit(width)).alias("whole")
    joined = rows.join(by_doc, (rows["doc_id"] == by_doc["of"]) & (rows["th"] == by_doc["of_th"]), "left").select("doc_id", "text", whole, "spans")
    return joined.mapInArrow(lean(_keep()), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
