"""Token ids as fixed-width bit-packed files.

``write`` range-sorts the documents by doc_id, encodes whole texts with a ``tokenizers`` file and
writes one binary file per task; ``read_documents`` reads them back. Layout of a file:

    blocks   each of at most ``BLOCK`` ids, an id in the fewest bits that hold the vocabulary,
             first id in the lowest bits, padded to a whole byte
    footer   doc_id int64 and null flag uint8 of each document, end of each document in ids int64,
             byte offset of each block int64
    tail     documents, ids, blocks, bits, block size as int64, then the magic bytes

A block's place is known from its offset and unpacks by itself in numpy, so any range of ids can be
read without the rest. A task attempt writes a name of its own and only what the successful attempts report is listed in the
manifest, so a lost executor leaves no half-written file in use.

Encoding is exact, and cheap where words repeat: each distinct piece of a word is encoded once per
worker (a bounded cache) and the ids of its occurrences are gathered.

Edge cases: a null or empty text has the end id only; documents with a null doc_id come first;
rows that repeat a doc_id are ordered by text; an empty table has no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import document_texts, lean, materialise, partitions, prepare, scratch_dir, slices
from tidalframe.llm.textbytes import column_bytes, gather, range_hashes, same_ranges

BLOCK = 1 << 16
MAGIC = b"TIDALIDS"
#: Pieces that a worker remembers; beyond that it starts afresh.
MOST_PIECES = 1_500_000


def _files(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, the first in the lowest bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class _Lists:
    """Growing lists of ids, one after another."""

    def __init__(self):
        self.ids, self.ends, self.count = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Lists of ``sizes``, whose ids follow each other in ``ids``."""
        end = int(self.ends[self.count])
        while len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) <= self.count + len(sizes):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[end : end + len(ids)] = ids
        self.ends[self.count + 1 : self.count + len(sizes) + 1] = end + np.cumsum(sizes)
        self.count += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some lists, and their offsets."""
        return gather(self.ids, self.ends[which], self.ends[which + 1])


#: Byte classes of texts in ASCII and the Latin-1 letters: white space, letter, digit, other.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
#: Bytes that make their word one for the tokenizer's own normalizer: control characters, apostrophes, other scripts.
_HARD = np.zeros(256, dtype=bool)
_HARD[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x7F, *range(0x80, 0x100)]] = True
_HARD_MARK = np.uint64(0x5851F42D4C957F2D)


class Encoder:
    """Ids of many texts at once, pre-token by pre-token.

    White space parts pre-tokens, so a text's ids are those of its words one after another. Words of ASCII and Latin-1
    letters are lower-cased and cut into letter runs, digits and other runs here, as the
    tokenizer's normalizer and pre-tokenizer do; words with anything else are left whole. Each distinct piece is
    encoded by the tokenizer once and remembered, and confirmed byte by byte when met again.
    ``whole`` says that the tokenizer is of another kind; then every text is encoded as it is.
    """

    PRE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.whole = not (kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": self.PRE} and steps[0].get("behavior") == "Removed")
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pool, self.place = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids = _Lists()

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, start and end of each piece, and whether it is a word left whole."""
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.concatenate([[np.uint8(0)], data[:-1]])
        after_c3 = before == 0xC3
        hard = _HARD[data] & ~(data == 0xC3) & ~(after_c3 & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
        hard[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # the special tokens begin so
        upper = ((data >= 0x41) & (data <= 0x5A)) | (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
        kind = _CLASS[data]
        solid = kind != 0
        kind_before = np.concatenate([[np.uint8(0)], kind[:-1]])
        word = solid & ((kind_before == 0) | first[:n])
        word_start = np.flatnonzero(word)
        ends = np.flatnonzero(solid & (np.concatenate([kind[1:] == 0, [True]]) | first[1:])) + 1
        which = np.unique(np.searchsorted(word_start, np.flatnonzero(hard), side="right") - 1)
        cut = solid & (word | (kind != kind_before) | (kind == 2))
        if len(which):  # whole words keep only their first cut
            edge = np.zeros(n + 1, dtype=np.int8)
            edge[word_start[which]] += 1
            edge[ends[which]] -= 1
            cut &= ~(np.cumsum(edge[:n]) > 0) | word
        start = np.flatnonzero(cut)
        owner = np.searchsorted(word_start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], n), ends[owner])
        odd = np.isin(owner, which)
        low = np.where(upper, data + np.uint8(32), data)
        if len(which):
            keep = np.zeros(n + 1, dtype=np.int8)
            keep[word_start[which]] += 1
            keep[ends[which]] -= 1
            low = np.where(np.cumsum(keep[:n]) > 0, data, low)
        return low, start, end, odd

    def _learn(self, texts: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and the number of each one's ids."""
        sizes = np.zeros(len(texts), dtype=np.int64)
        parts: list[np.ndarray] = []
        plain = np.flatnonzero(~odd)
        for lo in range(0, len(plain), 4000):
            some = [texts[k].decode() for k in plain[lo : lo + 4000].tolist()]
            begins = np.cumsum([0, *(len(x) + 1 for x in some[:-1])])
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner = np.searchsorted(begins, np.fromiter((a for a, _ in done.offsets), dtype=np.int64), side="right") - 1
            sizes[plain[lo : lo + 4000]] = np.bincount(owner, minlength=len(some))
            parts.append(np.array(done.ids, dtype=np.uint32))
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])
        rest = np.flatnonzero(odd).tolist()
        if rest:
            lists = [x.ids for x in self.tokenizer.encode_batch([texts[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)]
            at = np.cumsum(sizes)[rest]
            sizes[rest] = [len(x) for x in lists]
            ids = np.insert(ids, np.repeat(at, [len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.uint32))
        return ids, sizes

    def _directly(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.tokenizer.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in lists for i in x], dtype=np.uint32), np.array([len(x) for x in lists], dtype=np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts one after another, and the number of each text's ids."""
        data, offsets = column_bytes(column)
        rows = len(offsets) - 1
        if self.whole:
            return self._directly(column)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(rows, dtype=np.int64)
        low, start, end, odd = self._pieces(data, offsets)
        hashes = range_hashes(low, start, end)
        hashes = np.where(odd, hashes ^ _HARD_MARK, hashes)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MOST_PIECES:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        known = self.keys[spot] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        new = np.flatnonzero(~known)
        if len(new):
            a, b = start[at[new]], end[at[new]]
            bytes_, edges = gather(low, a, b)
            raw = bytes_.tobytes()
            ids, sizes = self._learn([raw[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], odd[at[new]])
            slots = self.ids.count + np.arange(len(new))
            self.ids.add(ids, sizes)
            self.place = np.concatenate([self.place, self.place[-1] + edges[1:]])
            self.pool = np.concatenate([self.pool, bytes_])
            into = np.searchsorted(self.keys, unique[new])
            self.keys, self.slot = np.insert(self.keys, into, unique[new]), np.insert(self.slot, into, slots)
        slot = self.slot[np.searchsorted(self.keys, unique)][back]
        both = np.concatenate([self.pool, low])
        same = (self.place[slot + 1] - self.place[slot] == end - start) & same_ranges(both, self.place[slot], start + len(self.pool), end - start)
        if not same.all():  # two pieces of one hash
            return self._directly(column)
        ids, edges = self.ids.take(slot)
        first = np.searchsorted(start, offsets)
        return ids, np.diff(edges[first])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, path: str, end_id: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _files(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        code = encoder(path)
        out = None
        docs, nulls, sizes, offsets = [], [], [], []
        rest = np.zeros(0, dtype=np.uint32)
        for rows in slices(batches, "text"):
            if out is None:
                out = store.open_output_stream(f"{root}/{name}")
            ids, counts = code.encode(rows.column("text"))
            ends = np.cumsum(counts)
            docs.append(rows.column("doc_id").fill_null(0).to_numpy().astype(np.int64))
            nulls.append(np.asarray(rows.column("doc_id").is_null()).astype(np.uint8))
            sizes.append(counts + 1)
            rest = np.concatenate([rest, np.insert(ids, ends, end_id).astype(np.uint32)])
            while len(rest) >= BLOCK:
                offsets.append(out.tell())
                out.write(pack_ids(rest[:BLOCK], bits))
                rest = rest[BLOCK:]
        if out is None:
            return
        if len(rest):
            offsets.append(out.tell())
            out.write(pack_ids(rest, bits))
        ends = np.cumsum(np.concatenate(sizes))
        for x in (np.concatenate(docs), np.concatenate(nulls), ends.astype(np.int64), np.array(offsets, dtype=np.int64)):
            out.write(x.tobytes())
        out.write(np.array([len(ends), int(ends[-1]), len(offsets), bits, BLOCK], dtype=np.int64).tobytes() + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1])], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files; returns the manifest: part, file, n_docs, n_ids in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{scratch_dir(spark)}/ids-{uuid.uuid4().hex}"
    store, root = _files(folder)
    store.create_dir(root, recursive=True)
    bits = max(1, (Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1).bit_length(), int(end_id).bit_length())
    given = document_texts(docs)
    ordered = given.repartitionByRange(partitions(given, 6 << 20), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(lean(_write(folder, tokenizer, end_id, bits)), "part int, file string, n_docs long, n_ids long"), "id-files")


class IdFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        folder, _, name = uri.rpartition("/")
        store, root = _files(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(5 * 8 + len(MAGIC), size - 5 * 8 - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.n_docs, self.n_ids, blocks, self.bits, self.block = (int(x) for x in np.frombuffer(tail, np.int64, 5))
        at = size - len(tail) - 17 * self.n_docs - 8 * blocks
        foot = self.file.read_at(17 * self.n_docs + 8 * blocks, at)
        self.docs = np.frombuffer(foot, np.int64, self.n_docs)
        self.nulls = np.frombuffer(foot, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.ends = np.frombuffer(foot, np.int64, self.n_docs, 9 * self.n_docs)
        self.offsets = np.append(np.frombuffer(foot, np.int64, blocks, 17 * self.n_docs), at)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``."""
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack_ids(self.file.read_at(int(self.offsets[b + 1] - self.offsets[b]), int(self.offsets[b])), n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for uri, base in zip(rows.column("file").to_pylist(), rows.column("base").to_pylist(), strict=True):
            file = IdFile(uri)
            starts = np.concatenate([[0], file.ends[:-1]])
            for lo in range(0, file.n_docs, 2000):
                hi = min(file.n_docs, lo + 2000)
                sums = []
                at, held = -1, np.zeros(0, dtype=np.uint32)
                for a, b in zip(starts[lo:hi].tolist(), file.ends[lo:hi].tolist(), strict=True):
                    if b > at + len(held) or at < 0:  # decode on from here, a block or more at a time
                        at, held = a, file.ids(a, max(b, min(a + file.block, file.n_ids)))
                    sums.append(zlib.crc32(held[a - at : b - at].astype("<u4").tobytes()))
                ids = pa.array(file.docs[lo:hi], mask=file.nulls[lo:hi])
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts[lo:hi]), pa.array(file.ends[lo:hi] - starts[lo:hi]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    placed = manifest.select("part", "file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "part")
    return spread.select("file", "base").mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``write`` then ``read_documents``."""
    return read_documents(docs.sparkSession, write(docs, tokenizer, end_id))
