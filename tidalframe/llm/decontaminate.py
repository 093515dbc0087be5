"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared case-blind with runs of white space as one space. An item
of m characters may differ from its place in a text by ``rate * m`` edits at most. By the q-gram lemma such
a place shares at least m + 1 - q * (edits + 1) of the item's q-grams, all on diagonals (position
in the text less position in the item) no further apart than twice the edits. So shared q-grams are counted in
overlapping bands of diagonals; only bands that reach the bound are aligned, inside the band,
and count if the edit distance stays in the budget.

A gram that an item holds several times counts once per text position and stretch of the item, with its
number there: an overestimate that alignment corrects, and what keeps repeated characters from
making a row for each pair. Text is worked off in bounded slices, and bands that lie behind are closed.

The benchmark is read in blocks of ``BLOCK_BYTES`` at most, each shipped with one pass over the
documents; ``CHAIN`` passes are chained, so texts are scanned once and never shuffled, and beyond that the rows
so far are written to the shared folder first.

Edge cases: a null or empty text matches nothing; items that are null or empty are left out;
items of fewer than ``least`` characters count only as they are, from word border to word border; repeated items are one item under each of their ids; a row with a
null doc_id is judged like others; an empty benchmark or table gives no matches; other columns are
carried along only where asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import lean, materialise, prepare, slices
from tidalframe.llm.textbytes import mix, powers

Q, RATE, LEAST = 8, 0.08, 32
BLOCK_BYTES = 1 << 20
CHAIN = 8
#: Rows of text positions and item stretches that are counted in one go.
SLICE = 1 << 20
_BASE = 0x94D049BB133111EB
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Stands between texts; no character has this code.
_GAP = 0x200000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())  # parts at what \s matches too


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the plain texts, a gap after each, and the n + 1 offsets."""
    parts = [plain(t) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.frombuffer("\x00".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    out[offsets[1:] - 1] = _GAP
    return out, offsets


def gram_hashes(values: np.ndarray, q: int, step: int = 1 << 19) -> np.ndarray:
    """Hashes of all ``q`` consecutive values."""
    n = max(0, len(values) - q + 1)
    out = np.zeros(n, dtype=np.uint64)
    for lo in range(0, n, step):
        part = values[lo : min(len(values), lo + step + q - 1)].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=sums[1:])
        k = len(part) - q + 1
        out[lo : lo + k] = mix((sums[q:] - sums[:-q]) * powers(_INVERSE, k))
    return out


def banded_distance(item: np.ndarray, text: np.ndarray, width: int, most: int | None = None) -> int:
    """Least edits between ``item`` and a part of ``text``, on diagonals 0 to ``width``; where they are over ``most``, any number over it."""
    n = len(item)
    ends = len(text) - n + 1
    if n and ends > 0:  # as it is, on one of these diagonals
        at = np.flatnonzero(text[: min(ends, width + 1)] == item[0])
        if len(at) and (text[at[:, None] + np.arange(n)] == item).all(axis=1).any():
            return 0
    padded = np.full(n + width + 1, _GAP + 1, dtype=np.int64)
    padded[: min(len(text), len(padded))] = text[: len(padded)]
    ramp = np.arange(width + 1)
    have = np.zeros(width + 1, dtype=np.int64)
    for i in range(n):
        step = have + (padded[i : i + width + 1] != item[i])
        step[:-1] = np.minimum(step[:-1], have[1:] + 1)
        have = np.minimum.accumulate(step - ramp) + ramp
        if most is not None and i % 16 == 15 and have.min() > most:
            break  # edits never become fewer
    return int(have.min())


def _in_word(values: np.ndarray) -> np.ndarray:
    """Whether each is a letter or digit of a script that puts spaces between words."""
    kinds, of = np.unique(values, return_inverse=True)
    return np.array([c < 0x2E80 and chr(c).isalnum() for c in kinds.tolist()], dtype=bool)[of]


class ItemIndex:
    """q-grams of the items, by hash."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], q: int, rate: float, least: int):
        given = [(i, t) for i, t in zip(ids, map(plain, texts), strict=True) if t]
        kept = [(i, t) for i, t in given if len(t) >= max(least, q)]
        self.whole: dict[int, list[tuple[np.uint64, np.ndarray, list[int]]]] = {}  # by length
        short: dict[str, list[int]] = {}
        for i, t in given:
            if len(t) < max(least, q):
                short.setdefault(t, []).append(i)
        for t, of in short.items():
            item = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            self.whole.setdefault(len(item), []).append((gram_hashes(item, len(item))[0], item, of))
        self.q = q
        self.ids = [i for i, _ in kept]
        self.items = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for _, t in kept]
        size = np.array([len(x) for x in self.items], dtype=np.int64)
        self.edits = np.minimum((size * rate).astype(np.int64), np.maximum(0, (size + 1 - q - 1) // q - 1))
        self.bound = size + 1 - q * (self.edits + 1)
        self.wide = 2 * self.edits + 1
        grams = [gram_hashes(x, q) for x in self.items]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        every, owner, place = every[order], owner[order], place[order]
        stretch = place // self.wide[owner] if len(owner) else place
        opens = np.ones(len(every), dtype=bool)
        opens[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])
        head = np.flatnonzero(opens)  # one row for a gram's places in one stretch of an item
        self.owner, self.low = owner[head], place[head]
        self.many = np.diff(np.append(head, len(every)))
        self.high = place[head + self.many - 1] if len(head) else place
        self.keys, self.first = np.unique(every[head], return_index=True)
        self.last = np.append(self.first[1:], len(head))
        self.bitmap = np.zeros(1 << 24, dtype=bool)
        self.bitmap[self.keys >> np.uint64(40)] = True

    def wholes(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Places of the short items that ``values`` holds as they are, at word borders, and the items' ids."""
        for length, items in self.whole.items():
            grams = gram_hashes(values, length)
            spots = np.flatnonzero(np.isin(grams, np.array([h for h, _, _ in items])))
            grams = grams[spots]
            for h, item, of in items:
                at = spots[grams == h]
                at = at[(values[at[:, None] + np.arange(length)] == item).all(axis=1)]
                if len(at) and _in_word(item[:1])[0]:
                    at = at[(at == 0) | ~_in_word(values[at - 1])]
                if len(at) and _in_word(item[-1:])[0]:
                    at = at[~_in_word(values[np.minimum(at + length, len(values) - 1)])]  # the last value is a gap
                if len(at):
                    yield at, of

    def _bands(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, band and shared grams (or more) of the bands of ``values`` that reach their item's bound.

        Band b of an item holds the diagonals from b times its width on, twice its width.
        """
        grams = gram_hashes(values, self.q)
        spots = np.flatnonzero(self.bitmap[grams >> np.uint64(40)])
        at = np.minimum(np.searchsorted(self.keys, grams[spots]), max(0, len(self.keys) - 1))
        good = self.keys[at] == grams[spots] if len(self.keys) else np.zeros(0, dtype=bool)
        spots, at = spots[good], at[good]
        if not len(spots):
            return
        count = self.last[at] - self.first[at]
        upto = np.cumsum(count)
        longest = max(len(x) for x in self.items)
        base = longest + 2 * int(self.wide.max())  # diagonals plus this are not negative
        span = len(values) + 2 * base
        open_keys, open_hits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lo = 0
        while lo < len(spots):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + SLICE, side="right")))
            c = count[lo:hi]
            row = np.repeat(self.first[at[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            here = np.repeat(spots[lo:hi], c) + base
            item = self.owner[row]
            wide = self.wide[item]
            from_, to = (here - self.high[row]) // wide, (here - self.low[row]) // wide
            many, name = self.many[row], item * span
            more = to > from_  # a stretch may touch two bands' starts
            keys = np.concatenate([open_keys, name + from_, name + from_ - 1, (name + to)[more]])
            hits = np.concatenate([open_hits, many, many, many[more]])
            keys, where = np.unique(keys, return_inverse=True)
            hits = np.bincount(where, hits, minlength=len(keys)).astype(np.int64)
            item, band = keys // span, keys % span
            passed = (band + 2) * self.wide[item] <= (spots[hi] if hi < len(spots) else len(values) + base) + base - longest
            if hi >= len(spots):
                passed[:] = True
            full = passed & (hits >= self.bound[item])
            if full.any():
                yield item[full], band[full] * self.wide[item[full]] - base, hits[full]
            open_keys, open_hits = keys[~passed], hits[~passed]
            lo = hi

    def matches(self, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edits) of the places in ``values`` that hold an item; texts begin at ``offsets``."""
        out = []
        exact: set[tuple[int, int]] = set()
        for items, starts, hits in self._bands(values):
            for j in np.argsort(-hits, kind="stable").tolist():
                k, start = int(items[j]), int(starts[j])
                width, pattern = 2 * int(self.wide[k]), self.items[k]
                lo, hi = max(0, start), min(len(values), start + width + len(pattern) + 1)
                first, last = (np.searchsorted(offsets, [lo, hi - 1], side="right") - 1).tolist()
                for row in range(first, last + 1):
                    a, b = max(lo, int(offsets[row])), min(hi, int(offsets[row + 1]))
                    if (row, k) in exact or b - a < len(pattern) - self.edits[k]:
                        continue  # nothing better, or nothing, can be found
                    text = np.full(hi - start, _GAP + 1, dtype=np.int64)  # what isn't of this text matches nothing
                    text[a - start : b - start] = values[a:b]
                    edits = banded_distance(pattern, text, width, int(self.edits[k]))
                    if edits <= self.edits[k]:
                        out.append((row, k, edits))
                        if not edits:
                            exact.add((row, k))
        return out


_indexes: dict[str, ItemIndex] = {}


def _scan(token: str, ids: list[int], texts: list[str], q: int, rate: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _indexes:
            _indexes.clear()
            _indexes[token] = ItemIndex(ids, texts, q, rate, least)
        index = _indexes[token]
        for part in slices(batches, "text", 1 << 20):
            values, offsets = codes(part.column("text").to_pylist())
            found: list[dict[int, int]] = [{} for _ in range(part.num_rows)]
            for row, k, edits in index.matches(values, offsets):
                have = found[row]
                have[index.ids[k]] = min(edits, have.get(index.ids[k], edits))
            for at, of in index.wholes(values):
                for row in np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist():
                    found[row] |= dict.fromkeys(of, 0)
            merged = [{**({x["item"]: x["edits"] for x in old} if old else {}), **new} for old, new in zip(part.column("hits__").to_pylist(), found, strict=True)]
            column = pa.array([[{"item": i, "edits": e} for i, e in sorted(x.items())] for x in merged], pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())])))
            yield part.set_column(part.schema.get_field_index("hits__"), "hits__", column)

    return run


def match_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """``docs`` with hits__: the benchmark items each text holds, as (item, edits) by item."""
    prepare(docs.sparkSession)
    kind = "array<struct<item: bigint, edits: int>>"
    out = docs.withColumn("hits__", F.array().cast(kind))
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)

    def blocks() -> Iterator[tuple[list[int], list[str]]]:
        ids, texts, size = [], [], 0
        rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
        for row in rows.toLocalIterator():
            if ids and size + len(row.text) > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(row.item_id)
            texts.append(row.text)
            size += len(row.text)
        if ids:
            yield ids, texts

    for k, (ids, texts) in enumerate(blocks()):
        if k and k % CHAIN == 0:
            out = materialise(out, "matched")
        out = out.mapInArrow(lean(_scan(uuid.uuid4().hex, ids, texts, q, rate, least)), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    return match_benchmark(docs, benchmark, **options).where(F.size("hits__") == 0).drop("hits__")
