"""Words, hashes and ragged ranges of UTF-8 text, many documents at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _MASK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte ranges ``data[starts:ends]``; the ranges are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        part = data[base : int(ends[upto - 1])].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=sums[1:])
        s = starts[at:upto] - base
        e = ends[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * powers(_INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null("" if wide == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = int(offs[0]) if len(offs) else 0
    return raw[first : int(offs[-1]) if len(offs) else 0], offs - first


class Words:
    """The words of a column of texts.

    ``data``: the words, each run of white space as one space; ``start`` and ``end``: byte range of
    each word in ``data``; ``row``: its text; ``first``: n + 1 offsets of the texts' words.
    """

    def __init__(self, column: pa.Array):
        raw, offsets = column_bytes(column)
        n = len(raw)
        space = IS_SPACE[raw]
        opens = np.zeros(n + 1, dtype=bool)
        opens[offsets] = True  # a text's first byte never continues a word
        before = np.empty(n, dtype=bool)
        before[:1] = True
        before[1:] = space[:-1]
        starts = np.flatnonzero(~space & (before | opens[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = True
        after[:-1] = space[1:]
        ends = np.flatnonzero(~space & (after | opens[1:])) + 1
        keep = ~space | ~before
        place = np.cumsum(keep) - 1
        self.data = np.where(space, np.uint8(0x20), raw)[keep]
        self.start = place[starts] if len(starts) else starts
        self.end = place[ends - 1] + 1 if len(ends) else ends
        self.first = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.rows = len(offsets) - 1

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after another, and their n + 1 offsets; ranges may overlap."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    index = np.repeat(starts - offsets[:-1], sizes)
    index += np.arange(offsets[-1])
    return data[index], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow array over gathered ranges."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` (associative, idempotent) over each run of ``width`` values."""
    have, size = values, 1
    while size * 2 <= width:
        have = join(have[:-size] if size < len(have) else have[:0], have[size:])
        size *= 2
    if size < width:
        more = width - size
        have = join(have[:-more] if more < len(have) else have[:0], have[more:])
    return have


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least (by its upper 40 bits, then the first) of each ``width`` consecutive hashes.

    Positions travel in a key's low 24 bits, so more hashes are taken in overlapping pieces.
    """
    n = max(0, len(hashes) - width + 1)
    out = np.empty(n, dtype=np.int64)
    step = (1 << 24) - width + 1
    for lo in range(0, n, step):
        part = hashes[lo : lo + step + width - 1]
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        out[lo : lo + step] = (sliding(key, width, np.minimum) & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` consecutive word hashes, in order."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    base = 0xA24BAED4963EE407
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + words[k : k + n]
    return mix(out)


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether ``data[a : a + size]`` equals ``data[b : b + size]``, byte by byte, eight at a time."""
    out = np.ones(len(a), dtype=bool)
    if not len(a):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    for lo in range(0, len(a), step):
        x, y, n = a[lo : lo + step], b[lo : lo + step], sizes[lo : lo + step]
        good = np.ones(len(x), dtype=bool)
        for k in range(0, int(n.max()), 8):
            on = n > k
            left = np.where(on, eight[np.where(on, x + k, 0)], 0)
            right = np.where(on, eight[np.where(on, y + k, 0)], 0)
            bits = np.clip((n - k) * 8, 0, 64).astype(np.uint64)
            shift = np.where(bits < 64, np.uint64(64) - bits, np.uint64(0))
            differ = (left ^ right) << np.where(shift < 64, shift, np.uint64(0))  # little-endian: the first bytes are the low bits
            good &= ~on | (differ == 0)
        out[lo : lo + step] = good
    return out
