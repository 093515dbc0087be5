"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words (A-Z in lower case, outer ASCII punctuation cut
off), pairs of neighbouring words and pairs with one word between. The driver learns with
per-coordinate rates and an L1 penalty from a bounded sample of labelled rows, and ships the few
weights that are not zero (at most 2**``BITS`` numbers) to the workers, which score whole texts.

The sample: of the rows that may be learned from, the ``MOST_LABELLED`` of least MD5 of the
doc_id. All features of their whole texts are written once, in parts of bounded size, and every
epoch reads the parts one by one, in one shuffled order; the driver holds its 2**``BITS`` coordinates and one part.

Edge cases: a null or empty text gets the model's bias as its score; a null or conflicting label
is not learned from; of rows that repeat a doc_id one is learned from; with no usable labels every score is about 0; rows with a null doc_id are scored
but never learned from (held_out is false); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import discard, lean, materialise, prepare, release, slices
from tidalframe.llm.textbytes import Words, mix, range_hashes

BITS = 20
MOST_LABELLED = 12_000
#: Bytes of features, by a high estimate, that pass the driver at a time.
PART_BYTES = 24 << 20
THRESHOLD = 0.7

ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
EPOCHS = 6
#: Weight of a toxic sample's gradient; they are the rare class.
POSITIVE = 4.0

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def hashed_features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and feature of every word, pair and skip-pair (with repeats), and the number of rows."""
    words = Words(column)
    data = words.data
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    place = np.arange(len(data))
    solid = ~_PUNCT[data]
    before = np.maximum.accumulate(np.where(solid, place, -1)) if len(data) else place
    after = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1] if len(data) else place
    start = np.minimum(after[words.start], words.end) if len(words) else words.start
    end = np.maximum(before[words.end - 1] + 1, start) if len(words) else words.end
    h = range_hashes(data, start, end)
    row, n = words.row, len(h)
    rows, found = [row], [mix(h + np.uint64(1))]
    for gap in (1, 2):
        if n > gap:
            same = row[:-gap] == row[gap:]
            pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(2 * gap + 1) + np.uint64(gap))
            rows.append(row[:-gap][same])
            found.append(pair[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), words.rows


def ftrl(samples: Callable[[], Iterable[tuple[np.ndarray, int]]], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, positive: float = POSITIVE) -> tuple[float, np.ndarray]:
    """Bias and weights by follow-the-regularised-leader, one (features, label) of ``samples()`` at a time."""
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for x, y in samples():
            zi, ni = z[x], n[x]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            g2 = g * g
            z[x] = zi + g - (np.sqrt(ni + g2) - root) / alpha * w
            n[x] = ni + g2
            bias_z += g - (np.sqrt(bias_n + g2) - np.sqrt(bias_n)) / alpha * b
            bias_n += g2
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)), w.astype(np.float32)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, found, rows = hashed_features(part.column("text"), bits)
            keys = np.unique((row << bits) | found)
            edges = np.searchsorted(keys, np.arange(rows + 1) << bits)
            out = [(keys[a:b] & ((1 << bits) - 1)).astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("part", "turn", "label")), pa.array(out, pa.binary())], names=["part", "turn", "label", "x"])

    return run


def _score(bias: float, index: np.ndarray, value: np.ndarray, bits: int, keep: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << bits, dtype=np.float32)
        weights[index] = value
        for part in slices(batches, "text"):
            row, found, rows = hashed_features(part.column("text"), bits)
            on = weights[found] != 0
            keys = np.unique((row[on] << bits) | found[on])
            total = bias + np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], minlength=rows)
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            names = [x for x in part.schema.names if x in keep]
            yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(score)], names=[*names, name])

    return run


def train(docs: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED, bits: int = BITS) -> tuple[float, np.ndarray]:
    """Bias and weights from ``labelled`` (doc_id, label), of which at most ``most`` rows count."""
    spark = docs.sparkSession
    prepare(spark)
    agreed = labelled.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    sample = agreed.select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    given = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max(F.octet_length("text")).alias("size"))
    ids = given.orderBy("doc_id").collect()  # ``most`` rows at most
    if len({r.label for r in ids}) < 2:
        return -35.0, np.zeros(1 << bits, dtype=np.float32)
    order = np.random.default_rng(7).permutation(len(ids)).tolist()
    rows, part, held = [], 0, 0
    for turn, k in enumerate(order):
        weight = min(6 * (ids[k].size or 0), 4 << bits)  # a text has no more features than there are coordinates
        part, held = (part + 1, weight) if held and held + weight > PART_BYTES else (part, held + weight)
        rows.append((ids[k].doc_id, ids[k].label, turn, part))
    turns = spark.createDataFrame(rows, "doc_id long, label int, turn int, part int")
    once = texts.join(F.broadcast(turns), "doc_id").groupBy("part", "turn").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    found = materialise(once.mapInArrow(lean(_features(bits)), "part int, turn int, label int, x binary"), "samples", by=["part"])

    def samples() -> Iterator[tuple[np.ndarray, int]]:
        for k in range(part + 1):
            some = found.where(F.col("part") == k).select("turn", "label", "x").toArrow()
            turns, labels, x = (some.column(c) for c in ("turn", "label", "x"))
            for i in np.argsort(turns.to_numpy(), kind="stable").tolist():
                yield np.frombuffer(x[i].as_buffer(), dtype=np.int32), labels[i].as_py()
            del some, turns, labels, x
            release()

    model = ftrl(samples, bits)
    discard(found)
    release()
    return model


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray], carry: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """Per row: doc_id, the ``carry`` columns, and the score (0 to 1) of the whole text as ``name``."""
    bias, weights = model
    bits = int(len(weights)).bit_length() - 1
    index = np.flatnonzero(weights)
    rest = [c for c in carry if c not in ("doc_id", "text")]
    text = docs["text"].cast("string").alias("text")
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[docs[c] for c in rest], text)
    keep = ["doc_id", *rest, *(["text"] if "text" in carry else [])]
    schema = ", ".join(f"`{c}` {t}" for c, t in given.select(*keep).dtypes)
    prepare(docs.sparkSession)
    return given.mapInArrow(lean(_score(bias, index, weights[index], bits, keep, name)), f"{schema}, `{name}` double")


def held_out(column="doc_id"):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[float, np.ndarray]:
    """A model from the labelled rows that are not held out."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label"))
    return train(docs, rows.where(~held_out()), most)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = score_toxicity(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    scored = score_toxicity(docs, learn(docs, labels), tuple(docs.columns), "score__")
    return scored.where(F.col("score__") < threshold).select(*docs.columns)
