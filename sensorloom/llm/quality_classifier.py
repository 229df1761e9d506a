"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a document with features x: w0 + w.x + 1/2 * sum over factors of ((V'x)^2 - (V^2)'(x^2)), the pairwise
interactions in time linear in the features (sum-of-squares identity), through the logistic function.

Features: presence of hashed words (``buckets`` of them, scaled to unit length), structure statistics of the whole
text, and the table's own character count as metadata. Labels, language, source and doc_id are never inputs.

Training uses at most ``max_train_rows`` labelled documents (those of least hash of doc_id), whose features are
gathered on the driver; scoring is one pass over all documents with a model of fixed size.

Nulls: a null text is an empty text; a null n_chars counts as 0. Empty texts get the score of no words. With no
labels at all, or of one kind only, the model is constant. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared

BUCKETS, FACTORS = 1 << 15, 8
WINDOW = 8
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"#*$%&|<>"
SHOUTS = b"!?"
STOPS = b".,;:"
STATISTICS = 14
URL = re.compile(r"https?://|www\.")

_words = shared.WordHashes(shared.hash64)


def statistics(text: str, hashes: np.ndarray, n_chars: float) -> list[float]:
    """Structure of the whole text, each about 0 to 3, and the metadata at the end."""
    data, n = text.encode("utf-8"), len(hashes)
    size = max(1, len(data))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda marks: (len(data) - len(data.translate(None, marks))) / size
    repeats = 0.0
    if n >= WINDOW:
        with np.errstate(over="ignore"):
            h = hashes[: n - WINDOW + 1].copy()
            for k in range(1, WINDOW):
                h = h * shared.MIX1 + hashes[k : n - WINDOW + 1 + k]
        repeats = 1 - len(np.unique(h)) / len(h)
    return [
        np.log1p(n) / 3, min(3.0, size / max(1, n) / 6), 3 * share(UPPER), 5 * share(DIGITS), 10 * share(MARKS), 20 * share(SHOUTS), 10 * share(STOPS),
        repeats * 2, 2 * (1 - len(set(lines)) / max(1, len(lines))), len(np.unique(hashes)) / max(1, n), np.log1p(n / max(1, len(lines))) / 3,
        min(3.0, 100 * len(URL.findall(text)) / max(1, n)), float(n < 20), np.log1p(max(0.0, n_chars)) / 5,
    ]


def features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each document: words first, then the statistics."""
    texts = batch.column("text")
    hashes, cuts = _words.words_of(pc.ascii_split_whitespace(texts), np.uint64)
    hashes = shared.mix64(hashes)
    for text, chars, i, j in zip(texts.to_pylist(), batch.column("n_chars").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = hashes[i:j]
        words = np.unique((mine & np.uint64(BUCKETS - 1)).astype(np.int64))
        values = np.full(len(words), 1 / np.sqrt(max(1, len(words))))
        yield np.r_[words, BUCKETS + np.arange(STATISTICS)], np.r_[values, statistics(text, mine, chars)]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        pairs = 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights[at] + pairs, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 2e-5) -> Machine:
    """Logistic loss by AdaGrad over mini-batches in a fixed order."""
    size = BUCKETS + STATISTICS
    rng = np.random.default_rng(5)
    share = labels.mean() if len(labels) else 0.5
    machine = Machine(float(np.log((share + 0.01) / (1.01 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if len(labels) == 0 or share in (0.0, 1.0):
        return Machine(machine.bias, machine.weights, np.zeros((size, FACTORS)))
    squares_w, squares_v, square_b = np.full(size, 1e-4), np.full((size, FACTORS), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            part = order[k : k + batch]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            first = np.cumsum([0, *(len(rows[i][0]) for i in part)])[:-1]
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            v = machine.factors[at]
            xv = x[:, None] * v
            sums = np.add.reduceat(xv, first, axis=0)
            y = machine.bias + np.add.reduceat(x * machine.weights[at], first) + 0.5 * (sums**2 - np.add.reduceat(xv**2, first, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part)
            own = error[owner] * x
            used, inverse = np.unique(at, return_inverse=True)
            grad_w = np.bincount(inverse, own) + decay * machine.weights[used]
            each = own[:, None] * (sums[owner] - xv)
            grad_v = np.stack([np.bincount(inverse, each[:, f]) for f in range(FACTORS)], axis=1) + decay * machine.factors[used]
            squares_w[used] += grad_w**2
            squares_v[used] += grad_v**2
            square_b += error.sum() ** 2
            machine.weights[used] -= rate * grad_w / np.sqrt(squares_w[used])
            machine.factors[used] -= rate * grad_v / np.sqrt(squares_v[used])
            machine.bias -= rate * error.sum() / np.sqrt(square_b)
    return machine


def held_out(doc_id: str = "doc_id", fold: int = 1) -> Column:
    """Whether a document's label is kept for testing: crc32 of its id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == fold


def inputs(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, shared.text_or_empty().alias("text"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000) -> Machine:
    """Fitted to the quality labels outside the held-out fold, at most ``max_train_rows`` of them."""
    wanted = labels.where(~held_out() & F.col("quality").isNotNull()).select("doc_id", "quality")
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "quality").limit(max_train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, 200):
            found = [*features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], ["doc_id", "quality", "at", "x"])

    # The labels are bounded by max_train_rows, so they can be broadcast to the texts.
    rows = inputs(docs, "doc_id").join(F.broadcast(wanted), "doc_id").select("doc_id", "quality", "text", "n_chars")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "quality")]
    got = rows.mapInArrow(run, f"doc_id {kinds[0]}, quality {kinds[1]}, at array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    pairs = [(np.array(a), np.array(x)) for a, x in zip(got["at"].to_pylist(), got["x"].to_pylist(), strict=True)]
    return fit(pairs, np.array(got["quality"].to_pylist(), float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights, factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    compact = Machine(machine.bias, weights, factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([compact.score(at, x) for at, x in features(batch)], pa.float64())], ["doc_id", "score"])

    scored = inputs(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
