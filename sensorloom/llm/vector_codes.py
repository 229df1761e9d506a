"""Vector codes: integer product quantisation, with float32 screening that cannot change a result.

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, each with a codebook of its
own. A round assigns every part to the nearest entry of its codebook and replaces each entry by the floor of its parts'
mean. Distances to all entries come from one float32 matrix product a part, each with a bound on its rounding error;
every entry whose interval overlaps that of the best is computed again in 64-bit integers, ties go to the lower index.
So all results are those of integer arithmetic, whatever the order in which tasks run or rows arrive.

Each pass over the vectors is a map without a shuffle. What leaves a task is one sum a codebook component; these sums
are added by key, and the codebooks themselves (entries x dimensions integers, whatever the table's size) are all that
the driver and the tasks hold.

Nulls: rows are dropped whose vector is null, empty, of another length than the first one's, or holds a null, NaN or
infinity. Integers beyond +-2**25 are set to that limit, so that distances and their sums over up to 2048 components
fit. Null ids come last in the order that starts the codebooks; of equal ids, the one of lesser vector is first.
Repeated rows are kept. With fewer rows than entries there are as many entries as rows; an empty table gives no rows.
Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared

#: Unit roundoff of float32, and the largest integer that a component may become.
ROUNDOFF, LIMIT = 2.0**-24, 1 << 25
#: Vectors that are screened at once: bounds the matrix of distances.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers by part, entry and position."""

    entries: np.ndarray
    scale: float

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(F.col(vector), bad))


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """A column of equally long lists as rows of integers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(len(column), -1), scale)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower of equals, and its squared distance; all integers.

    s = |c|^2 - 2 x.c ranks the entries of a row. In float32, conversion of x, c and |c|^2, the product's w
    multiplications and additions in any order, and the subtraction change s by at most (w + 4) u (2 |x||c| + |c|^2),
    up to terms in u^2; the bound taken is larger than that by more than all of those.
    """
    width = x.shape[1]
    squares = (entries * entries).sum(1)
    s = squares.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1)), np.sqrt(squares.astype(np.float64))
    error = (1.05 * (width + 8) * ROUNDOFF) * (2 * np.multiply.outer(*lengths) + squares)
    low, high = s - error, s + error
    rows, candidates = np.nonzero(low <= high.min(1)[:, None])  # by row, then index; no row is without
    gap = x[rows] - entries[candidates]
    exact = (gap * gap).sum(1)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    least = np.minimum.reduceat(exact, first)
    hits = np.flatnonzero(exact == least[rows])
    hits = hits[np.r_[True, rows[hits][1:] != rows[hits][:-1]]]
    return candidates[hits], least


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column a part."""
    parts, _, width = entries.shape
    found = [nearest(x[:, p * width : (p + 1) * width], entries[p]) for p in range(parts)]
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def first_entries(vectors: DataFrame, vid: str, vector: str, parts: int, n_entries: int, scale: float) -> Codebooks | None:
    """Codebooks of the vectors of least id; None without any vector."""
    ordered = vectors.orderBy(F.col(vid).asc_nulls_last(), F.col(vector)).select(vector)
    rows = ordered.limit(n_entries).collect()
    if not rows:
        return None
    width = len(rows[0][0])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    if any(len(r[0]) != width for r in rows):
        rows = ordered.where(F.size(vector) == width).limit(n_entries).collect()
    x = integers(np.array([r[0] for r in rows]), scale)
    return Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy(), scale)


def improved(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    old = books.entries
    parts, n, width = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((parts, n, width + 1), np.int64), False  # the last place counts
        for batch in shared.sliced(batches, ROWS_AT_ONCE):
            x = matrix(batch.column(0), books.scale)
            codes, _ = assigned(x, old)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                mine = codes[order, p]
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                block = np.c_[x[order, p * width : (p + 1) * width], np.ones(len(x), np.int64)]
                sums[p, mine[first]] += np.add.reduceat(block, first, axis=0)
            some = True
        if some:
            place = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel()[place])], ["place", "total"])

    rows = vectors.select(vector).mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros(parts * n * (width + 1), np.int64)
    for r in rows:  # at most one for each place of the codebooks
        sums[r.place] = r.total
    sums = sums.reshape(parts, n, width + 1)
    count = sums[:, :, width:]
    return Codebooks(np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), old), books.scale)


def train(vectors: DataFrame, vid: str = "vec_id", vector: str = "embedding", parts: int = 16, n_entries: int = 64, scale: float = 256.0, rounds: int = 2) -> Codebooks | None:
    """Codebooks from ``rounds`` rounds over all vectors; None without any vector."""
    vectors = usable(vectors, vector)
    books = first_entries(vectors, vid, vector, parts, n_entries, scale)
    for _ in range(rounds if books else 0):
        books = improved(of_width(vectors, vector, books), vector, books)
    return books


def of_width(vectors: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    parts, _, width = books.entries.shape
    return vectors.where(F.size(vector) == parts * width)


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``keep`` columns, ``code`` (a byte for each part) and ``error`` (squared distance in integers) of each vector."""
    rows = of_width(usable(vectors, vector), vector, books).select(*keep, vector)
    if books.entries.shape[1] > 256:
        raise ValueError("a code has one byte a part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, ROWS_AT_ONCE):
            codes, gaps = assigned(matrix(batch.column(len(keep)), books.scale), books.entries)
            data = pa.Array.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes, np.uint8))])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), data.cast(pa.binary()), pa.array(gaps.sum(1))], [*keep, "code", "error"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, code binary, error long")


def decode(coded: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``embedding``: the vector that each code stands for, at the middle of its integer steps."""
    rows = coded.select(*keep, "code")
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, ROWS_AT_ONCE):
            codes = np.frombuffer(b"".join(batch.column(len(keep)).to_pylist()), np.uint8).reshape(-1, parts)
            flat = ((books.entries[np.arange(parts), codes] + 0.5) / books.scale).astype(np.float32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * parts * width, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), lists], [*keep, "embedding"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, embedding array<float>")


def error_by(coded: DataFrame, label: str) -> DataFrame:
    """The coded rows with ``label_error``: the errors of all rows of the same label, nulls together.

    The totals come from an aggregation that combines on the map side; the join back needs no key's rows together.
    """
    totals = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def hex_code() -> Column:
    return F.lower(F.hex("code"))


def compressed(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every usable row of vec_id, embedding, label."""
    vectors = vectors.select("vec_id", "embedding", "label")
    books = train(vectors, **settings)
    if books is None:
        rows = vectors.limit(0).select("vec_id", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), "label")
    else:
        rows = shared.stored(encode(vectors, books, ["vec_id", "label"]), "vector-codes")
    digest = books.digest if books else Codebooks(np.zeros(0, np.int64), 1.0).digest
    return error_by(rows, "label").select("vec_id", hex_code().alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
