"""Best-fit packing: fills sequences of a fixed length with whole documents, by patterns of lengths.

1. Documents become pieces: their ids and an end id; only longer ones are cut, at the sequence length.
2. The histogram of piece lengths (at most ``capacity`` rows) is the only thing that the driver sees.
3. Patterns of two to four lengths that fill a sequence exactly are enumerated from it; non-negative least
   squares fits how often each is used; counts are rounded, as far as the lengths last. What is left is
   enumerated and fitted again, until the fit places nothing more.
4. What is left of the histogram is packed by best fit over lengths, largest first: each step uses one
   filling as often as its rarest length lasts, so the steps are bounded by the number of lengths.
5. The plan is a bounded list of runs "the pieces of length L with ranks [a, b) go to these sequences".
   Ranks come from counters in each shard plus running totals over shards, so no length gathers in a task.

Nulls: a null text is an empty text (one piece: the end id). Repeated ids are packed once per row. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import shared, tokens

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, shard int, local_rank long, ids array<int>"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's pieces with their ids, written to the shared folder.

    ``shard`` and ``local_rank`` count the pieces of each length within the task that wrote them.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seen = tokens.encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in tokens.slices(batches):
            ids, ends = enc.encode_batch(batch.column("text"), end_id)
            size = np.diff(ends)  # at least 1: the end id
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            order = np.argsort(length, kind="stable")
            known, first, count = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(first, count) + seen[length[order]]
            seen[known] += count
            bounds = np.r_[0, np.cumsum(length)]
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)),
                pa.array(tokens.checksums(ids, bounds)), pa.array(np.full(len(doc), shard, np.int32)), pa.array(rank), tokens.list_of(ids, bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), shared.text_or_empty().alias("text"))
    return shared.stored(rows.mapInArrow(cut, PIECES), "pieces")


def patterns(lengths: np.ndarray, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Fillings of two to four of the given lengths with nothing to spare; at most ``most`` of each size, evenly chosen.

    Three and four lengths: any one, one of up to 96 that are spread over all (twice for four), and what is missing.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, min(len(lengths), 96)).astype(int))] if len(lengths) else lengths
    one, two = (x.ravel() for x in np.meshgrid(lengths, spread))
    out: list[tuple[int, ...]] = []
    for heads in ([lengths], [one, two], [one, two, two]):
        rest = capacity - sum(heads)
        fits = rest > 0
        fits[fits] = have[rest[fits]]
        rows = np.unique(-np.sort(-np.stack([*heads, rest], axis=1)[fits], axis=1), axis=0)
        if len(rows) > most:
            rows = rows[np.linspace(0, len(rows) - 1, most).astype(int)]
        out += map(tuple, rows.tolist())
    return out


def fit_counts(fillings: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x >= 0 that minimises |Ax - counts|."""
    if not fillings:
        return np.zeros(0)
    items = np.concatenate([np.array(p) for p in fillings])
    owner = np.repeat(np.arange(len(fillings)), [len(p) for p in fillings])
    at = lambda v: np.bincount(owner, v[items], len(fillings))  # noqa: E731  A transposed times v
    target, x = at(counts.astype(float)), np.ones(len(fillings))
    x *= counts.sum() / max(1, len(items))
    for _ in range(rounds):
        x *= target / np.maximum(at(np.bincount(items, x[owner], len(counts))), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int, most_patterns: int = 4000, rounds: int = 12) -> list[tuple[tuple[int, ...], int]]:
    """(filling, how often) over the whole histogram; bounded by the patterns and the lengths, not by the data."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    fitted_sequences = 0
    for _ in range(rounds):
        fillings, placed = patterns(np.flatnonzero(counts), capacity, most_patterns), 0
        fitted = fit_counts(fillings, counts)
        for k in np.argsort(-fitted, kind="stable").tolist():
            used, times = np.unique(fillings[k], return_counts=True)
            n = int(min(np.rint(fitted[k]), (counts[used] // times).min()))
            if n > 0:
                out.append((fillings[k], n))
                counts[used] -= n * times
                placed += n
        fitted_sequences += placed
        if placed < 0.01 * fitted_sequences:
            break
    while (left := np.flatnonzero(counts)).size:
        room, filling, spare = capacity, [], counts.copy()
        while room and (i := int(np.searchsorted(left, room, "right")) - 1) >= 0:
            length = int(left[i])
            k = int(min(room // length, spare[length]))
            filling += [length] * k
            spare[length] -= k
            room -= k * length
            if not spare[length]:
                left = np.delete(left, i)
            else:
                left = left[: i + 1] if room >= length else left[:i]
        used, times = np.unique(filling, return_counts=True)
        n = int((counts[used] // times).min())
        out.append((tuple(filling), n))
        counts[used] -= n * times
    return out


@dataclass
class Runs:
    """The plan by length: run starts (ranks), and for each the first sequence, the copies a sequence and their offset."""

    first_rank: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            rows = np.flatnonzero(length == x)
            run = np.searchsorted(self.first_rank[x], rank[rows], "right") - 1
            nth, copies = rank[rows] - self.first_rank[x][run], self.copies[x][run]
            seq[rows] = self.sequence[x][run] + nth // copies
            off[rows] = self.offset[x][run] + nth % copies * x
        return seq, off


def runs(fillings: list[tuple[tuple[int, ...], int]]) -> Runs:
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for filling, n in fillings:
        at = 0
        for length in sorted(set(filling), reverse=True):
            k = filling.count(length)
            by.setdefault(length, []).append((used.get(length, 0), first, k, at))
            used[length] = used.get(length, 0) + n * k
            at += k * length
        first += n
    column = lambda i: {x: np.array([r[i] for r in rows], np.int64) for x, rows in by.items()}
    return Runs(column(0), column(1), column(2), column(3), first)


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces, without their ids, with ``sequence_id`` and ``offset``.

    The plan goes to the tasks with the function; it is at most a few rows for each of ``capacity`` lengths
    and each pattern, whatever the input's size.
    """
    light = cut.drop("ids")
    histogram = {r.length: r.n for r in light.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = runs(plan(histogram, capacity))
    per_shard = light.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = light.join(bases, ["length", "shard"]).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = layout.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), pa.array(seq), pa.array(off)], names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the ``doc_id`` of each piece in order.

    Needs unique (doc_id, piece); a sequence is bounded by the capacity.
    """
    part = F.struct("offset", "doc_id", "ids")
    rows = placed.join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
