"""Periodic runs of words: maximal stretches that repeat with their smallest period, and texts without the repeats.

Method, on the exact word codes of a batch of texts: for every period p a grid of positions p apart (a harmonic sum,
n ln n pairs a text). A run of period p is at least 2p long, so it holds a grid point and the one after it; the
longest common extensions of such a pair, forwards and backwards, are the run's ends. Extensions are found for all
pairs at once by binary search over prefix hashes; the runs that come out are compared word by word, and a text on
which a hash has lied is done again without hashes. Of equal stretches the least period stays.

Texts are rows of a map over Spark's partitions: nothing is shuffled, and a text is never cut. Memory is bounded by
``tokens.BYTES_AT_ONCE`` of text (or the longest text) and ``PAIRS_AT_ONCE`` pairs.

Nulls and empty texts have no words and no runs. Repeated rows and repeated doc_ids each give a row; a null doc_id is
kept (``with_repeated_tails`` leaves its text alone). Only doc_id and text are read, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import shared, tokens

PAIRS_AT_ONCE = 1 << 19
#: Odd, so that its powers never vanish modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and where those of each text begin and end."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(words, "")
    ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return words.filter(full).cast(pa.large_string()), ends[bounds - bounds[0]]


def joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Texts of the words between the bounds, with one space between words."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), pa.scalar(" ", words.type))


class Prefixes:
    """Hashes of all prefixes of a sequence of codes: equality of two stretches in constant time."""

    def __init__(self, codes: np.ndarray):
        self.powers = np.full(len(codes) + 1, BASE)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        values = shared.mix64(codes.astype(np.uint64) + np.uint64(1))
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values * self.powers[:-1], dtype=np.uint64)]

    def equal(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        """Whether [a, ends_a) and [b, ends_b), equally long, have the same codes; b is not before a."""
        s = self.sums
        return (s[ends_a] - s[a]) * self.powers[b - a] == s[ends_b] - s[b]

    def extension(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, forward: bool) -> np.ndarray:
        """The largest k in [low, high] for which the k codes from (or up to) a equal those from (or up to) b."""
        low, high = low.copy(), high.copy()
        left = np.flatnonzero(low < high)
        while len(left):
            k = (low[left] + high[left] + 1) >> 1
            x, y = a[left], b[left]
            same = self.equal(x, y, x + k, y + k) if forward else self.equal(x - k, y - k, x, y)
            low[left[same]] = k[same]
            high[left[~same]] = k[~same] - 1
            left = left[low[left] < high[left]]
        return low


def grid_pairs(bounds: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of all grid points whose word stands again one period on, some at a time."""
    sizes = np.diff(bounds)
    halves = sizes // 2
    texts = np.repeat(np.arange(len(sizes)), halves)
    periods = tokens.ragged(np.ones_like(halves), halves)
    ends = np.cumsum((sizes[texts] - 1) // periods) if len(texts) else np.zeros(0, np.int64)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        last = min(first + PAIRS_AT_ONCE, int(ends[-1]))
        i, j = np.searchsorted(ends, [first, last - 1], "right")
        before = np.r_[ends[i - 1] if i else 0, ends[i:j]]
        n = np.minimum(ends[i : j + 1], last) - np.maximum(before, first)
        p = np.repeat(periods[i : j + 1], n)
        at = (tokens.ragged(np.maximum(before, first) - before, n)) * p + np.repeat(bounds[texts[i : j + 1]], n)
        same = np.flatnonzero(codes[at] == codes[at + p])
        yield np.repeat(texts[i : j + 1], n)[same], at[same], p[same]


def scanned(codes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of one text's runs by comparing it with itself at every distance."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(codes) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, codes[:-p] == codes[p:], 0]))
        for i, j in zip(edges[::2].tolist(), (edges[1::2] + p).tolist()):
            if j - i >= max(least, 2 * p):
                found.setdefault((i, j), p)
    return [(i, j, p) for (i, j), p in found.items()]


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (text, start, end, period), sorted, of all texts' runs; places are those in ``codes``."""
    prefixes, found = Prefixes(codes), [np.zeros((0, 4), np.int64)]
    for text, a, p in grid_pairs(bounds, codes):
        one, b = np.ones_like(a), a + p
        end = b + prefixes.extension(a, b, one, bounds[text + 1] - b, True)
        start = a - prefixes.extension(a, b, 0 * one, a - bounds[text], False)
        long = end - start >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([text, start, end, p], 1)[long], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    if not len(rows):
        return rows
    first = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]  # of equal stretches, that of the least period
    period = rows[first, 3][np.cumsum(first) - 1]
    wrong = set(rows[rows[:, 3] % period != 0, 0].tolist())
    rows = rows[first]
    for text, start, end, p in rows.tolist():  # word by word
        if not np.array_equal(codes[start : end - p], codes[start + p : end]):
            wrong.add(text)
    if wrong:
        again = [(t, bounds[t] + i, bounds[t] + j, p) for t in sorted(wrong) for i, j, p in scanned(codes[bounds[t] : bounds[t + 1]], least)]
        rows = np.concatenate([rows[~np.isin(rows[:, 0], sorted(wrong))], np.array(again, np.int64).reshape(-1, 4)])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeats(runs: np.ndarray, size: int) -> np.ndarray:
    """Whether each place is in a run after that run's first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, ``runs`` (start, length and period in words, by start and period) and ``collapsed``: the words outside
    repeats, with one space between them."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            words, bounds = words_of(batch.column("text"))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = runs_of(codes, bounds, least)
            kept = ~repeats(runs, len(codes))
            texts = joined(words.filter(pa.array(kept)), np.r_[0, np.cumsum(kept)][bounds])
            cuts = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
            fields = (runs[:, 1] - bounds[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], RUN.names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts.cast(pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def with_repeated_tails(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """doc_id and text; texts whose doc_id's CRC-32 h is a multiple of ``one_in`` become periodic from some word on.

    With g = h div ``one_in``, a = g mod n of the n words and p = 1 + (n - a) div (3 + g mod 8), every word i from a on
    becomes word a + (i - a) mod p. Plants runs of known place, for measuring what ``find_runs`` finds.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            hashes = [None if k is None else zlib.crc32(str(k).encode()) for k in batch.column("doc_id").to_pylist()]
            some = np.array([h is not None and h % one_in == 0 for h in hashes], bool)
            words, bounds = words_of(batch.column("text").filter(pa.array(some)))
            places = np.arange(len(words))
            for h, i, j in zip((h for h, x in zip(hashes, some) if x), bounds[:-1].tolist(), bounds[1:].tolist()):
                g, n = h // one_in, j - i
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    places[i + a : j] = i + a + np.arange(n - a) % p
            changed = joined(words.take(pa.array(places)), bounds).cast(pa.string())
            texts = pc.replace_with_mask(batch.column("text").cast(pa.string()), pa.array(some), changed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return rows.mapInArrow(run, rows.schema)


def digests(found: DataFrame) -> DataFrame:
    """A row per document of ``find_runs``: number of runs, the longest (of these the first), checksums."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    start, length, period = -F.col("best.minus_start"), F.col("best.length"), -F.col("best.minus_period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div -best.minus_period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
