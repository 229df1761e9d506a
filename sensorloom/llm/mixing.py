"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted block indexes, a join.

1. The documents of a source, in ascending doc_id, are one stream of words, cut into blocks of ``block_words`` (the last
   one of a source may be shorter). Places in the streams come from a range shuffle of (doc_id, source, size) and one
   total a partition; texts are read once and are not shuffled.
2. A source's target is its share by weight of all words, at most ``most_repeats`` times its own size; what exceeds that
   is shared anew by weight. The target fixes how many slots of the mix it gets; its last slot is cut short so that
   the words taken are the target, rounded.
3. Every output shard of ``shard_slots`` slots draws its counts of the sources from a multinomial, seeded by the shard.
   A source's slots are numbered over the shards in order. Draws add up to the slots of all sources only on average:
   slots beyond a source's number go, in order, to the sources that were drawn too seldom.
4. A source's k-th slot takes block perm(k mod n) of its n blocks, where perm is a keyed Feistel network, another for
   each pass through the source. So within a pass no block comes twice, and tasks need no table of what is taken.
5. Slots are joined with the pieces of documents that make up their blocks, by source and block index. A block is taken
   ``most_repeats`` times at most, and documents per block are bounded, so no key is hot whatever a source's size.

Draws, permutations and order depend on the seed, the ids and the texts alone: reruns agree.

The driver holds one row a source (a list that somebody weighs; more than ``MOST_SOURCES`` raise an error) and one total
a partition. Nulls: a null text has size 0, a null source is a source of its own, the last. Null doc_ids come last in
their stream. Documents of size 0 are returned with nothing taken. Repeated rows and ids are documents of their own.
An empty table gives no rows. Only doc_id, source and text are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import periodic_runs, shared, tokens

MOST_SOURCES = 100_000
#: Shards whose counts are numbered together before the groups of shards are.
SHARDS_A_GROUP = 1024
ROUNDS = 4


def feistel(x: np.ndarray, bits: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    mask = (np.uint64(1) << bits) - np.uint64(1)
    left, right = x >> bits, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        salt = shared.mix64(key + np.array([r + 1], np.uint64) * shared.MIX1)
        if back:
            left, right = right ^ (shared.mix64(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (shared.mix64(right ^ salt) & mask)
    return (left << bits) | right


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of [0, n), chosen by ``key``, takes each x; ``back``: where it comes from."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (x, n, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2 + 1e-9)).astype(np.uint64)
    out = feistel(x, bits, key, back)
    while len(left := np.flatnonzero(out >= n)):  # walks the cycle until it is inside
        out[left] = feistel(out[left], bits[left], key[left], back)
    return out.astype(np.int64)


def shares(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[Fraction]:
    """Each source's part of the sum of all sizes, by weight; none is above ``most`` times its size."""
    out, left, rest = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), list(range(len(sizes)))
    while rest and left:
        weight = sum(weights[k] for k in rest)
        full = [k for k in rest if left * weights[k] > most * sizes[k] * weight]
        if not full:
            for k in rest:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = Fraction(most * sizes[k])
        left -= sum(out[k] for k in full)
        gone = set(full)
        rest = [k for k in rest if k not in gone]
    return out


def one_two_three(names: Sequence[str | None]) -> list[int]:
    return [1 + k % 3 for k in range(len(names))]


@dataclass
class Plan:
    """Sources by code point, null last, with sizes and targets; and how many slots each one gets."""

    names: list[str | None]
    sizes: list[int]
    targets: list[Fraction]
    block_words: int
    shard_slots: int
    seed: int
    blocks: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)
    last_words: np.ndarray = field(init=False)

    def __post_init__(self):
        size, b = np.array(self.sizes, np.int64), self.block_words
        wanted = np.array([int(t + Fraction(1, 2)) for t in self.targets], np.int64)
        self.blocks = -(-size // b)
        passes, rest = wanted // np.maximum(size, 1), wanted % np.maximum(size, 1)
        short = np.where(size > 0, size - (self.blocks - 1) * b, b)  # words of the last block
        n = -(-rest // b)
        some = np.flatnonzero(rest)
        place = np.zeros_like(n)  # of the short block in the pass that is not finished
        place[some] = permuted(self.blocks[some] - 1, self.blocks[some], self.keys(some, passes[some]), back=True)
        within = place < n
        n = np.where(within, -(-(rest + b - short) // b), n)
        words = n * b - np.where(within, b - short, 0)
        length = np.where(within & (place == n - 1), short, b)
        self.slots = passes * self.blocks + n
        self.last_words = np.where(rest > 0, length - (words - rest), b)

    def keys(self, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
        seed = shared.mix64(np.array([self.seed], np.uint64) + np.uint64(1))
        return shared.mix64(seed ^ shared.mix64(np.asarray(source).astype(np.uint64) * shared.MIX1 + np.asarray(epoch).astype(np.uint64)))

    @property
    def starts(self) -> np.ndarray:
        """Words before each source, all sources in one line."""
        return np.r_[0, np.cumsum(np.array(self.sizes, np.int64))]

    @property
    def n_shards(self) -> int:
        return -(-int(self.slots.sum()) // self.shard_slots)


@dataclass
class Mix:
    """``slots``: shard, slot, source_no, block, words. ``pieces``: row, doc_id, source_no, size, block, offset, first
    (word of the document), n; with texts also ``text``. ``ordered``: a row per document with its place in the streams.
    """

    plan: Plan
    ordered: DataFrame
    pieces: DataFrame
    slots: DataFrame

    @cached_property
    def joined(self) -> DataFrame:
        """Every piece once for each slot that holds it, with the words that the slot takes of it."""
        words = F.least(F.col("n"), F.col("words") - F.col("offset"))
        # A sorted join whatever the files' sizes: pieces are many times what they are made from.
        return self.pieces.hint("merge").join(self.slots.hint("merge"), ["source_no", "block"]).withColumn("take", words).where("take > 0")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of each document."""
        p = self.plan
        rows = [(k, p.names[k], p.sizes[k], float(p.targets[k])) for k in range(len(p.names))]
        sources = self.ordered.sparkSession.createDataFrame(rows, "source_no int, source string, source_size long, target double")
        used = self.joined.groupBy("row").agg(F.sum("take").alias("taken"))
        docs = self.ordered.select("row", "doc_id", "source_no", "size").join(used, "row", "left")
        docs = docs.join(F.broadcast(sources), "source_no")  # MOST_SOURCES rows at most
        return docs.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

    def texts(self) -> DataFrame:
        """shard, slot, source_no, block and text of each slot of the mix; needs pieces with texts."""
        part = F.struct("offset", F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("take").cast("int")), " ").alias("text"))
        rows = self.joined.groupBy("shard", "slot", "source_no", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a block's
        return rows.select("shard", "slot", "source_no", "block", F.array_join("parts.text", " ").alias("text"))


def in_order(docs: DataFrame, with_texts: bool) -> DataFrame:
    """part, row, doc_id, source, size, at (words before it in its part): by source, doc_id and text; stored."""
    text = F.col("text").cast("string")
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"), *([text.alias("text")] if with_texts else []),
    )
    sized = shared.stored(sized, "mix-sizes").withColumn("nth", F.monotonically_increasing_id())  # equal rows are told apart
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("nth")]
    rows = sized.repartitionByRange(shared.partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("tie", "nth")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, nth = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = at + np.cumsum(size)
            row = (part << 40) + nth + np.arange(len(size), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int32)), pa.array(row), pa.array(ends - size), *batch.columns], ["part", "row", "at", *names])
            at, nth = int(ends[-1]) if len(size) else at, nth + len(size)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return shared.stored(rows.mapInArrow(run, f"part int, row long, at long, {kinds}"), "mix-order")


def planned(ordered: DataFrame, weights: Callable[[Sequence[str | None]], Sequence[int]], block_words: int, shard_slots: int, most_repeats: int, seed: int) -> Plan:
    rows = ordered.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to weigh")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in rows], [r["size"] for r in rows]
    return Plan(names, sizes, shares(sizes, weights(names), most_repeats), block_words, shard_slots, seed)


def numbered(ordered: DataFrame, plan: Plan) -> DataFrame:
    """``ordered`` with source_no and ``pos``: words before the document in its source."""
    totals = dict(ordered.groupBy("part").agg(F.sum("size")).collect())  # one a partition
    bases = np.zeros(max(totals, default=0) + 2, np.int64)
    for part, total in totals.items():
        bases[part + 1] = total
    bases = np.cumsum(bases)
    numbers, starts, names = {s: k for k, s in enumerate(plan.names)}, plan.starts, ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("source").dictionary_encode(null_encoding="encode")
            number = np.array([numbers[s] for s in coded.dictionary.to_pylist()] or [0], np.int32)[coded.indices.to_numpy()]
            pos = bases[batch.column("part").to_numpy()] + batch.column("at").to_numpy() - starts[number]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(pos)], [*names, "source_no", "pos"])

    kinds = ", ".join(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in names)
    return ordered.mapInArrow(run, f"{kinds}, source_no int, pos long")


def pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """The parts of each document in the blocks of its source: row, source_no, block, offset, first, n (and text)."""
    with_texts = "text" in docs.columns
    rows = docs.where("size > 0").select("row", "source_no", "pos", "size", *(["text"] if with_texts else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches):
            pos, size = (batch.column(c).to_numpy() for c in ("pos", "size"))
            first, last = pos // block_words, (pos + size - 1) // block_words
            n = last - first + 1
            of = np.repeat(np.arange(len(n)), n)
            block = tokens.ragged(first, n)
            begin = np.maximum(pos[of], block * block_words)
            end = np.minimum((pos + size)[of], (block + 1) * block_words)
            out = [batch.column("row").take(pa.array(of)), batch.column("source_no").take(pa.array(of)), pa.array(block), pa.array(begin - block * block_words), pa.array(begin - pos[of]), pa.array(end - begin)]
            if with_texts:
                words, bounds = periodic_runs.words_of(batch.column("text"))
                out.append(periodic_runs.joined(words, np.r_[0, np.cumsum(end - begin)]).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["row", "source_no", "block", "offset", "first", "n"] + ["text"] * with_texts)

    return rows.mapInArrow(run, "row long, source_no int, block long, offset long, first long, n long" + ", text string" * with_texts)


def draws(spark, plan: Plan) -> DataFrame:
    """shard, source_no, n (slots drawn) and at (slots of earlier sources in the shard); stored."""
    total, p = int(plan.slots.sum()), plan.slots / max(1, plan.slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                size = min(plan.shard_slots, total - shard * plan.shard_slots)
                n = np.random.Generator(np.random.Philox(key=np.array([plan.seed, shard], np.uint64))).multinomial(size, p)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array((np.cumsum(n) - n)[some])], ["shard", "source_no", "n", "at"])

    shards = spark.range(0, plan.n_shards, 1, max(1, min(plan.n_shards, shared.partitions(spark))))
    return shared.stored(shards.mapInArrow(run, "shard long, source_no int, n long, at long"), "mix-draws")


def slots_of(spark, plan: Plan) -> DataFrame:
    """shard, slot, source_no, block and words (taken at most) of every slot of the mix."""
    drawn = draws(spark, plan).withColumn("group", F.expr(f"shard div {SHARDS_A_GROUP}"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("n")).withColumn("base", before(Window.partitionBy("source_no").orderBy("group")))
    own = drawn.withColumn("own", before(Window.partitionBy("source_no", "group").orderBy("shard")))
    rows = own.join(groups.drop("n"), ["source_no", "group"]).select("shard", "source_no", "n", "at", (F.col("base") + F.col("own")).alias("first"))
    got = np.zeros_like(plan.slots)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # one a source
        got[r.source_no] = r.n
    lacking, beyond = np.maximum(plan.slots - got, 0), np.maximum(got - plan.slots, 0)
    lacking_ends, beyond_starts = np.cumsum(lacking), np.cumsum(beyond) - beyond
    total = int(plan.slots.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches):
            shard, source, n, at, first = (batch.column(c).to_numpy() for c in ("shard", "source_no", "n", "at", "first"))
            of = np.repeat(np.arange(len(n)), n)
            nth = tokens.ragged(np.zeros_like(n), n)
            k, src = first[of] + nth, source[of].astype(np.int64)
            over = np.flatnonzero(k >= plan.slots[src])  # to those that lack slots
            j = beyond_starts[src[over]] + k[over] - plan.slots[src[over]]
            src[over] = np.searchsorted(lacking_ends, j, "right")
            k[over] = got[src[over]] + j - (lacking_ends - lacking)[src[over]]
            blocks = plan.blocks[src]
            block = permuted(k % blocks, blocks, plan.keys(src, k // blocks))
            words = np.where(k == plan.slots[src] - 1, plan.last_words[src], plan.block_words)
            size = np.minimum(plan.shard_slots, total - shard[of] * plan.shard_slots)
            slot = permuted(at[of] + nth, size, plan.keys(shard[of], np.full(len(of), MOST_SOURCES)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[of], slot, src.astype(np.int32), block, words)], ["shard", "slot", "source_no", "block", "words"])

    return rows.mapInArrow(run, "shard long, slot long, source_no int, block long, words long")


def mix(
    docs: DataFrame, weights: Callable[[Sequence[str | None]], Sequence[int]] = one_two_three, block_words: int = 128, shard_slots: int = 1024, most_repeats: int = 3, seed: int = 13, with_texts: bool = False
) -> Mix:
    """The mix of all documents; ``weights`` gives a positive weight to each of the sources, sorted, null last."""
    ordered = in_order(docs, with_texts)
    plan = planned(ordered, weights, block_words, shard_slots, most_repeats, seed)
    placed = numbered(ordered, plan)
    return Mix(plan, placed, pieces(placed, block_words), slots_of(docs.sparkSession, plan))
