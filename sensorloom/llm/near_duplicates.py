"""MinHash near-duplicates by HyperMinHash: compressed registers, banding, estimate, then full sets.

1. Words become 64-bit hashes, runs of ``words_a_shingle`` words the shingle set of a document. Documents
   with equal sets are one class from here on, represented by their least doc_id.
2. Each of ``bands * rows`` registers holds, for one hash function, the least hash of the set as its count
   of leading zeros and the ``MANTISSA`` bits after it: 16 bits.
3. Registers of a band make its key. Classes that share a key are candidates: each with the centre of its
   bucket first (the class with most shared keys), later (4) also others. With 48 bands of 6 registers a pair at similarity 0.8 shares no key
   with probability under 1e-6.
4. Each class meets the most shared of its centres first; pairs within a component need no test after that.
   A candidate pair is first held against the Jaccard estimate from its registers, corrected for registers
   that collide by chance, with a margin of over eight standard deviations; then the full sets (64 bits for each
   shingle) decide.
   Buckets that still hold classes of different components are compared across the components, as far as an
   exact bound allows a link (see ``across``).
5. Components come from alternating star steps over the link table.

Nulls: documents without words link with nothing; a null doc_id (or one that is no integer) is ignored by the
linking and returned as its own component (null). Rows with equal doc_id and different texts share one component. Empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import shared
from sensorloom.llm.components import components

MANTISSA = 10
SALT = np.uint64(0x9E3779B97F4A7C15)
#: Elements of a block of hash values: small enough for the processor's cache.
BLOCK = 1 << 17

_words = shared.WordHashes(shared.hash64)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; texts with fewer words have one shingle of all of them."""
    words = shared.ascii_words(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = shared.mix64(_words.array(words, np.uint64))
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = shared.mix64(out * SALT + h[k : len(h) - size + 1 + k])
        return np.unique(shared.mix64(out + np.uint64(size)))


LOWER = {c: c + 32 for c in range(65, 91)}


def multipliers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = shared.mix64(np.arange(1, 2 * registers + 1, dtype=np.uint64) * SALT)
    return seeds[:registers] | np.uint64(1), seeds[registers:]


def registers(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: for each function the least hash as leading zeros (6 bits) and mantissa (10 bits)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK // max(1, len(a)))
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), step):
            part = a[:, None] * shingles[None, k : k + step]
            part += b[:, None]
            np.minimum(least, part.min(axis=1), out=least)
    exponent = np.frexp(least.astype(np.float64))[1]  # bits in use; rounding up to a power of two is harmless
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    shifted = (least << zeros) << np.uint64(1)
    return (zeros << np.uint64(MANTISSA) | shifted >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def chance_collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two unrelated sets agree: their minima share zeros and mantissa."""
    z = np.arange(0, 54)[:, None, None]
    low = 2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA)[None, :, None] / (1 << MANTISSA))
    high = low + 2.0 ** -(z + 1 + MANTISSA)
    p = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return (p(n[None, None, :]) * p(m[None, None, :])).sum(axis=(0, 1))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, set_lo/set_hi (name of the set) and band keys; documents without words have no bands."""
    schema = "id long, n_shingles long, set_lo long, set_hi long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(bands * rows)
        weights = shared.mix64(np.arange(1, rows + 1, dtype=np.uint64) * SALT) | np.uint64(1)
        marks = shared.mix64(np.arange(1, bands + 1, dtype=np.uint64))
        empty = np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                n, lo, hi, keys = [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, size)
                    n.append(len(s))
                    lo.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    hi.append(int(np.bitwise_xor.reduce(shared.mix64(s ^ SALT)).astype(np.int64)) if len(s) else 0)
                    if len(s):
                        r = registers(s, a, b).reshape(bands, rows).astype(np.uint64)
                        keys.append(shared.mix64((shared.mix64(r + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64) + marks).astype(np.int64))
                    else:
                        keys.append(empty)
                ends = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([empty, *keys])))], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("id"), shared.text_or_empty().alias("text")).mapInArrow(sign, schema)


def unpacked(raw: bytes) -> np.ndarray:
    """A full set, 64 bits for each shingle, from its bytes."""
    return np.frombuffer(raw, np.uint64)


def shingle_sets(pairs: DataFrame, docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, s (full set) and r (registers) of every document in the pairs (a, b), as a table.

    Joined by merging whatever the sizes, so that the work grows evenly with the input; texts travel squeezed.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = shared.squeezed(docs.select(F.col("doc_id").cast("long").alias("id"), shared.text_or_empty().alias("text")).where("id is not null"), "id")
    texts = texts.join(wanted.hint("merge"), "id").select("id", "z")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(bands * rows)
        for batch in shared.sliced(batches):
            s = [shingle_set(t.decode(), size) for t in shared.bytes_of(batch.column("z").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([registers(x, a, b).tobytes() for x in s], pa.binary())], ["id", "s", "r"])

    return shared.stored(texts.mapInArrow(sets, "id long, s binary, r binary"), "shingle-sets", free=True)


def verified(pairs: DataFrame, known: DataFrame, bands: int, rows: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = known.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("r").alias("ra"))
    right = known.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("r").alias("rb"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, share = bands * rows, percent / 100
        margin = 8.5 * (share * (1 - share) / total) ** 0.5
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            agree = np.array([np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)) for x, y in zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), strict=True)]) / total
            sizes = [np.array([len(x) // 8 for x in batch.column(c).to_pylist()], float) for c in ("sa", "sb")]
            # Sizes are rounded to powers of two for the correction, which hardly depends on them.
            chance = _chances(*sizes)
            estimate = (agree - chance) / (1 - chance)
            likely = estimate >= share - margin
            for ok, x, y in zip(likely, batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                if ok:
                    u, v = unpacked(x), unpacked(y)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    ok = 100 * common >= percent * (len(u) + len(v) - common)
                keep.append(bool(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "ra", "rb").mapInArrow(hold, "a long, b long")


_chance: dict[tuple[int, int], float] = {}


def _chances(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = []
    for x, y in zip(np.log2(np.maximum(n, 1)).astype(int).tolist(), np.log2(np.maximum(m, 1)).astype(int).tolist(), strict=True):
        if (x, y) not in _chance:
            _chance[x, y] = float(chance_collision(np.array([2.0**x]), np.array([2.0**y]))[0])
        out.append(_chance[x, y])
    return np.array(out)


def deltas(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of (centre, id, c): ``delta`` (shingles that only one of id and centre has), w, and ``cost``.

    w > 0 if id is too far from the centre to be linked with it, by as much; ``cost``: 100 for each shingle of the centre
    that id lacks, ``percent`` for each other one of its delta.
    """
    left = known.select(F.col("id").alias("centre"), F.col("s").alias("sa"))
    right = known.select("id", F.col("s").alias("sb"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            delta, w, cost = [], [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                u, v = unpacked(x), unpacked(y)
                both = np.setxor1d(u, v, assume_unique=True)
                extra = (len(both) + len(v) - len(u)) // 2
                missing = len(both) - extra
                delta.append(both.view(np.int64))
                cost.append(100 * missing + percent * extra)
                w.append(cost[-1] - (100 - percent) * len(u))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("centre", "id", "c")), pa.array(w, pa.int64()), pa.array(cost, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], ["centre", "id", "c", "w", "cost", "delta"])

    return pairs.join(left, "centre").join(right, "id").select("centre", "id", "c", "sa", "sb").mapInArrow(differ, "centre long, id long, c long, w long, cost long, delta array<long>")


def across(buckets: DataFrame, groups: DataFrame, known: DataFrame, percent: int, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, not ``tried`` yet, that share a bucket and may still be similar; a table.

    Both have been compared with their bucket's centre h, and at least one, c, is too far from it. From the sizes of
    intersection and union, c and b are similar exactly if (100 + percent) * s >= w(c) + cost(b), where s counts the
    shingles in both deltas; the right side is the same with c and b exchanged. Let a pair need s shingles, and each delta
    be sorted with the rarest first. The first shingle that both have is followed by s - 1 others in both, so no more than
    s - 1 places before an end: pairs are looked up by shingles at such places only. Near copies of one text differ from
    it in different places and have to share most of their deltas to be similar, so few pairs come of this, however
    many copies there are; it loses none.
    """
    labelled = shared.stored(buckets.select("key", "id", "centre").join(groups, "id", "left").select("key", "id", "centre", F.coalesce("component_id", "id").alias("c")), "labelled")
    mixed = shared.stored(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "mixed-keys")
    apart = labelled.where("id <> centre").join(mixed.hint("merge"), "key").select("centre", "id", "c").distinct()
    rows = shared.stored(deltas(apart, known, percent), "deltas")
    shared.discard(labelled, mixed)
    shingles = rows.select("centre", "id", "c", "w", "cost", F.size("delta").alias("d"), F.explode("delta").alias("e"))
    counts = shared.stored(shingles.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("n")), "delta-counts")
    # A window holds one delta: no more rows than two sets have shingles.
    shingles = shingles.join(counts.hint("merge"), ["centre", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("centre", "id").orderBy("n", "e"))).where("n > 1")
    shingles = shared.stored(shingles.withColumn("after", F.col("d") - F.col("rank")), "delta-shingles")
    shared.discard(rows, counts)
    need = lambda x: F.ceil(x / (100 + percent))
    far = shingles.where((F.col("w") > 0) & (F.col("after") + 1 >= need(F.col("w") + 1))).select("centre", "e", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("w").alias("wa"), F.col("after").alias("pa"))
    near = shingles.where(F.col("after") + 1 >= need(F.col("cost") + 1)).select("centre", "e", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("w").alias("wb"), F.col("cost").alias("kb"), F.col("after").alias("pb"))
    # Of two far ones either may be b: one of the two rows is enough.
    may = (F.col("ca") != F.col("cb")) & ((F.col("wb") <= 0) | (F.col("a") < F.col("b"))) & (F.least("pa", "pb") + 1 >= need(F.col("wa") + F.col("kb")))
    both = far.join(near, ["centre", "e"]).where(may)
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = shared.stored(both.join(tried, ["a", "b"], "left_anti"), "pairs-across", free=True)
    shared.discard(shingles)
    return pairs


def between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("id").alias(end), F.col("component_id").alias("c" + end)), end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    return pairs.where("ca <> cb").select("a", "b")


def classes_of(signed: DataFrame) -> DataFrame:
    """id, n_shingles and class_id (least id with the same set) of every row.

    Only sets that several rows have are joined back, from a table, so that a large group of copies can be split.
    """
    real = signed.where("n_shingles > 0 and id is not null").select("id", "n_shingles", "set_lo", "set_hi")
    shared_sets = real.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min("id").alias("class_id"), F.max("id").alias("last")).where("class_id < last").drop("last")
    named = shared.stored(shared_sets, "equal-sets")
    rows = signed.select("id", "n_shingles", "set_lo", "set_hi").join(named.hint("merge"), ["set_lo", "set_hi", "n_shingles"], "left")
    members = shared.stored(rows.select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id")), "members")
    shared.discard(named)
    return members


def bucketed(signed: DataFrame, members: DataFrame) -> DataFrame:
    """key, id, centre and shared: the classes of every bucket of two or more, with the centre of the bucket.

    The centre is the class that shares most keys in all: the likely origin of its near copies. Counts and
    centres are aggregations combined on the map side and joined back from tables, which splits a hot bucket.
    """
    copies = members.where("id <> class_id").select("id").distinct()
    classes = signed.where("n_shingles > 0 and id is not null").select("id", "bands").join(copies.hint("merge"), "id", "left_anti")
    keys = classes.select("id", F.explode("bands").alias("key"))
    counts = shared.stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key-counts")
    shares = shared.stored(keys.join(counts.hint("merge"), "key"), "key-shares")
    known = shares.groupBy("id").agg(F.sum("n").alias("shared"))
    ranked = shared.stored(shares.select("key", "id").join(known, "id"), "key-ranks")
    centres = ranked.groupBy("key").agg(F.max(F.struct("shared", (-F.col("id")).alias("minus"))).alias("top"))
    centres = shared.stored(centres.select("key", (-F.col("top.minus")).alias("centre"), F.col("top.shared").alias("shared")), "centres")
    buckets = shared.stored(ranked.select("key", "id").join(centres.hint("merge"), "key"), "buckets", free=True)
    shared.discard(counts, shares, ranked, centres)
    return buckets


def near_duplicates(docs: DataFrame, words_a_shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and ``kept`` of every row of ``docs``."""
    signed = shared.stored(signatures(docs, words_a_shingle, bands, rows), "signatures")
    members = classes_of(signed)  # one class for each set of shingles
    buckets = bucketed(signed, members)
    shared.discard(signed)
    near = buckets.where(F.col("centre") != F.col("id")).select("id", "centre", "shared").distinct()
    best = near.groupBy("id").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("best"))
    ordered = near.join(best, "id").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"), (F.col("centre") == F.col("best")).alias("first"))
    pairs = shared.stored(ordered.groupBy("a", "b").agg(F.bool_or("first").alias("first")), "pairs")
    known = shingle_sets(pairs, docs, words_a_shingle, bands, rows)
    same = members.where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    # First every class with the best of its centres, then with the others as far as they are apart still.
    links = shared.stored(verified(pairs.where("first").select("a", "b"), known, bands, rows, percent), "links", free=True).unionByName(same)
    groups = components(links)
    apart = between(pairs.where("not first").select("a", "b"), groups)
    links = links.unionByName(shared.stored(verified(apart, known, bands, rows, percent), "links"))
    groups = components(links)
    rest = across(buckets, groups, known, percent, pairs)
    shared.discard(buckets, pairs)
    more = shared.stored(verified(rest, known, bands, rows, percent), "links")
    shared.discard(known, rest)
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    out = members.join(groups, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component of ``docs``, all columns as they came: of the rows with its least doc_id, that of least text.

    Rows without a doc_id or without words all stay.
    """
    gone = near_duplicates(docs, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id")).distinct()
    once = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone_id"), "left_anti")
    # Rows that share a doc_id are rare: only they are sorted.
    again = once.groupBy(F.col("doc_id").alias("__again_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __again_id is not null").select("__again_id")
    again = shared.stored(again, "repeated-ids")
    same = F.col("doc_id") == F.col("__again_id")
    first = once.join(again, same, "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__nth = 1").drop("__nth")
    return once.join(again, same, "left_anti").unionByName(first)
