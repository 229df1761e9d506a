"""Suffix-array dedup: removes bytes covered by a string of ``length`` bytes that also starts in an earlier document.

Prefix doubling over text positions, with Spark sorting names (64-bit ranks) of growing prefixes:

1. Level ``stem`` (28 bytes for windows of 50). Of the stems inside each window the one of least name is the
   window's anchor (the leftmost if equal). Equal windows have equal anchors at equal places, so anchors
   stand for all windows at about a twelfth of the positions. Sorted by name, anchors whose stem starts in
   one document only are unique: their windows are settled, and they leave.
2. Past ``length``. Each remaining anchor is extended over all the windows that it stands for: its name is
   paired with the bytes left and right of the stem. Sorted by these pairs, an extension seen in an earlier
   document settles all its windows as repeated; one without any differing partner settles them as new.
3. At ``length``. What is left (the ends of repeated runs) is expanded to single windows, which are sorted and
   settled one by one.

Settled windows are gathered per document and joined back to the texts. Every level works on whole texts and
all documents; nothing is capped, and a string's documents are only ever compared with their least.

Nulls: a null text is an empty text; a null doc_id counts as later than all others. Rows with equal doc_id do
not remove each other. Texts shorter than ``length`` keep everything. Empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import shared

BYTE_NAMES = shared.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PAIR = np.uint64(0xD6E8FEB86659FD93)
HIGH = np.uint64(0xFFFFFFFF00000000)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of longer strings from the names of their two parts."""
    out = left * PAIR
    out ^= out >> np.uint64(32)
    out += right
    out *= PAIR
    out ^= out >> np.uint64(29)
    return out


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by doubling."""
    power, size, out, done = BYTE_NAMES[data], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                out = power if out is None else paired(out[: len(power) - done], power[done:])
                done += size
            if done == length:
                return out
            power = paired(power[:-size], power[size:])
            size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def stem_of(length: int) -> int:
    """Bytes of a stem: long enough to be rarely repeated by chance, short enough to leave few anchors."""
    return max(1, length * 14 // 25)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, place, first and last window of each anchor of the text, in order."""
    stem, n = stem_of(length), len(text)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    h = names(np.frombuffer(text, np.uint8), stem)
    key = (h & HIGH) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(key, length - stem + 1) & ~HIGH).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    place = place[first]
    return h[place], place, first, last


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """id, th (hash of the text), start, n: runs of windows of a row that also start in an earlier document."""
    stem = stem_of(length)
    around = length - stem  # bytes of a window besides its stem

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("id").to_numpy(), [np.unique(anchors(t.encode("utf-8"), length)[0]) for t in batch.column("text").to_pylist()]
            if found:
                g = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in found]))], ["g", "id"])

    by_name = Window.partitionBy("g")
    level1 = docs.select("id", "text").mapInArrow(emit, "g long, id long")
    level1 = level1.withColumn("lo", F.min("id").over(by_name)).withColumn("hi", F.max("id").over(by_name)).where("lo < hi").select("g", "id")
    began = shared.mark()
    level1 = shared.stored(level1, "anchors", free=True)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches):
            lists = batch.column("names")
            flat, cuts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for k, (d, th, data) in enumerate(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), shared.bytes_of(batch.column("z").to_pylist()), strict=True)):
                g, place, first, last = anchors(data, length)
                (use,) = np.nonzero(np.isin(g, flat[cuts[k] : cuts[k + 1]]))
                if len(use):
                    first, last = first[use], last[use]
                    place = place[use]
                    # The stem is left out: its name stands for it.
                    sides = [data[i:p] + data[p + stem : j] for i, p, j in zip(first.tolist(), place.tolist(), (last + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(g[use].view(np.int64)), pa.array((place - first).astype(np.int32)), pa.array(sides, pa.binary()), pa.array(np.full(len(use), d)), pa.array(np.full(len(use), th, np.int32)), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["g", "left", "sides", "id", "th", "start", "n"])

    wanted = level1.groupBy("id").agg(F.collect_set("g").alias("names"))
    level2 = shared.squeezed(docs, "id", "th").join(wanted, "id").select("id", "th", "z", "names").mapInArrow(extend, "g long, left int, sides binary, id long, th int, start int, n int")
    level2 = level2.withColumn("s", F.xxhash64("sides", "left"))
    by_pair = Window.partitionBy("g", "s")
    level2 = level2.withColumns({"least": F.min("id").over(by_pair), "s_lo": F.min("s").over(by_name), "s_hi": F.max("s").over(by_name)})
    new = F.col("least") == F.col("id")
    level2 = level2.where("least < id or s_lo < s_hi").select("id", "th", "start", "n", *(F.when(new, F.col(c)).alias(c) for c in ("g", "left", "sides")))
    level2 = shared.stored(level2, "extensions", free=True)
    shared.drop(docs.sparkSession, began, began + 1)

    whole = level2.where("sides is null").select("id", "th", "start", "n")
    single = level2.where("sides is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    window = F.col("sides").substr(F.col("i") + 1, F.lit(around))
    single = single.select("id", "th", (F.col("start") + F.col("i")).alias("start"), F.xxhash64("g", F.col("left") - F.col("i"), window).alias("w"), F.hash("g", window, F.col("left") - F.col("i")).alias("v"))
    single = single.withColumn("least", F.min("id").over(Window.partitionBy("w", "v"))).where("least < id").select("id", "th", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, length: int = 50, *keep: str, whole_characters: bool = False) -> DataFrame:
    """doc_id, ``keep`` columns, n_bytes, n_removed, n_spans, ``spans`` (start, end of removed runs) and ``kept`` (bytes left).

    ``whole_characters``: runs shrink to whole UTF-8 characters, so that what is kept stays valid text.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    rows = docs.select("doc_id", *keep, shared.order_id().alias("id"), shared.text_or_empty().alias("text")).withColumn("th", F.hash("text"))
    runs = repeated_windows(rows, length).groupBy("id", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    joined = shared.squeezed(rows, "id", "th", "doc_id", *keep).join(runs, ["id", "th"], "left").select("doc_id", *keep, "z", "starts", "ns")
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    columns = ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for data, starts, ns in zip(shared.bytes_of(batch.column("z").to_pylist()), batch.column("starts").to_pylist(), batch.column("ns").to_pylist(), strict=True):
                runs, kept = [], data
                if starts:
                    edge = np.zeros(len(data) + 1, np.int64)
                    at = np.array(starts, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array(ns, np.int64) - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    if whole_characters:
                        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                        gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.r_[heads, len(data)]))
                    turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    runs = [{"start": i, "end": j} for i, j in turns.reshape(-1, 2).tolist()]
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, v in zip(out, (len(data), len(data) - len(kept), len(runs), runs, kept), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], span), pa.array(out[4], pa.binary())], columns)

    return joined.mapInArrow(cut, schema + ", n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; other columns as they came, but n_chars counted anew.

    A character of several bytes goes only as a whole: a removed run that ends inside one leaves it. Null texts
    stay null, documents of which nothing is left stay with an empty text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The other columns travel in one, so that their names cannot clash with this operator's.
    kept = F.struct(F.col("text").isNull().alias("null_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = remove_repeats(docs.select("doc_id", "text", kept.alias("_row")), length, "_row", whole_characters=True)
    text = F.when(~F.col("_row.null_text"), F.decode("kept", "UTF-8"))
    made = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_row.c{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        made["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(made[c].alias(c) for c in docs.columns))
