"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

1. Words (lower case, letters and digits only) become 32-bit ids, kept per document in a table; passages are
   runs of ``PASSAGE`` words. One aggregation counts the passages of each of ``BUCKETS`` hashed words.
2. Randomised SVD of the TF-IDF passage matrix A over all documents: one pass sums A'(A W) for a random W with
   ``rank + OVERSAMPLE`` columns; the driver, which holds BUCKETS x rank numbers whatever the input, gets the
   right singular vectors from that (Nystroem).
3. Passages, now overlapping by half, and benchmark items are mapped to the latent space (whitened by the
   singular values); pairs with a cosine of at least ``min_cosine`` are candidates. All documents that hold enough
   answer terms (see 4) of an item anywhere are searched whole, against the benchmark in blocks of ``block_items``.
   No item is lost by its cosine: a document that holds enough of an item's answer terms, but got no hit from
   these candidates, has every passage tried around which enough of the item's words stand.
4. A candidate counts if the longest common subsequence of the item and the words around the passage has at
   least ``min_lcs`` of the item's words, so that changed or added words do not hide it, and if at least
   ``min_answer`` of the item's answer terms (its rarest words) are there.

Nulls: null texts have no words; items without words are skipped; null doc_ids are kept in the result. Each
row of the documents is judged by itself; repeated items are reported each. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared

PASSAGE, BUCKETS, OVERSAMPLE = 32, 1 << 14, 8
ANSWER_TERMS = 6
STEP = PASSAGE // 2
#: Words whose rows are handled at once: bounds the memory of a task.
WORDS_AT_ONCE = 1 << 15


def word_ids(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of all words of lists of words (0: nothing left of it), and where each list starts and ends."""
    cuts = lists.offsets.to_numpy()
    coded = lists.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0])).dictionary_encode()
    cores = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pN]+", "").to_pylist()
    if not cores:
        return np.zeros(0, np.uint32), cuts - cuts[0]
    known = np.maximum(pd.util.hash_array(np.array(cores, object), categorize=False).astype(np.uint32), 1)
    known[np.array([not c for c in cores])] = 0
    return known[coded.indices.to_numpy()], cuts - cuts[0]


def with_words(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and the word ids of each text, as a table."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, 3000):
            ids, cuts = word_ids(pc.utf8_split_whitespace(batch.column("text")))
            words = [x[x > 0].tobytes() for x in np.split(ids, cuts[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(words, pa.binary())], [key, "words"])

    return rows.select(key, shared.text_or_empty().alias("text")).mapInArrow(run, f"{key} {kind}, words binary")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Passages of all documents as rows of buckets, a block at a time; -1 fills a document's last passage."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column("words").to_pylist():
            w = np.frombuffer(raw, np.uint32)
            if len(w):
                rows = np.full(-(-len(w) // PASSAGE) * PASSAGE, -1, np.int64)
                rows[: len(w)] = w & (BUCKETS - 1)
                held.append(rows)
                size += len(rows)
            if size >= WORDS_AT_ONCE:
                yield np.concatenate(held).reshape(-1, PASSAGE)
                held, size = [], 0
    if held:
        yield np.concatenate(held).reshape(-1, PASSAGE)


def passage_counts(words: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each bucket, and passages in all, over every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for rows in blocks(batches):
            rows = np.sort(rows, axis=1)
            new = np.c_[np.ones(len(rows), bool), rows[:, 1:] != rows[:, :-1]] & (rows >= 0)
            seen += np.bincount(rows[new], minlength=BUCKETS)
            n += len(rows)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], ["bucket", "n"])

    sums = words.select("words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()  # the last place (-1) holds the number of passages
    return out[:-1], int(out[-1])


def sketch(words: DataFrame, idf: np.ndarray, columns: int) -> np.ndarray:
    """A'(A W) for a seeded normal W; A: passages by buckets, rows of TF-IDF weights with norm 1."""
    w = np.random.default_rng(11).standard_normal((BUCKETS + 1, columns)).astype(np.float32)
    w[-1] = 0
    weight = np.r_[idf, 0].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, BUCKETS + 1))
        weighted = w * weight[:, None]
        for rows in blocks(batches):
            scale = 1 / np.maximum((weight[rows] ** 2).sum(axis=1), 1e-12)
            image = weighted[rows].sum(axis=1) * scale[:, None]
            flat = rows.ravel()  # -1, the filling of last passages, is the last bucket, which has no weight
            flat = np.where(flat < 0, BUCKETS, flat)
            for k in range(columns):
                total[k] += np.bincount(flat, np.repeat(image[:, k], PASSAGE), BUCKETS + 1)
        total = total.T.astype(np.float32)
        total *= weight[:, None]
        used = np.flatnonzero(total[:-1].any(axis=1))
        flat = pa.array(total[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * columns, pa.int32()), flat)], ["bucket", "y"])

    parts = words.select("words").mapInArrow(run, "bucket long, y array<float>")
    sums = parts.groupBy("bucket").agg(F.array(*(F.sum(F.col("y")[i].cast("double")) for i in range(columns))).alias("y")).toArrow()
    y = np.zeros((BUCKETS, columns))
    if sums.num_rows:
        y[sums["bucket"].to_numpy()] = np.array(sums["y"].to_pylist())
    return y, w[:-1].astype(float)


def latent_space(words: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """idf and the whitened map of buckets (BUCKETS + 1, rank) to the latent space, idf included."""
    df, n = passage_counts(words)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    y, w = sketch(words, idf, rank + OVERSAMPLE)
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * w
    core = w.T @ y
    core_values, core_vectors = np.linalg.eigh((core + core.T) / 2)
    good = core_values > max(1e-12, 1e-9 * core_values.max())
    if not good.any():  # no words at all
        return idf, np.zeros((BUCKETS + 1, rank), np.float32)
    vectors, values, _ = np.linalg.svd(y @ core_vectors[:, good] / np.sqrt(core_values[good]), full_matrices=False)
    rank = min(rank, len(values))
    singular = np.sqrt(np.maximum(values**2 - shift, 1e-9))[:rank]
    return idf, np.r_[vectors[:, :rank] / np.maximum(singular, 1e-3 * singular.max()) * idf[:, None], np.zeros((1, rank))].astype(np.float32)


def common_subsequence(item: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``item``: for each word the bits of its places."""
    row = (1 << size) - 1
    full = row
    for w in words:
        u = row & item.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rank: int = 40, min_cosine: float = 0.3, min_lcs: float = 0.65, min_answer: float = 0.5, block_items: int = 20_000
) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words) and answer (share of its answer terms)."""
    spark = docs.sparkSession
    words = shared.stored(with_words(docs, "doc_id"), "words")
    idf, to_latent = latent_space(words, rank)
    n_blocks = max(1, -(-benchmark.count() // block_items))
    items = with_words(benchmark, "item_id").where(F.length("words") > 0)
    items = shared.stored(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))), "items")
    doc_kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((words, "doc_id"), (items, "item_id")))
    out = spark.createDataFrame([], f"doc_id {doc_kind}, item_id {item_kind}, cosine double, lcs double, answer double")
    for block in range(n_blocks):  # one block of the benchmark at a time is on the driver and in the tasks
        found = items.where(F.col("block") == block).select("item_id", "words").toArrow()
        names, raw = found["item_id"].to_pylist(), [np.frombuffer(x, np.uint32) for x in found["words"].to_pylist()]
        if names:
            hits = searched(words, names, raw, idf, to_latent, (min_cosine, min_lcs, min_answer), out.schema)
            out = out.unionByName(shared.stored(hits, "hits") if n_blocks > 1 else hits)
    return out


def searched(words: DataFrame, names: list, raw: list[np.ndarray], idf: np.ndarray, to_latent: np.ndarray, limits: tuple[float, float, float], schema) -> DataFrame:
    min_cosine, min_lcs, min_answer = limits

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    vectors = unit(np.array([to_latent[x & (BUCKETS - 1)].sum(axis=0) for x in raw], np.float32)).T.copy()
    # Answer terms of all items in one sorted list, each with its item.
    rarest = [np.unique(x)[np.argsort(-idf[np.unique(x) & (BUCKETS - 1)], kind="stable")][:ANSWER_TERMS] for x in raw]

    terms, owner = np.concatenate(rarest), np.repeat(np.arange(len(rarest)), [len(x) for x in rarest])
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    needed = min_answer * np.array([len(x) for x in rarest])

    low = np.zeros(1 << 16, bool)  # a word whose low bits no term has is no term
    low[terms & 0xFFFF] = True

    def answered(words: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """For each document of a block, the items of which it holds enough answer terms anywhere."""
        some = np.flatnonzero(low[words & 0xFFFF])
        words, doc = words[some], doc[some]
        at, end = (np.searchsorted(terms, words, side) for side in ("left", "right"))
        hit = end > at
        at, n, doc = at[hit], (end - at)[hit], doc[hit]
        rows = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.repeat(doc, n) * len(terms) + rows)  # a term counts once in a document
        cells = pairs // len(terms) * len(needed) + owner[pairs % len(terms)]
        return np.bincount(cells, minlength=docs * len(needed)).reshape(docs, -1) >= needed

    def verify(near: np.ndarray, i: int, cosine: float) -> tuple[float, float, float] | None:
        """(lcs, answer, cosine) of an item and the words around a passage, if they are enough."""
        answer = float(np.isin(rarest[i], near).mean())
        if answer < min_answer:
            return None
        if i not in places:
            places[i] = {}
            for k, x in enumerate(raw[i].tolist()):
                places[i][x] = places[i].get(x, 0) | 1 << k
        lcs = common_subsequence(places[i], len(raw[i]), near.tolist()) / len(raw[i])
        return (lcs, answer, cosine) if lcs >= min_lcs else None

    def search(texts: list[np.ndarray]) -> Iterator[tuple[int, int, tuple]]:
        """(document, item, (lcs, answer, cosine)) of a block of documents, the best passage of each."""
        sizes = np.array([len(w) for w in texts])
        doc = np.repeat(np.arange(len(texts)), sizes)
        words = np.concatenate(texts)
        possible = answered(words, doc, len(texts))
        # Documents without the answer terms of any item are no candidates: their passages are not mapped.
        (some,) = np.nonzero(possible.any(axis=1))
        if not len(some):
            return
        numbers, texts, possible, sizes = some, [texts[k] for k in some], possible[some], sizes[some]
        words = np.concatenate(texts)
        # Half passages are summed once; a passage is two neighbours of one document.
        counts = -(-sizes // STEP)
        begin = np.cumsum(sizes) - sizes
        owner_of_half = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        halves = np.add.reduceat(to_latent[words & (BUCKETS - 1)], np.repeat(begin, counts) + nth * STEP, axis=0)
        last = np.r_[owner_of_half[1:] != owner_of_half[:-1], True]
        full = halves.copy()
        full[:-1][~last[:-1]] += halves[1:][~last[:-1]]
        use = np.flatnonzero(~last | (nth == 0))
        passages = full[use]
        starts = np.searchsorted(owner_of_half[use], np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple] = {}
        for d, i in zip(*np.nonzero(possible), strict=True):
            mine, size = slice(int(starts[d]), int(starts[d + 1])), len(raw[i])
            begin = nth[use[mine]] * STEP
            low, high = np.maximum(begin - size, 0), np.minimum(begin + PASSAGE + size, len(texts[d]))
            # How many words around a passage the item has bounds their common subsequence.
            sums = np.r_[0, np.cumsum(np.isin(texts[d], raw[i]))]
            enough = sums[high] - sums[low] >= min_lcs * size
            if not enough.any():
                continue
            cosines = unit(passages[mine]) @ vectors[:, i]
            found = None
            # Candidates by cosine first; only where none of them holds the item, the others.
            for tried in (enough & (cosines >= min_cosine), enough & (cosines < min_cosine)):
                for k in np.flatnonzero(tried).tolist():
                    hit = verify(texts[d][low[k] : high[k]], int(i), float(cosines[k]))
                    found = max(found, hit) if found and hit else found or hit
                    if found and found[0] >= 1.0:
                        break
                if found:
                    best[int(d), int(i)] = found
                    break
        for (d, i), found in sorted(best.items()):
            yield int(numbers[d]), int(i), found

    places: dict[int, dict[int, int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            texts = [np.frombuffer(x, np.uint32) for x in batch.column("words").to_pylist()]
            todo = [k for k, w in enumerate(texts) if len(w)]
            while todo:  # as many documents as make a block, at least one
                n = max(1, int(np.searchsorted(np.cumsum([len(texts[k]) for k in todo[:400]]), WORDS_AT_ONCE)))
                part, todo = todo[:n], todo[n:]
                hits += [(ids[part[d]], names[i], cosine, lcs, answer) for d, i, (lcs, answer, cosine) in search([texts[k] for k in part])]
            if hits:
                columns = [*map(list, zip(*hits, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1]), *(pa.array(c, pa.float64()) for c in columns[2:])], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return words.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents in which no benchmark item was found, all columns as they came.

    Rows are told apart by doc_id; those without one by their texts.
    """
    keyed = docs.select(shared.row_key().alias("doc_id"), "text")
    found = contaminated(keyed, benchmark, **settings).select(F.col("doc_id").alias("__found_id")).distinct()
    return docs.join(found, shared.row_key() == F.col("__found_id"), "left_anti")
