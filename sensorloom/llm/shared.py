"""What the corpus operators share: shared-folder tables, row keys and word hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sort key of a null doc_id: after every real one.
NO_ID = (1 << 63) - 1

_own_folder: str | None = None
#: Tables that this session has stored, in order; None once they are dropped.
_made: list[str | None] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="spark-")
        folder = _own_folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives a lost executor.

    ``free``: also lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, which
    otherwise stay until the driver next collects garbage.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    df.write.options(compression="zstd").parquet(path)
    _made.append(path)
    if free:
        del df
        for _ in range(2):  # the plans go first, then the shuffles that only they held
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made; nothing that is still to be computed may read them."""
    for table in tables:
        k = _made.index(table.stored_at)
        drop(table.sparkSession, k, k + 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def order_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: the id as text, or without one the digest of the row's text."""
    return F.when(F.col(key).isNull(), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).otherwise(F.col(key).cast("string"))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to hash, kept while it is small; a new word is computed once by ``make``."""

    LIMIT = 200_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = self.make(word)
        return value

    def array(self, words: list[str], dtype) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))

    def words_of(self, lists: pa.ListArray, dtype) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words of lists of words, and where each list starts and ends."""
        cuts = lists.offsets.to_numpy()
        coded = lists.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0])).dictionary_encode()
        known = self.array(coded.dictionary.to_pylist(), dtype)
        return (known[coded.indices.to_numpy()] if len(known) else known), cuts - cuts[0]


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


SPACES = re.compile(r"[ \t-\r]+")


def ascii_words(text: str) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return [w for w in SPACES.split(text) if w]


def mark() -> int:
    """A place in the list of stored tables, for ``drop``."""
    return len(_made)


def drop(spark: SparkSession, start: int, end: int) -> None:
    """Deletes the tables stored between two marks; nothing that is still to be computed may read them."""
    for k in range(start, end):
        if _made[k]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_made[k])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _made[k] = None


def squeezed(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``z``: the text by zstd, for texts that have to be shuffled."""
    rows = rows.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches):
            z = [squeeze(t.encode("utf-8")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(z, pa.binary())], [*keep, "z"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, z binary")


def bytes_of(z: list[bytes]) -> list[bytes]:
    """The UTF-8 texts of a column that ``squeezed`` made."""
    open_up = zstandard.ZstdDecompressor().decompress
    return [open_up(x) for x in z]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``: bounds what is unpacked at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
