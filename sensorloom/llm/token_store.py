"""Token-ID output: Parquet files of id lists, in document order, with page indexes for selective reads.

Layout, one row per document, files in ascending ``doc_id``:

* ``ids`` LIST<INT>: dictionary-encoded, so bit-packed at the width of the vocabulary in use;
* ``doc_id``, ``local_start``: plain columns that ascend, so DELTA_BINARY_PACKED with tight page indexes;
* ``shard``: the file's number, ``n_tokens``: length with the end id; any metadata columns asked for.

A reader of some documents or of metadata alone touches only the pages and columns it needs. A document's
place in the whole stream is the total of the shards before its own plus ``local_start``.

Nulls: a null text is an empty text (only the end id); null ids sort first. Repeated ids keep all their
rows, ordered by a hash of the text. An empty table gives a store without rows. Extra columns of the input
are ignored unless named as metadata.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import shared, tokens

def writer_options(row_group_mb: int = 64, page_kb: int = 256, page_rows: int = 1000) -> dict[str, str]:
    """Parquet settings of the store: version 2 pages (delta encodings), row-group and page sizes."""
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": str(page_rows),
    }


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, metadata: Sequence[str] = (), **sizes: int) -> None:
    """Tokenise every whole text and write the store to ``path``.

    One range shuffle of the texts puts documents in order; ids are made after it and written straight away.
    """
    spark = docs.sparkSession
    meta = [docs.schema[c] for c in metadata]
    rows = docs.select(F.col("doc_id").cast("long"), shared.text_or_empty().alias("text"), *metadata)
    rows = rows.repartitionByRange(shared.partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()), *meta, T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in tokens.slices(batches):
            ids, ends = enc.encode_batch(batch.column("text"), end_id)
            n = np.diff(ends)
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends[:-1]), pa.array(n.astype(np.int32)), *(batch.column(f.name) for f in meta), tokens.list_of(ids, ends)]
            at += len(ids)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows.mapInArrow(encode, schema).write.options(**writer_options(**sizes)).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with ``start``: the number of ids before the document in the whole stream.

    Only the shard totals (one row a file, so no more rows than write partitions) are summed in order and
    broadcast; documents are not moved.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def id_checksums(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``ids_crc32``: CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    rows = rows.select(*keep, "ids")
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids_crc32", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            crc = tokens.checksums(ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc)], schema.names)

    return rows.mapInArrow(digest, schema)
