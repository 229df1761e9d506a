"""Corpus pipeline: from raw ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and rereads it as the next stage's docs. All but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rule or are robust outliers go;
2. MinHash near-duplicates (five-word shingles, similarity 0.8 or more): the least doc_id of each group stays;
3. repeated substrings: bytes covered by a 50-byte string of an earlier document go, and documents of which
   nothing but white space is left;
4. benchmark decontamination: documents in which a benchmark item is found go;
5. best-fit packing into sequences of 4096 tokens: one row per piece.

The rows depend on iterative estimates and on token ids, which SQL cannot express: ORACLE_SQL is None. The stages
as run here are only tested for falling row counts, columns, sequence lengths and the share of good documents that
pass the first; the operators have tests of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontamination, near_duplicates, packing, quality_rules, shared, substring_dedup, tokens


_scratch: list[tuple[int, int]] = []


def stage(f: Callable) -> Callable:
    """A stage that first deletes the scratch tables of the one before, whose result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            shared.drop(spark, *_scratch.pop())
        began = shared.mark()
        out = f(spark, docs, sf_dir)
        _scratch.append((began, shared.mark()))
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs, words_a_shingle=5, percent=80)


@stage
def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs, 50).where(F.col("text").rlike(r"\S"))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokens.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_removal),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = shared.stored(step(spark, docs, sf_dir), f"stage-{name}", free=True)
    return docs
