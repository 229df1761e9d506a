"""The corpus operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontamination, mixing, near_duplicates, packing, periodic_runs, quality_classifier, quality_rules, quotations, shared, substring_dedup, token_store, tokens, url_filter, vector_codes, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_classifier.train(docs, table(spark, sf_dir, "labels"), max_train_rows=6000)
    return quality_classifier.score(docs, machine)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))
    return packing.pack(cut)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, path).withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return token_store.id_checksums(rows, "doc_id", "start", "n_tokens")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words_a_shingle=2, percent=80)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeated_tails(table(spark, sf_dir, "documents"))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents")).taken()
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_factorisation_machine": op1_factorisation_machine,
        "op2_url_filter": op2_url_filter,
        "op3_decontamination": op3_decontamination,
        "op4_wrapper_induction": op4_wrapper_induction,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_token_store": op7_token_store,
        "op8_quality_rules": op8_quality_rules,
        "op9_quotation_linking": op9_quotation_linking,
        "op10_hyperminhash": op10_hyperminhash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_vector_codes": op12_vector_codes,
        "op13_source_mix": op13_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {}
