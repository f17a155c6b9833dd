"""Registered queries: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.ann import nearest_by_product
from tallyspark.llm.bpe import encode_documents
from tallyspark.llm.common import documents
from tallyspark.llm.exact_dedup import exact_duplicates
from tallyspark.llm.langid import identify
from tallyspark.llm.line_dedup import drop_common_lines, file_batches
from tallyspark.llm.merkle import fold, leaf_of, manifest, proof_digest
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.periodic import find_runs
from tallyspark.llm.quality import quality
from tallyspark.llm.suffix_dedup import remove_repeats
from tallyspark.llm.token_count import count_tokens
from tallyspark.llm.warc import archive_and_index


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_index(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = drop_common_lines(docs, min_docs=10, min_chars=1, batches=file_batches(docs.select("text"), 4))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_product(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_suffix_dedup, op3_bpe_prefix_dp, op4_warc, op5_token_count, op6_minhash, op7_language_id, op8_line_dedup, op9_ann, op10_exact_dedup)
}


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_lines", "removed_chars")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # Rows whose unsigned crc32 of the decimal identifier 7 divides have n_chars one higher; nulls stay.
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    fields[3] = F.col("n_chars") + 1
    docs = docs.withColumn("_tampered", F.when(tampered, leaf_of(*fields)))
    out = manifest(docs, keep=("doc_id", "_tampered")).withColumn("folded_root", fold(F.coalesce("_tampered", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(documents(spark, sf_dir).select("doc_id", "text"), plant=True)
    runs = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.concat(F.array_join(runs, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES.update({f.__name__: f for f in (op11_quality_rules, op12_merkle_manifest, op13_periodic_runs)})
