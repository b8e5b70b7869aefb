"""The training-data operators bound to the given tables, always over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempolog.llm import (
    decontaminate, html_extract, language, license_scan, merkle, packing, quality_classifier, simhash, spelling, substring, token_count, topk, warc,
)

TOKEN_LIMIT = 2048


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark, folder):
    return license_scan.scan(read_table(spark, folder, "documents"))


def op2_token_counts(spark, folder):
    return token_count.token_counts(read_table(spark, folder, "documents"), tokenizer_path(), TOKEN_LIMIT)


def op3_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op4_exact_top_k(spark, folder):
    return topk.top_k(read_table(spark, folder, "embeddings"))


def op5_substring_dedup(spark, folder):
    return substring.removal_report(read_table(spark, folder, "documents"))


def op6_quality_classifier(spark, folder):
    return quality_classifier.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op7_warc(spark, folder):
    return warc.archive_report(read_table(spark, folder, "pages"))


def op8_html_extraction(spark, folder):
    return html_extract.extract(read_table(spark, folder, "pages"))


def op9_packing(spark, folder):
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_path())


def op10_benchmark_decontamination(spark, folder):
    found = decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.drop("text_key")


def op11_merkle_manifest(spark, folder):
    return merkle.manifest(read_table(spark, folder, "documents"))


def op12_spelling_variants(spark, folder):
    return spelling.variants(read_table(spark, folder, "documents"))


def op13_language_id(spark, folder):
    return language.predict(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_token_counts, op3_simhash_near_dedup, op4_exact_top_k, op5_substring_dedup, op6_quality_classifier, op7_warc, op8_html_extraction, op9_packing,
    op10_benchmark_decontamination, op11_merkle_manifest, op12_spelling_variants, op13_language_id)}
