"""The registered queries of this subpackage: thin wrappers over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontam, divergence, jaccard, pivots, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import packing

    return packing.best_fit(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_sorted_table_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import sst

    return sst.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(spark, table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.containment(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import sharding

    return sharding.placed(spark, table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import fingerprint

    return fingerprint.edited(spark, table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import toxicity

    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import quality

    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.mined(spark, table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sorted_table_shards": op2_sorted_table_shards,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_warc": op11_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": jaccard.oracle(),
    "op6_benchmark_decontamination": decontam.oracle(),
    "op8_substring_dedup": substring.oracle(),
    "op11_warc": warc.oracle(),
    "op12_hard_negatives": pivots.oracle(),
    "op13_source_divergence": divergence.oracle(),
}
