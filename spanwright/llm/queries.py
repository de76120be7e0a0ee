"""One query for each corpus operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import (
    compression_quality,
    graph_dedup,
    packing,
    preference_pairs,
    secret_linking,
    set_relation_join,
    soft_mixing,
    toxicity_chain,
    warc_index,
    weak_supervision,
)
from spanwright.llm.common import scratch_path, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc_index.write_archives(table(spark, sf_dir, "pages"), path)
    index = warc_index.merge_index(spark, path)
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index.select(*first, "url_key", "captured", "capture_rank")


#: The chain over the labelled table: junk first, as toxic documents are seldom junk.
CHAIN = ["low_quality", "toxic"]
#: The language mix that is asked for.
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    links = toxicity_chain.fit(documents, labels, CHAIN)
    return toxicity_chain.flag(toxicity_chain.score(documents, links), "toxic")


def op3_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_linking.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_supervision.judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "posterior")


def op5_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("audited_recall", F.lit(recall))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return preference_pairs.format_sides(preference_pairs.all_sides(conversations))


def labelled_languages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as the domain."""
    return documents.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = labelled_languages(documents, table(spark, sf_dir, "labels"))
    mixed, _ = soft_mixing.mix(documents, soft_mixing.fit_domains(documents, labelled), LANGUAGE_WEIGHTS)
    return mixed


def op8_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relation_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = compression_quality.fit(documents, table(spark, sf_dir, "labels"))
    return compression_quality.classify(documents, model)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_secret_linking": op3_secret_linking,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_graph_dedup": op5_graph_dedup,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_set_relation_join": op8_set_relation_join,
    "op9_compression_quality": op9_compression_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": warc_index.ORACLE_SQL,
    "op3_secret_linking": secret_linking.ORACLE_SQL,
    "op6_preference_pairs": preference_pairs.ORACLE_SQL,
}
