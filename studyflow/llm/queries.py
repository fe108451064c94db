"""The thirteen operators and the pipeline as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyflow.llm import classifiers as C
from studyflow.llm import (
    chat,
    collocations,
    decontaminate,
    jaccard_join,
    line_dedup,
    mixture,
    outliers,
    personal_data,
    prefix_trie,
    sharding,
    token_files,
)
from studyflow.llm.common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control(table(spark, sf_dir, "conversations"))
    return chat.round_trip(chat.text_parts(turns))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return C.scored(docs, C.train_quality(docs, labels), C.QUALITY_HELD_OUT, C.QUALITY_AT)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return C.scored(docs, C.train_toxicity(docs, labels), C.TOXIC_HELD_OUT, C.TOXIC_AT)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mix(table(spark, sf_dir, "documents")).taken()


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.personal_spans(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_source_mixture": op9_source_mixture,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_personal_data": op12_personal_data,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op2_chat_formatting": chat.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op11_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
