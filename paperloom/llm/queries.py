"""The operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.alignment import align_tokens
from paperloom.llm.decontam import leaks
from paperloom.llm.hidden_markov import score_texts
from paperloom.llm.html_text import extract_pages
from paperloom.llm.jaccard import jaccard_components
from paperloom.llm.lengths import context_totals, length_histogram
from paperloom.llm.mixing import mix_sources
from paperloom.llm.multi_index import nearest_by_index
from paperloom.llm.pii import scan_pii
from paperloom.llm.secret_scan import scan_secrets
from paperloom.llm.tokens import token_digest, write_tokens
from paperloom.llm.toxicity import toxicity
from paperloom.llm.turns import repair_conversations
from paperloom.session import scratch_path, stored_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_index(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(table(spark, sf_dir, "documents"))
    return context_totals(stored_once(histogram, "lengths"))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_token_output": op4_token_output,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_multi_index": op8_multi_index,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_turn_repair": op12_turn_repair,
    "op13_token_alignment": op13_token_alignment,
}
