"""A corpus pipeline: every stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.decontam import without_leaks
from paperloom.llm.jaccard import without_copies
from paperloom.llm.mixing import mixed_documents
from paperloom.llm.queries import table
from paperloom.llm.tokens import token_digest, write_tokens
from paperloom.llm.toxicity import score_text, train_toxicity
from paperloom.session import scratch_path, stored_once


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_text(model, F.col("text")) < 0.5)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words and a similarity of 0.8."""
    return without_copies(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as Parquet files, and the digest that is read back from them."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return token_digest(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("token ids", write_ids),
]

#: The classifier and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_once(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
