"""Exact token totals for every context limit, from a histogram of encoded lengths.

Documents are counted by source and length; all answers come from the histogram. Suffix sums
run within blocks of lengths, and over the blocks' totals, so no task sees all lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encoding import count_tokens, default_vocabulary

#: Lengths that one block covers.
BLOCK = 4_096


def length_histogram(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``source, length, n_docs``; rows whose ``overall`` is true count all sources together.

    Null and empty texts have length 0. A null source is a source of its own. Repeated rows
    count as often as they occur; other columns are ignored.
    """
    length = count_tokens(F.col("text"), vocabulary or default_vocabulary())
    own = documents.select("source", length.alias("length")).groupBy("source", "length")
    own = own.agg(F.count("*").alias("n_docs"))
    return (
        own.rollup("length", "source")
        .agg(F.sum("n_docs").alias("n_docs"), F.grouping_id().alias("level"))
        .where(F.col("level") <= 1)
        .select((F.col("level") == 1).alias("overall"), "source", "length", "n_docs")
    )


def context_totals(histogram: DataFrame) -> DataFrame:
    """What a context limit of each occurring length keeps, by source and for all sources.

    ``n_docs`` documents have just this length, ``docs_over`` are longer and get cut;
    ``tokens_total`` is the whole source's, ``tokens_kept`` what is left when every document is
    cut to ``length``; ``quantile`` is the share of documents of at most this length. Between
    two occurring lengths ``tokens_kept`` grows by ``docs_over`` a step, so every limit is
    answered.
    """
    key = ["overall", "source"]
    block = F.floor(F.col("length") / BLOCK)
    counted = histogram.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = counted.groupBy(*key, "block").agg(F.sum("n_docs").alias("docs_in"), F.sum("tokens").alias("tokens_in"))
    later = Window.partitionBy(*key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*key)
    blocks = blocks.select(
        *key,
        "block",
        F.coalesce(F.sum("docs_in").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens_in").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs_in").over(whole).alias("docs_total"),
        F.sum("tokens_in").over(whole).alias("tokens_total"),
    )
    longer = Window.partitionBy(*key, "block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    same = F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.overall") == F.col("b.overall"))
    joined = counted.alias("c").join(blocks.alias("b"), same & (F.col("c.block") == F.col("b.block")))
    joined = joined.select("c.*", "docs_later", "tokens_later", "docs_total", "tokens_total")
    over = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_later")
    beyond = F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("tokens_later")
    return joined.withColumn("docs_over", over).withColumn("beyond", beyond).select(
        *key,
        "length",
        "n_docs",
        "docs_over",
        "tokens_total",
        (F.col("tokens_total") - F.col("beyond") + F.col("docs_over") * F.col("length")).alias("tokens_kept"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )
