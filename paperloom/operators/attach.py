"""Give every kept article its embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_embeddings(kept: DataFrame, embeddings: DataFrame, check: bool = True) -> DataFrame:
    """Join by id. Ids are unique on both sides, so no key is hot.

    Both tables shuffle once unless they are stored in the same buckets or one is small,
    which the planner and adaptive execution find out from the data. ``check`` raises, while
    the result is computed, on the first article without a vector. Without it such articles are
    left out, and ``articles_without_vector`` says which they are.
    """
    vectors = embeddings.select("id", "embedding")
    if not check:
        return kept.join(vectors, "id")
    found = kept.join(vectors.withColumn("_found", F.lit(True)), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for article "), F.col("id")))
    return found.withColumn(
        "embedding", F.when(F.col("_found"), F.col("embedding")).otherwise(missing)
    ).drop("_found")


def articles_without_vector(kept: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The articles that no vector can be attached to."""
    return kept.join(embeddings.select("id"), "id", "left_anti")


def attach_embeddings_positional(
    numbered: DataFrame, vectors: DataFrame, check: bool = True
) -> DataFrame:
    """Join the k-th kept article with the k-th vector, for vectors that have no key.

    Too few vectors is an error; extra vectors are ignored. ``check`` raises while the
    result is computed, on the first article that has no vector.
    """
    found = vectors.select("pos", "embedding", F.lit(True).alias("_found"))
    joined = numbered.join(found, "pos", "left")
    if check:
        missing = F.raise_error(F.concat(F.lit("no vector at position "), F.col("pos")))
        vector = F.when(F.col("_found"), F.col("embedding")).otherwise(missing)
    else:
        joined = joined.where(F.col("_found"))
        vector = F.col("embedding")
    return joined.withColumn("embedding", vector).drop("_found")
