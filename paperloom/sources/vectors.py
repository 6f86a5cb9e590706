"""Stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import EMBEDDING


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING).parquet(path)


def scan_embeddings_range(embeddings: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (excluded); the range reaches the Parquet scan."""
    return embeddings.where((F.col("pos") >= start) & (F.col("pos") < end))
