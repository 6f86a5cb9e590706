"""The cursor of the daily run: up to when articles have been ingested."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import SEED_MARGIN
from paperloom.functions.articles import update_epoch
from paperloom.schemas import CURSOR

NAME = "articles"


def cursor_history(spark: SparkSession, path: str, name: str = NAME) -> DataFrame:
    return spark.read.schema(CURSOR).parquet(path).where(F.col("name") == name)


def read_cursor(spark: SparkSession, path: str, name: str = NAME) -> Column:
    """The latest cursor, as a literal: it stays the same for the whole run."""
    latest = cursor_history(spark, path, name).agg(
        F.max_by(F.unix_seconds("last_updated"), "seq").alias("seconds")
    )
    return F.timestamp_seconds(F.lit(latest.first()["seconds"]))


def write_cursor(spark: SparkSession, path: str, last_updated: str | Column, name: str = NAME) -> None:
    """Append a cursor. Earlier ones stay, so a failed write loses nothing.

    Call this after the data of the run has been committed.
    """
    value = _instant(last_updated) if isinstance(last_updated, str) else last_updated
    row = spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit(_next_seq(spark, path, name)).cast("long").alias("seq"),
        value.cast("timestamp").alias("last_updated"),
    )
    row.write.mode("append").parquet(path)


def seed_cursor(spark: SparkSession, path: str, dataset_updated: str, name: str = NAME) -> None:
    """Start from the bulk snapshot's own date, less three days for its delay."""
    start = _instant(dataset_updated) - F.expr(f"interval {SEED_MARGIN}")
    write_cursor(spark, path, start, name)


def advance_cursor(spark: SparkSession, path: str, stored: DataFrame, name: str = NAME) -> None:
    """Move to the newest stored article; a run that stored none leaves the cursor alone."""
    newest = stored.agg(F.max("update_date_ts").alias("newest")).first()["newest"]
    if newest is not None:
        write_cursor(spark, path, F.timestamp_seconds(F.lit(newest)), name)


def _instant(date: str) -> Column:
    """A date without a zone is UTC, as everywhere."""
    return F.timestamp_seconds(update_epoch(F.lit(date)))


def _next_seq(spark: SparkSession, path: str, name: str) -> int:
    try:
        last = cursor_history(spark, path, name).agg(F.max("seq").alias("last")).first()["last"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return 0 if last is None else last + 1
