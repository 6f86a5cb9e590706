"""Structured Streaming over landed article files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.constants import CURSOR_MARGIN, DEFAULT_CATEGORIES
from paperloom.operators.filters import filter_categories_ci
from paperloom.schemas import ARTICLE
from paperloom.sinks.articles import next_load, stored_collection, upsert_articles
from paperloom.sources.jsonl import with_defaults


#: When the file of a landed row arrived.
ARRIVED = "_arrived"


def landed(
    spark: SparkSession, landing: str, max_files: int | None = None, arrival: bool = False
) -> DataFrame:
    reader = spark.readStream.schema(ARTICLE).option("mode", "FAILFAST")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(landing)
    if arrival:
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))
    return with_defaults(rows)


def stream_ingest(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    max_files: int | None = None,
) -> StreamingQuery:
    """Merge every landed file into the collection once, then stop.

    The checkpoint remembers the files, so it is the cursor of this job. A batch that is
    run again after a failure merges to the same collection. Loads are numbered on from those
    that the collection holds, so a stream after a bulk load is the later one.
    """
    first = next_load(spark, table)
    kept = filter_categories_ci(landed(spark, landing, max_files), subset)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if stored_collection(spark, table) is None:
            upsert_articles(spark, table, batch, first + batch_id)
            return
        # A later merge looks at the ids first and at the rows then; parse the files once.
        batch.persist()
        try:
            upsert_articles(spark, table, batch, first + batch_id)
        finally:
            batch.unpersist()

    return (
        kept.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_overlap(articles: DataFrame, margin: str = CURSOR_MARGIN) -> DataFrame:
    """Drop repeats of an article that arrive within ``margin`` of each other.

    Time is when a row's file arrived (``ARRIVED``), so state is bounded and no row is late:
    files are read in the order of their arrival. A repeat has the same id and update date; a
    changed article passes, and the latest of an id is the one that counts.
    """
    return (
        articles.withWatermark(ARRIVED, margin)
        .dropDuplicatesWithinWatermark(["id", "update_date_ts"])
        .drop(ARRIVED)
    )


def stream_dedup_overlap(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    margin: str = CURSOR_MARGIN,
    max_files: int | None = None,
) -> StreamingQuery:
    """Append landed articles to ``out``, without the repeats of the overlap."""
    return (
        dedup_overlap(landed(spark, landing, max_files, arrival=True), margin)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
