"""The keyed article collection: union, latest row per id, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.schemas import ARTICLE


def union_origins(bulk: DataFrame, daily: DataFrame) -> DataFrame:
    """One collection from both ingests, on the canonical columns."""
    extra = [c for c in ("load_seq",) if c in bulk.columns and c in daily.columns]
    columns = [*ARTICLE.names, *extra]
    return bulk.select(*columns).unionByName(daily.select(*columns))


def latest_by_id(loads: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One row per id: the one from the latest load.

    The filter on the first row lets every task drop all but its own best row per id
    before the shuffle, so an id with very many copies is no hot key. Rows of one load
    that share an id are ordered by update date, then by content, so a retried task
    chooses the same row again. Columns ``within`` follow from the id: rows that were brought
    together by them are not shuffled again.
    """
    columns = [c for c in loads.columns if c not in ("load_seq", *within)]
    latest = Window.partitionBy(*within, "id").orderBy(
        F.col("load_seq").desc(),
        F.col("update_date_ts").desc_nulls_last(),
        F.col("origin").asc(),
        F.xxhash64(*columns).asc(),
    )
    return loads.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"))


def feed_counters(articles: DataFrame, keep: Column) -> DataFrame:
    """Processed, ingested and skipped rows in one pass."""
    return articles.agg(
        F.count("*").alias("processed"),
        F.count_if(keep).alias("ingested"),
        F.count_if(~keep).alias("skipped"),
    )
