"""Best rows per request."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import HITS, SCORE_DIGITS, TARGET_HITS


def top_k(
    scored: DataFrame,
    k: int,
    score: str = "relevance",
    rank: str = "rank",
    per: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """The ``k`` best rows per request: highest score first, then lowest id.

    Each task keeps its own ``k`` best rows per request before anything is shuffled, so a
    request receives at most ``tasks × k`` rows. As that still grows with the input, the
    tasks are bundled into groups that are reduced side by side, and only the
    ``groups × k`` rows that remain meet in one task. There are about as many groups as
    tasks in a group, by the session's number of shuffle partitions. How rows fall into
    groups has no influence on the result.
    """
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(8, math.isqrt(tasks))
    ordering = [F.col(score).desc(), F.col("id").asc()]

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*ordering)
        return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)

    rounded = scored.withColumn(score, F.round(score, SCORE_DIGITS))
    grouped = rounded.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    return best(best(grouped, *per, "_group").drop("_group", rank), *per)


def topk_hits(scored: DataFrame, hits: int = HITS, score: str = "relevance") -> DataFrame:
    return top_k(scored, hits, score)


def topk_candidates(
    scored: DataFrame, target_hits: int = TARGET_HITS, score: str = "relevance"
) -> DataFrame:
    return top_k(scored, target_hits, score)
