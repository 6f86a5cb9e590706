"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import stored_once


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of a link ``a, b``; the label is the smallest node reached.

    Links may repeat and go either way; a null end links nothing. Each round takes the smallest
    label among the neighbours, then the label of that label, and is written to the shared
    folder. A node with very many links is counted down in every task before it is shuffled.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    swapped = known.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = stored_once(known.select("a", "b").unionByName(swapped).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = stored_once(labels.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        met = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(met, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("beyond"))
        step = lower.join(jump, "low").select(
            "node", F.least("low", "beyond").alias("label"), F.col("label").alias("old")
        )
        step = stored_once(step, "labels")
        labels = step.select("node", "label")
        if not step.where(F.col("label") != F.col("old")).limit(1).count():
            return labels
