"""Row positions in file order, without a single-task window over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.joins import lookup_join
from paperloom.session import stored_once

_FILE, _BLOCK, _SEQ = "_src_file", "_src_block", "_src_seq"


def stage_in_file_order(scan: DataFrame) -> DataFrame:
    """Remember where each row of a file scan came from and write the result once.

    Text formats have no row index and Spark packs file blocks into tasks in any order, so
    the place is (file, block, running number inside the task). How a scan is cut into
    blocks may change from one run to the next with the number of executors; the places
    are therefore written to the shared folder and read back, never worked out twice.
    """
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_SEQ),
    )
    return stored_once(placed, "positions")


def row_positions(staged: DataFrame, name: str = "pos") -> DataFrame:
    """Number staged rows from 0 in file order: path, then block, then line.

    A block is a contiguous run of the running number, so the position is an offset per
    block plus a difference. Only the block table (one row per input split) is sorted; the
    rows themselves are not.
    """
    blocks = staged.groupBy(_FILE, _BLOCK).agg(
        F.min(_SEQ).alias("_first"), F.count("*").alias("_rows")
    )
    return _offset_join(staged, blocks, [_FILE, _BLOCK], F.col(_SEQ) - F.col("_first"), name)


def parquet_positions(scan: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a Parquet scan from 0 in file order: path, then row.

    Parquet knows each row's index in its file, so nothing needs to be staged. Apply this
    to the scan itself, before any filter.
    """
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.row_index").alias(_SEQ),
    )
    files = (
        scan.select(F.col("_metadata.file_path").alias(_FILE))
        .groupBy(_FILE)
        .agg(F.count("*").alias("_rows"))
    )
    return _offset_join(placed, files, [_FILE], F.col(_SEQ), name)


def _offset_join(rows, sizes, keys, inner_position, name):
    position = (F.col("_offset") + inner_position).cast("long").alias(name)
    kept = [c for c in rows.columns if c not in (_FILE, _BLOCK, _SEQ)]
    # a row per file or block: broadcast if those are few, else the rows of a file are spread
    offsets = stored_once(_offsets(sizes, keys), "offsets")
    joined = lookup_join(rows, offsets, keys, [_SEQ], offsets.count())
    return joined.select(*kept, position)


def _offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_offset``: the rows of all files or blocks that come before.

    A running sum in two levels: inside each range of the sorted table, and over the few
    ranges. The ranges are written down, because a second run may cut them elsewhere.
    """
    ranged = stored_once(
        sizes.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "sizes"
    )

    def before(window):
        preceding = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(preceding), F.lit(0))

    ranges = ranged.groupBy("_range").agg(F.sum("_rows").alias("_rows"))
    starts = ranges.select("_range", before(Window.orderBy("_range")).alias("_start"))
    inside = before(Window.partitionBy("_range").orderBy(*keys))
    return (
        ranged.withColumn("_inside", inside)
        .join(starts, "_range")
        .withColumn("_offset", F.col("_start") + F.col("_inside"))
        .drop("_range", "_rows", "_start", "_inside")
    )


def batch_ranges(numbered: DataFrame, batch_size: int) -> DataFrame:
    """Fixed batches of positions and the half-open range each covers."""
    return (
        numbered.groupBy(F.expr(f"pos div {int(batch_size)}").alias("batch_id"))
        .agg(
            F.min("pos").alias("range_start"),
            (F.max("pos") + 1).alias("range_end"),
            F.count("*").alias("n_rows"),
        )
    )
