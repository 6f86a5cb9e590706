"""Token ids as Parquet: sorted list columns that are read back selectively.

Documents are ranged by id and sorted within their range, so files follow each other. A file
holds, per document, its id, the ids before it in the file, their number and the ids as a list.
Ids and counts are delta encoded, token ids by dictionary; row groups and pages are small, so
that the page index finds a document's ids without reading the rest, and metadata is read
without any token. Positions among all documents come from the files' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.encoding import END, default_vocabulary, encode_runs

SCHEMA = "part int, doc_id bigint, before bigint, n_tokens bigint, tokens array<int>"
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(documents: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode every whole text, append the end id, and write the files to ``path``.

    Null texts count as empty and have the end id only. A null id comes first; rows with the
    same id follow a hash of their text, and equal rows are all written. Other columns are
    ignored.
    """
    source = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for ids, upto in encode_runs(batch.column("text"), source):
                rows = len(upto) - 1
                with_end = np.insert(ids, upto[1:], END)
                starts = upto + np.arange(rows + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, part, dtype=np.int32)),
                        batch.column("doc_id")[at : at + rows],
                        pa.array(before + starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(with_end, pa.int32())),
                    ],
                    ["part", "doc_id", "before", "n_tokens", "tokens"],
                )
                at += rows
                before += int(starts[-1])

    order = ["doc_id", "tie"]
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` of written files; only the columns used are read."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    # one row per written file
    return stored.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "tokens"
    )


def ids_crc32(tokens: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def checksum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = np.asarray(lists.flatten()).astype("<u4")
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    return checksum(tokens)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from written files."""
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", ids_crc32(F.col("tokens")).alias("ids_crc32")
    )
