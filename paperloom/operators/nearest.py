"""Exact nearest neighbours of a table of query vectors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.constants import SCORE_DIGITS, TARGET_HITS
from paperloom.operators.topk import top_k
from paperloom.session import stored_once

#: Query vectors that are sent to every task. More are compared block by block.
MAX_QUERIES = 1_000

#: Vectors per block of the block-by-block comparison.
BLOCK_ROWS = 20_000

#: One vector in so many is compared first, where that many cores share the work.
SAMPLE, SAMPLED_FROM = 4, 64

_PAIR = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("cosine", pa.float64())])
_PAIR_DDL = "query_id bigint, id string, cosine double"


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TARGET_HITS,
    max_queries: int = MAX_QUERIES,
    block_rows: int = BLOCK_ROWS,
    sampled: bool | None = None,
) -> DataFrame:
    """``query_id, id, cosine, near_rank`` of the ``k`` nearest vectors per query.

    Every vector is compared, as a matrix product per Arrow batch; a task emits only its
    ``k`` best per query, so pairs are never materialised. The query side is fetched once,
    up to ``max_queries`` rows. A larger query table is not: both sides are then cut into
    blocks and each pair of blocks meets in one task.

    On a large cluster the tasks' best ``k`` are many more than ``k``. So a sample of the
    vectors is compared first (``sampled``; by default where ``SAMPLED_FROM`` cores work):
    the ``k``-th best score in it is one that the ``k``-th best of all reaches, and tasks emit
    nothing below it, about ``SAMPLE * k`` rows a query in all. The result is the same.
    """
    usable = vectors.where("embedding is not null").select("id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    block = asked.limit(max_queries + 1).toArrow()
    if block.num_rows == 0:
        spark = vectors.sparkSession
        return spark.createDataFrame([], _PAIR_DDL + ", near_rank int")
    if sampled is None:
        sampled = vectors.sparkSession.sparkContext.defaultParallelism >= SAMPLED_FROM
    floors = None
    if sampled:
        some = usable.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
        first = top_k(
            _partial(some, asked, block, k, max_queries, block_rows, None),
            k, score="cosine", rank="near_rank",
        )
        # at most one row per query; stored, as the second pass uses it as often as it has blocks
        floors = stored_once(
            first.where(F.col("near_rank") == k).select("query_id", F.col("cosine").alias("floor")),
            "floors",
        )
    partial = _partial(usable, asked, block, k, max_queries, block_rows, floors)
    return top_k(partial, k, score="cosine", rank="near_rank")


def _partial(usable, asked, block, k, max_queries, block_rows, floors):
    """Pairs among which are the best ``k`` of every query."""
    if block.num_rows > max_queries:
        asked = asked.withColumn("floor", F.lit(None).cast("double")) if floors is None else asked.join(floors, "query_id", "left")
        return _by_blocks(usable, asked, k, max_queries, block_rows)
    query_ids, matrix = block.column("query_id").to_numpy(), _unit_rows(block)
    known = {} if floors is None else {row.query_id: row.floor for row in floors.collect()}
    floor = np.array([known.get(q, -np.inf) for q in query_ids.tolist()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_pairs(batches, query_ids, matrix, k, floor).to_batches()

    return usable.mapInArrow(scan, _PAIR_DDL)


def _by_blocks(usable, asked, k, max_queries, block_rows):
    n_query_blocks = math.ceil(asked.count() / max_queries)
    n_vector_blocks = math.ceil(max(usable.count(), 1) / block_rows)

    def own(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = usable.withColumn("vb", own("id", n_vector_blocks)).withColumn(
        "qb", every(n_query_blocks)
    )
    right = asked.withColumn("qb", own("query_id", n_query_blocks)).withColumn(
        "vb", every(n_vector_blocks)
    )

    def compare(vector_block: pa.Table, query_block: pa.Table) -> pa.Table:
        if not vector_block.num_rows or not query_block.num_rows:
            return _PAIR.empty_table()
        query_ids = query_block.column("query_id").to_numpy()
        matrix = _unit_rows(query_block)
        floor = pc.fill_null(query_block.column("floor"), -np.inf).to_numpy()
        return _best_pairs(vector_block.to_batches(), query_ids, matrix, k, floor)

    return (
        left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(compare, _PAIR_DDL)
    )


def _best_pairs(
    batches: Iterable[pa.RecordBatch],
    query_ids: np.ndarray,
    matrix: np.ndarray,
    k: int,
    least: np.ndarray,
) -> pa.Table:
    """The ``k`` best (query, vector) pairs per query over all batches, none below ``least``.

    At most about twice ``k`` pairs per query are held between batches, and a query that
    already has ``k`` takes only what reaches its lowest score. Ties go to the lowest id.
    """
    best = _PAIR.empty_table()
    waiting: list[pa.Table] = []
    n_waiting = 0
    floor = least
    for batch in _slices(batches, len(query_ids)):
        scores = np.round(_unit_rows(batch) @ matrix.T, SCORE_DIGITS)
        needed = floor
        if batch.num_rows > k:
            kth = batch.num_rows - k
            needed = np.maximum(floor, np.partition(scores, kth, axis=0)[kth])
        rows, columns = np.nonzero(scores >= needed)
        ids = pc.take(batch.column("id"), pa.array(rows)).cast(pa.string())
        waiting.append(
            pa.table(
                [pa.array(query_ids[columns]), ids, pa.array(scores[rows, columns])],
                schema=_PAIR,
            )
        )
        n_waiting += len(rows)
        if n_waiting >= k * len(query_ids):
            best, floor = _reduce([best, *waiting], query_ids, k)
            floor = np.maximum(floor, least)
            waiting, n_waiting = [], 0
    return _reduce([best, *waiting], query_ids, k)[0]


def _slices(batches, n_queries):
    """Batches cut so that a slice has at most four million scores (32 MB)."""
    size = max(1, 4_000_000 // n_queries)
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _reduce(tables, query_ids, k):
    pairs = pa.concat_tables(tables)
    order = [("query_id", "ascending"), ("cosine", "descending"), ("id", "ascending")]
    pairs = pairs.take(pc.sort_indices(pairs, order))
    query = pairs.column("query_id").to_numpy()
    first = np.searchsorted(query, query_ids, side="left")
    nth = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    floor = np.full(len(query_ids), -np.inf)
    full = np.searchsorted(query, query_ids, side="right") - first >= k
    floor[full] = pairs.column("cosine").to_numpy()[first[full] + k - 1]
    return pairs.filter(pa.array(nth < k)), floor


def _unit_rows(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    vectors = rows.column("embedding")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(vectors), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.maximum(length, 1e-12)
