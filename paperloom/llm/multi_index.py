"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook; a pair of codewords is a cell. A query
visits cells in the order of the summed distances of their codewords, with a heap over pairs,
until they hold enough entries, and ranks the entries of those cells by their original vectors.

Nearness is the inner product. The second half gets one more coordinate, with which all entries
are equally long, so that the nearest codewords are those of the largest products. Codebooks are
trained on at most ``SAMPLE`` vectors, chosen by a hash of their id; every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import stored_once

SAMPLE, ROUNDS = 20_000, 12
#: A query visits cells until they hold this share of the entries, or what its k results need.
SHARE = 0.5
#: Codewords of a half. With fewer than the least, half of the entries hold under 0.9 of the true
#: neighbours of vectors without structure; tables of fewer entries have a codeword for each.
LEAST_WORDS, MOST_WORDS = 128, 512
#: Entries, and queries, that a task compares at a time.
CHUNK = 2_048


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray  # with the coordinate that evens out lengths
    longest: float  # largest squared length of an entry

    @property
    def half(self) -> int:
        return self.first.shape[1]


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries_of(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, one per id."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    widths = rows.groupBy(F.size("embedding").alias("width")).count()
    width = widths.orderBy(F.desc("count"), "width").first()
    rows = rows.where(F.size("embedding") == (width.width if width else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    words = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _distances(x, words).argmin(1)
        for j in range(len(words)):
            if (own == j).any():
                words[j] = x[own == j].mean(0)
    return words


def _halves(x: np.ndarray, books_half: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))
    return x[:, :books_half], np.hstack([x[:, books_half:], rest[:, None]])


def train(entries: DataFrame, words: int) -> Codebooks:
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(entries.agg(F.max(square)).first()[0])
    rows = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = np.array(rows["embedding"].tolist(), dtype=float)
    first, second = _halves(x, max(1, x.shape[1] // 2), longest)
    return Codebooks(_k_means(first, words, 1), _k_means(second, words, 2), longest)


def build_index(entries: DataFrame, books: Codebooks) -> DataFrame:
    """``first, second, vec_id, embedding``: the cell of every entry."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame["embedding"].tolist(), dtype=float)
                one, two = _halves(x, books.half, books.longest)
                cells = {
                    "first": _distances(one, books.first).argmin(1).astype(np.int32),
                    "second": _distances(two, books.second).argmin(1).astype(np.int32),
                }
                yield pd.DataFrame(cells | {"vec_id": frame["vec_id"], "embedding": frame["embedding"]})

    return entries.mapInPandas(assign, "first int, second int, vec_id bigint, embedding array<double>")


def cells_in_order(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of codewords by summed distance: a pair follows both pairs just before it."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap = [(one[a[0]] + two[b[0]], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[j]], i + 1, j))
        if i == 0 and j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))


def visits_of(queries: DataFrame, books: Codebooks, counts: np.ndarray, enough: int) -> DataFrame:
    """``first, query_id, vector, seconds``: the cells a query visits, by first codeword."""

    def traverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query_id, vector in zip(frame["vec_id"], frame["embedding"], strict=True):
                x = np.asarray(vector, dtype=float)[None, :]
                one = _distances(x[:, : books.half], books.first)[0]
                two = _distances(np.hstack([x[:, books.half :], [[0.0]]]), books.second)[0]
                held, seen = 0, {}
                for i, j in cells_in_order(one, two):
                    if counts[i, j]:
                        seen.setdefault(i, []).append(j)
                        held += counts[i, j]
                        if held >= enough:
                            break
                out.extend((i, query_id, vector, js) for i, js in seen.items())
            yield pd.DataFrame(out, columns=["first", "query_id", "vector", "seconds"])

    return queries.mapInPandas(traverse, "first int, query_id bigint, vector array<double>, seconds array<int>")


def _rank(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; the ids are ascending and ties go to smaller ones."""
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        over = np.flatnonzero(scores > least)
        place = np.concatenate([over, np.flatnonzero(scores == least)[: k - len(over)]])
    else:
        place = np.arange(len(ids))
    return place[np.lexsort((ids[place], -scores[place]))]


def _compare(k: int):
    def compare(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        entries = entries.sort_values("vec_id")
        ids, cells = entries["vec_id"].to_numpy(), entries["second"].to_numpy()
        x = np.array(entries["embedding"].tolist(), dtype=float)
        y = np.array(queries["vector"].tolist(), dtype=float)
        products = np.round(y @ x.T, 12)  # equal vectors get equal products wherever they stand
        out = []
        visited = np.zeros(int(cells.max()) + 1, dtype=bool)
        for r, (query_id, seconds) in enumerate(zip(queries["query_id"], queries["seconds"], strict=True)):
            visited[:] = False
            js = np.asarray(seconds)
            visited[js[js < len(visited)]] = True
            here = np.flatnonzero(visited[cells] & (ids != query_id))
            best = here[_rank(ids[here], products[r, here], k)]
            exact = np.einsum("ed,d->e", x[best], y[r])
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": exact}))
        return pd.concat(out)[columns]

    return compare


def nearest_by_index(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query.

    Queries are the ids divisible by ``every``, candidates all others. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows without an id or of
    another width than most; rows with the same id count once. Ties go to the smaller id. With
    fewer than k candidates a query has them all; without any it has no row. Other columns are
    ignored.
    """
    entries = stored_once(entries_of(vectors), "entries")
    total = entries.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    words = int(np.clip(2 ** np.round(np.log2(np.sqrt(total) / 3.5)), LEAST_WORDS, MOST_WORDS))
    books = train(entries, words)
    index = stored_once(build_index(entries, books), "index")
    cells = index.groupBy("first", "second").count().toPandas()  # at most 512 x 512 rows
    counts = np.zeros((len(books.first), len(books.second)), dtype=np.int64)
    counts[cells["first"], cells["second"]] = cells["count"]
    queries = entries.where(F.col("vec_id") % every == 0)
    enough = max(int(np.ceil(SHARE * total)), k + 1)  # a query's own entry is no result
    visits = stored_once(visits_of(queries, books, counts, enough), "visits")
    # a codeword may hold a third of all entries, and all queries may visit it: blocks of both
    parts = lambda df, name: df.groupBy("first").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    split = parts(index, "entry_parts").join(parts(visits, "query_parts"), "first")
    split = F.broadcast(split)  # one row per codeword
    number = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    left = (
        index.join(split, "first")
        .withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("entry_parts")))
        .withColumn("j", F.explode(number("query_parts")))
        .select("first", "i", F.col("j").cast("bigint").alias("j"), "second", "vec_id", "embedding")
    )
    right = (
        visits.join(split, "first")
        .withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("query_parts")))
        .withColumn("i", F.explode(number("entry_parts")))
        .select("first", F.col("i").cast("bigint").alias("i"), "j", "query_id", "vector", "seconds")
    )
    keys = ["first", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _compare(k), "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
