from __future__ import annotations

import math

import numpy as np
import pytest
from support import plan_of, rows
from pyspark.sql import functions as F

from paperloom.functions.encoders import hash_encoder
from paperloom.functions.vectors import l2_normalize
from paperloom.operators.embed import embed_abstracts, embed_column, mean_pool
from paperloom.operators import nearest as nearest_module
from paperloom.operators.nearest import nearest
from paperloom.operators.topk import top_k


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_mean_pool(spark):
    data = [(1, [1.0, 2.0], True), (1, [3.0, 6.0], True), (1, [9.0, 9.0], False), (2, [1.0, 1.0], False)]
    df = spark.createDataFrame(data, "k int, v array<float>, used boolean")
    assert rows(mean_pool(df, "k", "v", F.col("used"), 2)) == [(1, [2.0, 4.0]), (2, None)]


def test_encoder_reads_all_windows():
    texts = ["x y z", "x y z more words behind the first window", "", "long " * 2000 + "end"]
    windows, whole = (hash_encoder(width=16, max_tokens=n)()(texts) for n in (3, 10**6))
    assert np.allclose(windows, whole, atol=1e-6) and not windows[2].any()
    assert math.isclose(np.linalg.norm(windows[1]), 1, rel_tol=1e-6)
    assert not np.allclose(windows[0], windows[1])
    assert windows[3][windows[3] > 0].size == 2


def test_batches_and_worker_loading(spark, tmp_path):
    """The encoder sees the asked batch size, whatever the Arrow batches are."""

    def factory():
        def encode(texts):
            return np.full((len(texts), 1), len(texts), dtype=np.float32)

        return encode

    df = spark.range(10).select("id", F.lit("t").alias("text")).coalesce(1)
    sizes = embed_column(df, "text", factory, batch_size=4)
    assert sorted(r.embedding[0] for r in sizes.collect()) == [2.0, 2.0] + [4.0] * 8


def test_embedding_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(3).select(
        F.col("id").cast("string").alias("id"), F.lit("x").alias("abstract"), F.lit("y").alias("title")
    ).write.parquet(path)
    embedded = embed_abstracts(spark.read.parquet(path), hash_encoder())
    assert "ReadSchema: struct<id:string,abstract:string>" in plan_of(embedded)
    assert embedded.count() == 3 and len(embedded.first().embedding) == 384


def brute_force(stored, asked, k):
    found = []
    for q, b in asked:
        scored = []
        for i, a in stored:
            if a is None:
                continue
            length = max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12)
            scored.append((round(float(np.dot(a, b) / length), 6), i))
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:k]
        found += [(q, i, s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(found)


@pytest.fixture(scope="module")
def vector_tables(spark):
    """Random vectors; a third are copies of one, one is missing, one is zero."""
    random = np.random.default_rng(7)
    stored = [(f"v{i:04d}", random.normal(size=8).astype("float32").tolist()) for i in range(400)]
    stored += [(f"c{i:04d}", stored[0][1]) for i in range(200)]
    stored += [("zero", [0.0] * 8), ("none", None)]
    asked = [(i, random.normal(size=8).astype("float32").tolist()) for i in range(20)]
    asked.append((20, stored[0][1]))
    return (
        stored,
        asked,
        spark.createDataFrame(stored, "id string, embedding array<float>").repartition(5),
        spark.createDataFrame(asked, "query_id long, embedding array<float>"),
    )


@pytest.mark.parametrize("k", [1, 7, 150, 1000])
@pytest.mark.parametrize("max_queries", [1000, 6])
def test_nearest_is_exact(spark, vector_tables, k, max_queries):
    """In place, and block by block when there are more queries than are sent to every task."""
    stored, asked, vectors, queries = vector_tables
    found = nearest(vectors, queries, k, max_queries=max_queries, block_rows=100)
    mine = sorted((r.query_id, r.id, round(r.cosine, 6), r.near_rank) for r in found.collect())
    theirs = brute_force(stored, asked, k)
    assert [m[:2] + m[3:] for m in mine] == [t[:2] + t[3:] for t in theirs]
    assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=2e-6)


def test_nearest_in_small_arrow_batches(spark, vector_tables):
    stored, asked, vectors, queries = vector_tables
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = nearest(vectors.coalesce(1), queries, 5)
        mine = sorted((r.query_id, r.id, r.near_rank) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert mine == [(q, i, n) for q, i, _, n in brute_force(stored, asked, 5)]


@pytest.mark.parametrize("max_queries", [1000, 2])
def test_a_sample_first_bounds_what_tasks_emit(spark, vector_tables, monkeypatch, max_queries):
    """With many tasks, nearly nothing but what can be among the best is emitted."""
    stored, asked, vectors, queries = vector_tables
    emitted, top = [], nearest_module.top_k

    def counting(pairs, k, **names):
        emitted.append(pairs.count())
        return top(pairs, k, **names)

    monkeypatch.setattr(nearest_module, "top_k", counting)
    found = {}
    for sampled in (False, True):
        rows_of = nearest(vectors.repartition(40), queries, 5, max_queries, block_rows=20, sampled=sampled).collect()
        found[sampled] = sorted((r.query_id, r.id, r.near_rank) for r in rows_of)
    assert found[False] == found[True] == [(q, i, n) for q, i, _, n in brute_force(stored, asked, 5)]
    plain, _, after = emitted
    assert after <= len(asked) * 5 * 8 and after < plain / 2


def test_nearest_without_queries(spark, vector_tables):
    _, _, vectors, queries = vector_tables
    found = nearest(vectors, queries.where("query_id < 0"), 5)
    assert found.columns == ["query_id", "id", "cosine", "near_rank"] and found.count() == 0


def test_top_k_ties_and_plan(spark):
    df = spark.range(0, 3000, 1, 6).select(
        (F.col("id") % 2).alias("query_id"),
        F.format_string("d%05d", "id").alias("id"),
        F.when(F.col("id") < 1000, 0.5).otherwise(0.1).alias("relevance"),
    )
    best = top_k(df, 3)
    assert rows(best.select("query_id", "rank", "id")) == [
        (q, n + 1, f"d{q + 2 * n:05d}") for q in (0, 1) for n in range(3)
    ]
    plan = plan_of(top_k(df, 1000))
    assert plan.count("WindowGroupLimit") == 4  # before and after each of two shuffles
