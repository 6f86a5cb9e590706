"""Batch inference and pooling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.constants import DAILY_BATCH, DEFAULT_MODEL, QUERY_INSTRUCTION
from paperloom.functions.encoders import EncoderFactory
from paperloom.functions.text import passage_prefix, query_prefix


def embed_column(
    rows: DataFrame, text: str, encoder: EncoderFactory, batch_size: int = DAILY_BATCH
) -> DataFrame:
    """Replace the ``text`` column by ``embedding array<float>``.

    The encoder is loaded once per Python worker and sees ``batch_size`` texts at a time
    whatever the Arrow batch size is. All other columns of ``rows`` go through Python too,
    so select the few that are needed, and filter, before calling this.
    """
    carried = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*carried, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in batches:
            texts = frame.pop(text)
            vectors = []
            for start in range(0, len(texts), batch_size):
                vectors.extend(encode(texts.iloc[start : start + batch_size].tolist()))
            frame["embedding"] = vectors
            yield frame

    return rows.mapInPandas(infer, schema)


def embed_abstracts(
    kept: DataFrame,
    encoder: EncoderFactory,
    model: str = DEFAULT_MODEL,
    batch_size: int = DAILY_BATCH,
) -> DataFrame:
    """``(id, [pos,] embedding)`` of articles that already passed the category filter.

    A null abstract is embedded as the empty text.
    """
    keys = [c for c in ("id", "pos") if c in kept.columns]
    abstract = F.coalesce(passage_prefix(F.col("abstract"), model), F.lit(""))
    return embed_column(kept.select(*keys, abstract.alias("text")), "text", encoder, batch_size)


def embed_queries(
    requests: DataFrame,
    encoder: EncoderFactory,
    instruction: str = QUERY_INSTRUCTION,
    batch_size: int = DAILY_BATCH,
) -> DataFrame:
    """``(query_id, embedding)`` with the same encoder, on prefixed query text."""
    text = query_prefix(F.col("query_text"), instruction)
    return embed_column(
        requests.select("query_id", text.alias("text")), "text", encoder, batch_size
    )


#: Dimensions summed together by ``mean_pool``.
POOL_CHUNK = 32


def mean_pool(
    token_vectors: DataFrame, key: str, vector: str, mask: Column, width: int
) -> DataFrame:
    """Masked mean of the token vectors of each ``key``; null where all are masked.

    A vector is cut into a few chunks, each with one partial sum per dimension. That keeps
    the sums in generated code, which neither one row per dimension nor hundreds of sums
    side by side does, and a key with very many tokens is reduced before the shuffle.
    """
    starts = range(0, width, POOL_CHUNK)
    cut = F.array(*[F.slice(vector, start + 1, POOL_CHUNK) for start in starts])
    pieces = token_vectors.select(
        key, F.when(mask, 1).otherwise(0).alias("_used"), F.posexplode(cut).alias("_chunk", "_part")
    )
    used = F.when(F.col("_used") == 1, F.col("_part"))
    sums = [F.sum(F.get(used, F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(POOL_CHUNK)]
    summed = pieces.groupBy(key, "_chunk").agg(F.sum("_used").alias("_n"), *sums)
    means = F.array(*[F.try_divide(F.col(f"_s{i}"), F.col("_n")) for i in range(POOL_CHUNK)])
    chunks = F.array_sort(F.collect_list(F.struct("_chunk", means.alias("_mean"))))
    pooled = F.slice(F.flatten(chunks["_mean"]), 1, width)
    return summed.groupBy(key).agg(F.when(F.max("_n") > 0, pooled).alias(vector))
