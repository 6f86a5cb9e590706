"""The bulk run over a snapshot, and the steps that follow either ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import (
    BULK_BATCH,
    DEFAULT_CATEGORIES,
    DEFAULT_MODEL,
    NO_RESTART,
)
from paperloom.functions.articles import bulk_to_article, drop_authors_parsed
from paperloom.functions.encoders import EncoderFactory
from paperloom.operators.attach import attach_embeddings
from paperloom.operators.collection import feed_counters
from paperloom.operators.embed import embed_abstracts
from paperloom.operators.filters import (
    filter_cap,
    filter_categories_ci,
    filter_restart,
    in_categories_ci,
)
from paperloom.operators.positions import row_positions, stage_in_file_order
from paperloom.sinks.articles import upsert_articles, write_embeddings, write_jsonl
from paperloom.sinks.feed import ClientFactory, feed_documents
from paperloom.sources.jsonl import scan_articles, scan_snapshot
from paperloom.sources.vectors import scan_embeddings
from paperloom.streaming.cursor import seed_cursor


def normalise_snapshot(
    spark: SparkSession,
    snapshot: str,
    out: str,
    cursor: str | None = None,
    snapshot_updated: str | None = None,
) -> None:
    """Snapshot to canonical JSON lines; seeds the daily cursor from the snapshot's date."""
    write_jsonl(bulk_to_article(scan_snapshot(spark, snapshot)), out)
    if cursor and snapshot_updated:
        seed_cursor(spark, cursor, snapshot_updated)


def embed_articles(
    spark: SparkSession,
    articles: str,
    out: str,
    encoder: EncoderFactory,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    model: str = DEFAULT_MODEL,
    batch_size: int = BULK_BATCH,
) -> None:
    """Embed the abstracts of the wanted articles, keyed by id, numbered in file order.

    Wanted are those that ``feed_articles`` feeds, so that every one has a vector.
    """
    embed_rows(scan_articles(spark, articles), out, encoder, subset, model, batch_size)


def embed_rows(
    articles: DataFrame,
    out: str,
    encoder: EncoderFactory,
    subset: Sequence[str],
    model: str,
    batch_size: int,
    mode: str = "errorifexists",
) -> None:
    """The same for scanned articles."""
    kept = filter_categories_ci(articles, subset)
    numbered = row_positions(stage_in_file_order(kept.select("id", "abstract")))
    write_embeddings(embed_abstracts(numbered, encoder, model, batch_size), out, mode)


def collect_articles(
    spark: SparkSession,
    articles: str,
    collection: str,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    load_seq: int | None = None,
) -> None:
    """Merge the wanted articles of the snapshot into the one collection of both ingests."""
    part = _input(spark, articles)
    upsert_articles(spark, collection, filter_categories_ci(part, subset), load_seq)


def feed_articles(
    spark: SparkSession,
    articles: str,
    embeddings: str,
    client: ClientFactory,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    restart_from: int = NO_RESTART,
    cap: int | None = None,
    **options: str,
) -> Row:
    """Feed the wanted articles with their embeddings; returns the counters of the run.

    All of them, unless a position to resume from or a ``cap`` is given; only then is the input
    numbered. The vectors are joined by id whatever part is fed. A wanted article without a
    vector fails the run: what the counters call fed was fed.
    """
    part = _input(spark, articles)
    if cap is not None or restart_from != NO_RESTART:
        part = filter_restart(row_positions(stage_in_file_order(part)), restart_from)
        part = part if cap is None else filter_cap(part, cap)
    return feed_rows(part, scan_embeddings(spark, embeddings), client, subset, **options)


def feed_rows(
    part: DataFrame,
    embeddings: DataFrame,
    client: ClientFactory,
    subset: Sequence[str],
    **options: str,
) -> Row:
    """Feed the wanted ones of some articles; all need a vector."""
    kept = filter_categories_ci(part, subset)
    feed_documents(attach_embeddings(kept, embeddings), client=client, **options)
    return feed_counters(part, in_categories_ci(F.col("categories"), subset)).first()


def _input(spark: SparkSession, articles: str) -> DataFrame:
    return drop_authors_parsed(scan_articles(spark, articles))
