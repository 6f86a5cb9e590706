"""The daily run over landed result pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import (
    API_PAGE_SIZE,
    CURSOR_MARGIN,
    DAILY_BATCH,
    DEFAULT_CATEGORIES,
    DEFAULT_MODEL,
)
from paperloom.functions.articles import api_to_article, terms_of
from paperloom.functions.encoders import EncoderFactory
from paperloom.operators.filters import filter_categories_ci, in_categories
from paperloom.operators.paging import (
    filter_page_cutoff,
    filter_page_limit,
    page_counts,
)
from paperloom.plans.bulk import embed_rows, feed_rows
from paperloom.session import stored_once
from paperloom.sinks.articles import upsert_articles, write_dated_overwrite
from paperloom.sinks.feed import ClientFactory
from paperloom.sources.atom import scan_atom_pages
from paperloom.sources.jsonl import scan_dated_partition, with_defaults
from paperloom.sources.vectors import scan_embeddings
from paperloom.streaming.cursor import advance_cursor, read_cursor


@dataclass(frozen=True)
class DailyReport:
    """What a run did: entries fetched, pages to request again, whether the cursor moved."""

    fetched: int
    short_pages: tuple[int, ...]
    moved: bool


def accepted_pages(
    entries: DataFrame, cursor: Column, subset: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """All entries of the pages back to three hours before the cursor, whole pages at a time."""
    floor = cursor - F.expr(f"interval {CURSOR_MARGIN}")
    return filter_page_cutoff(entries, floor, F.to_timestamp("updated"), _wanted(subset))


def select_pages(
    entries: DataFrame,
    cursor: Column,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    last_page: int | None = None,
) -> DataFrame:
    """The wanted entries of the pages that a run since ``cursor`` accepts.

    Short pages count as well, for what they hold; ``last_page`` sets a page budget. The
    category filter comes last.
    """
    budget = entries if last_page is None else filter_page_limit(entries, last_page)
    return accepted_pages(budget, cursor, subset).where(_wanted(subset))


def daily_articles(
    entries: DataFrame,
    cursor: Column,
    run_date: str,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    last_page: int | None = None,
) -> DataFrame:
    """Landed entries to the canonical articles of one run."""
    return api_to_article(select_pages(entries, cursor, subset, last_page), run_date)


def run_daily(
    spark: SparkSession,
    pages: str,
    out: str,
    cursor: str,
    run_date: str,
    page_size: int = API_PAGE_SIZE,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    last_page: int | None = None,
) -> DailyReport:
    """One run: landed pages to the run's folder, then the cursor.

    Repeating a run replaces its own folder only. The cursor moves after the articles are
    stored, from what was stored. It stays if an inner page was short or ``last_page`` cut
    pages off that the run would have accepted: the next run then reaches back as far as this
    one, and loses nothing. The last page may be short. Pages are parsed once, and counted from
    the stored entries.
    """
    entries = stored_once(scan_atom_pages(spark, pages), "entries")
    since = read_cursor(spark, cursor)
    write_dated_overwrite(
        daily_articles(entries, since, run_date, subset, last_page), out, run_date
    )
    accepted = accepted_pages(entries, since, subset)
    used = accepted if last_page is None else filter_page_limit(accepted, last_page)
    counts = page_counts(used).orderBy("page").collect()  # one row per page of a day's listing
    last = entries.agg(F.max("page")).first()[0]
    short = tuple(r.page for r in counts if r.page_rows != page_size and r.page != last)
    cut = last_page is not None and accepted.where(F.col("page") > last_page).limit(1).count() > 0
    if not short and not cut:
        advance_cursor(spark, cursor, scan_dated_partition(spark, out, run_date))
    return DailyReport(sum(r.page_rows for r in counts), short, not short and not cut)


def embed_day(
    spark: SparkSession,
    out: str,
    vectors: str,
    run_date: str,
    encoder: EncoderFactory,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    model: str = DEFAULT_MODEL,
    batch_size: int = DAILY_BATCH,
) -> None:
    """Embed the articles that the run of a date stored; repeating it replaces its vectors only."""
    articles = with_defaults(scan_dated_partition(spark, out, run_date))
    embed_rows(articles, _dated(vectors, run_date), encoder, subset, model, batch_size, "overwrite")


def feed_day(
    spark: SparkSession,
    out: str,
    vectors: str,
    run_date: str,
    client: ClientFactory,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    **options: str,
) -> Row:
    """Feed the articles of one run with its vectors, as the documents of that run; returns the
    counters. The run's date names its input and its feed, so a run that is repeated, or that
    passes midnight, stays one run."""
    articles = scan_dated_partition(spark, out, run_date).drop("ingest_date")
    embeddings = scan_embeddings(spark, _dated(vectors, run_date))
    return feed_rows(articles, embeddings, client, subset, run=run_date, **options)


def collect_day(
    spark: SparkSession,
    out: str,
    collection: str,
    run_date: str,
    subset: Sequence[str] = DEFAULT_CATEGORIES,
    load_seq: int | None = None,
) -> None:
    """Merge the articles of one run into the one collection of both ingests."""
    articles = with_defaults(scan_dated_partition(spark, out, run_date))
    upsert_articles(spark, collection, filter_categories_ci(articles, subset), load_seq)


def _dated(path: str, run_date: str) -> str:
    return f"{path}/ingest_date={run_date}"


def _wanted(subset: Sequence[str]) -> Column:
    return in_categories(terms_of(F.col("category")), subset)
