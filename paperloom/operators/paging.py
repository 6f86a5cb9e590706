"""Rules that work on result pages rather than on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import API_LAST_PAGE, API_PAGE_SIZE


def filter_full_pages(entries: DataFrame, page_size: int = API_PAGE_SIZE) -> DataFrame:
    """Entries of pages that hold exactly ``page_size`` of them.

    The page reader counts each page while it expands it (``page_rows``), so landed pages
    need no shuffle. Other tables are counted per page, with partial sums.
    """
    if "page_rows" in entries.columns:
        return entries.where(F.col("page_rows") == page_size)
    full = page_counts(entries).where(F.col("page_rows") == page_size).select("page")
    return entries.join(full, "page", "left_semi")


def short_pages(entries: DataFrame, page_size: int = API_PAGE_SIZE) -> DataFrame:
    """The pages that hold another number of entries, for the report."""
    return page_counts(entries).where(F.col("page_rows") != page_size)


def page_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("page").agg(F.count("pos").alias("page_rows"))


def filter_page_limit(entries: DataFrame, last_page: int = API_LAST_PAGE) -> DataFrame:
    return entries.where(F.col("page") <= last_page)


def filter_page_cutoff(
    entries: DataFrame, cursor: Column, updated: Column, keep: Column
) -> DataFrame:
    """Pages up to and including the first whose newest kept entry is before the cursor.

    Later rows of that page stay even if they are older: the stop works on whole pages.
    A page without a kept entry can only repeat an earlier page's answer, so the stop is
    simply the lowest page whose own newest kept entry is too old. That is one partial
    aggregate and one value, not a running window over all pages.
    """
    newest = entries.groupBy("page").agg(
        F.min_by(updated, F.when(keep, F.col("pos"))).alias("newest")
    )
    stop = newest.where(F.col("newest") < cursor).agg(F.min("page").alias("stop_page"))
    return entries.where(
        F.col("page") <= F.coalesce(stop.scalar(), F.lit(2**63 - 1))
    )


def fetch_counter(accepted: DataFrame, page_size: int = API_PAGE_SIZE) -> DataFrame:
    """Rows fetched for the accepted pages, before any category filter."""
    return accepted.select("page").distinct().agg(
        (F.count("*") * F.lit(page_size)).alias("fetched")
    )


def max_update_date(stored: DataFrame, updated: Column) -> DataFrame:
    """The next cursor."""
    return stored.agg(F.max(updated).alias("last_updated"))


def page_by_update(
    articles: DataFrame, updated: Column, page: int, page_size: int = API_PAGE_SIZE
) -> DataFrame:
    """One page of the newest-first listing.

    The plan keeps ``(page + 1) * page_size`` rows per task; to go far, use ``page_after``.
    """
    return (
        articles.orderBy(updated.desc(), F.col("id").asc())
        .offset(page * page_size)
        .limit(page_size)
    )


def page_after(
    articles: DataFrame, updated: Column, last: tuple | None, page_size: int = API_PAGE_SIZE
) -> DataFrame:
    """The page behind the row ``last`` = (updated, id) of the newest-first listing.

    Each task keeps one page however far the listing has got; without ``last`` it starts.
    """
    rest = articles
    if last is not None:
        newest, seen = F.lit(last[0]), F.lit(last[1])
        rest = articles.where((updated < newest) | ((updated == newest) & (F.col("id") > seen)))
    return rest.orderBy(updated.desc(), F.col("id").asc()).limit(page_size)


def page_token(page: DataFrame, updated: Column) -> tuple | None:
    """(updated, id) of a page's last row: what ``page_after`` resumes from. None if it is empty."""
    last = page.select(updated.alias("updated"), "id")
    row = last.orderBy(F.col("updated").asc(), F.col("id").desc()).first()
    return None if row is None else tuple(row)
