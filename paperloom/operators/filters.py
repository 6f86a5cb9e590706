"""Row filters. None of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import DEFAULT_CATEGORIES, FEED_CAP, NO_RESTART


def fold_subset(subset: Sequence[str]) -> Column:
    """The wanted categories as a lower-cased set: folded here, so the plan has a constant."""
    return _literal(list(dict.fromkeys(c.lower() for c in subset)))


def in_categories(categories: Column, subset: Sequence[str] = DEFAULT_CATEGORIES) -> Column:
    """Case-sensitive overlap; null for neither missing nor null-holding lists."""
    return F.coalesce(F.arrays_overlap(categories, _literal(subset)), F.lit(False))


def in_categories_ci(categories: Column, subset: Sequence[str] = DEFAULT_CATEGORIES) -> Column:
    """Overlap with both sides lower-cased. Keeps rows that the other one drops."""
    lowered = F.transform(categories, F.lower)
    return F.coalesce(F.arrays_overlap(lowered, fold_subset(subset)), F.lit(False))


def filter_categories(
    articles: DataFrame, subset: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    return articles.where(in_categories(F.col("categories"), subset))


def filter_categories_ci(
    articles: DataFrame, subset: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    return articles.where(in_categories_ci(F.col("categories"), subset))


def filter_restart(numbered: DataFrame, restart_from: int = NO_RESTART) -> DataFrame:
    """Resume at a position. Positions are already assigned, so vectors stay aligned."""
    return numbered.where(F.col("pos") >= restart_from)


def filter_cap(numbered: DataFrame, cap: int = FEED_CAP) -> DataFrame:
    """Stop after the input counter passes ``cap``; the row that passes it is included."""
    return numbered.where(F.col("pos") <= cap)


def filter_query_category(pairs: DataFrame) -> DataFrame:
    """Keep (request, article) rows whose article has the requested category, if any."""
    return pairs.where(category_matches(F.col("category"), F.col("categories")))


def category_matches(wanted: Column, categories: Column) -> Column:
    return wanted.isNull() | F.coalesce(F.array_contains(categories, wanted), F.lit(False))


def filter_blank_query(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("query_text") != "")


def _literal(subset: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in subset]).cast("array<string>")
