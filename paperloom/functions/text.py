"""Text analysis, prefixes and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.constants import (
    DEFAULT_MODEL,
    PASSAGE_PREFIX,
    PASSAGE_PREFIX_MODEL,
    QUERY_INSTRUCTION,
)

# A token is a maximal run of letters and digits.
NOT_TOKEN = r"[^\p{L}\p{N}]+"
_RUNS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in text order; no stemming and no stop words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), "")


def article_text(title: Column, abstract: Column) -> Column:
    """The searched text: title and abstract as one."""
    return F.concat_ws(" ", title, abstract)


def passage_prefix(abstract: Column, model: str = DEFAULT_MODEL) -> Column:
    if model == PASSAGE_PREFIX_MODEL:
        return F.concat(F.lit(PASSAGE_PREFIX), abstract)
    return abstract


def query_prefix(query_text: Column, instruction: str = QUERY_INSTRUCTION) -> Column:
    """The model instruction, one more space, and the query; no instruction, no change."""
    if not instruction:
        return query_text
    return F.concat(F.lit(instruction), F.lit(" "), query_text)


def query_casefold(query_text: Column, profile: Column) -> Column:
    """Only the two blended profiles lower-case the query."""
    return F.when(profile.isin("hybrid", "fusion"), F.lower(query_text)).otherwise(query_text)


def highlight(text: Column, terms: Column) -> Column:
    """Wrap every token of ``text`` that is in ``terms`` in ``<hi>…</hi>``.

    The text is cut into runs by one fixed pattern, so word borders are the tokeniser's
    and no pattern is compiled per row.
    """
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(1))
    marked = F.transform(
        runs,
        lambda run: F.when(
            F.array_contains(terms, F.lower(run)),
            F.concat(F.lit("<hi>"), run, F.lit("</hi>")),
        ).otherwise(run),
    )
    return F.array_join(marked, "")


def show_marks(text: Column, mark: str) -> Column:
    """Replace highlight tags by display marks."""
    return F.replace(F.replace(text, F.lit("<hi>"), F.lit(mark)), F.lit("</hi>"), F.lit(mark))
