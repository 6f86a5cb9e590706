"""Column expressions that turn raw records into canonical articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import (
    API_ORIGIN,
    BULK_ORIGIN,
    LINK_PREFIX,
    UPDATE_DATE_FORMAT,
)
from paperloom.schemas import ARTICLE

_OUTER_SPACE = r"(?U)^\s+|\s+$"
_HAS_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_RENAMED = {"journal-ref": "journal_ref", "report-no": "report_no"}


def rename_fields(raw: DataFrame) -> DataFrame:
    """Replace the dashes that table columns cannot hold; other columns pass through."""
    return raw.withColumnsRenamed(_RENAMED)


def split_categories(categories: Column) -> Column:
    return F.split(categories, " ")


def author_records(authors_parsed: Column, lenient: bool = False) -> Column:
    """``[[last, first, other], …]`` to records; parts after the third are dropped.

    A shorter author raises, as the record would be incomplete; ``lenient`` leaves nulls.
    """

    def part(author: Column, i: int) -> Column:
        # In ANSI mode a plain subscript past the end is an error, get() is null.
        return F.get(author, i) if lenient else author[i]

    return F.transform(
        authors_parsed,
        lambda author: F.struct(
            part(author, 0).alias("last_name"),
            part(author, 1).alias("first_name"),
            part(author, 2).alias("other_name"),
        ),
    )


def author_names(records: Column) -> Column:
    """``"first last other"`` per author, without outer white space of any kind."""
    return F.transform(
        records,
        lambda a: F.regexp_replace(
            F.concat_ws(
                " ",
                F.coalesce(a["first_name"], F.lit("")),
                F.coalesce(a["last_name"], F.lit("")),
                F.coalesce(a["other_name"], F.lit("")),
            ),
            _OUTER_SPACE,
            "",
        ),
    )


def format_update_date(date: Column) -> Column:
    """ISO date or date-time to the stored form, keeping its own wall clock."""
    return F.date_format(F.to_timestamp_ntz(date), UPDATE_DATE_FORMAT)


def update_epoch(date: Column) -> Column:
    """Epoch seconds; a date without a zone is UTC whatever the session zone is."""
    naive = F.timestamp_diff(
        "SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.to_timestamp_ntz(date)
    )
    zoned = F.unix_timestamp(F.to_timestamp(date))
    return F.when(date.rlike(_HAS_ZONE), zoned).otherwise(naive)


def latest_version(versions: Column, numeric: bool = False) -> Column:
    """The last version by string order, in which ``v9`` follows ``v10``.

    ``numeric`` orders by the number instead. No versions at all is an error.
    """
    if numeric:
        newest = F.array_max(
            F.transform(
                versions,
                lambda v: F.struct(
                    F.regexp_extract(v["version"], r"(\d+)$", 1).cast("int").alias("n"),
                    v["version"].alias("version"),
                ),
            )
        )["version"]
    else:
        newest = F.array_max(versions["version"])
    return F.coalesce(newest, F.raise_error(F.lit("article without versions")))


def versioned_link(raw_id: Column, version: Column) -> Column:
    return F.concat(F.lit(LINK_PREFIX), raw_id, version)


def versioned_id(raw_id: Column, version: Column) -> Column:
    return F.concat(raw_id, version)


def id_from_link(link: Column) -> Column:
    """The last path segment; an old-style id loses its archive prefix."""
    return F.element_at(F.split(link, "/"), -1)


def version_suffix(article_id: Column, strict: bool = False) -> Column:
    """The last two characters; ``strict`` takes the whole ``v<number>`` suffix."""
    if strict:
        return F.regexp_extract(article_id, r"(v[0-9]+)$", 1)
    return F.right(article_id, F.lit(2))


def terms_of(tags: Column) -> Column:
    return F.coalesce(tags["_term"], F.array().cast("array<string>"))


def names_of(authors: Column) -> Column:
    return F.coalesce(authors["name"], F.array().cast("array<string>"))


def bulk_to_article(raw: DataFrame, lenient: bool = False, numeric: bool = False) -> DataFrame:
    """Normalise the bulk snapshot: one projection, no shuffle.

    Names always come from ``authors_parsed``, which stays as a bulk-only extra column.
    """
    renamed = rename_fields(raw)
    version = latest_version(F.col("versions"), numeric)
    records = author_records(F.col("authors_parsed"), lenient)
    computed = {
        "id": versioned_id(F.col("id"), version),
        "link": versioned_link(F.col("id"), version),
        "authors": author_names(records),
        "categories": split_categories(F.col("categories")),
        "update_date": format_update_date(F.col("update_date")),
        "update_date_ts": update_epoch(F.col("update_date")),
        "origin": F.lit(BULK_ORIGIN),
    }
    return renamed.select(
        *[
            computed.get(name, F.col(name)).alias(name)
            for name in [*ARTICLE.names, "authors_parsed"]
            if name != "authors_parsed"
        ],
        records.alias("authors_parsed"),
    )


def api_to_article(
    entries: DataFrame,
    run_date: str,
    strict_version: bool = False,
    keep_journal_ref: bool = False,
) -> DataFrame:
    """Normalise expanded Atom entries (columns of the entry schema plus page and pos).

    The entry's journal reference sits behind a name prefix that the usual lookup misses,
    so it is null unless ``keep_journal_ref``. An entry without an update date gets the
    run date.
    """
    missing = F.lit(None).cast("string")
    article_id = id_from_link(F.col("id"))
    updated = F.coalesce(F.col("updated"), F.lit(run_date))
    first_version = F.struct(
        version_suffix(article_id, strict_version).alias("version"),
        F.col("published").alias("created"),
    )
    computed = {
        "id": article_id,
        "link": F.col("id"),
        "submitter": missing,
        "authors": names_of(F.col("author")),
        "title": F.col("title"),
        "comments": F.col("comment"),
        "journal_ref": F.col("journal_ref") if keep_journal_ref else missing,
        "doi": missing,
        "report_no": missing,
        "categories": terms_of(F.col("category")),
        "license": missing,
        "abstract": F.col("summary"),
        "versions": F.array(first_version),
        "update_date": format_update_date(updated),
        "update_date_ts": update_epoch(updated),
        "origin": F.lit(API_ORIGIN),
    }
    place = [F.col(c) for c in ("page", "pos") if c in entries.columns]
    return entries.select(*place, *[computed[name].alias(name) for name in ARTICLE.names])


def drop_authors_parsed(articles: DataFrame) -> DataFrame:
    return articles.drop("authors_parsed")


def feed_document(articles: DataFrame) -> DataFrame:
    """``{id, fields{…, abstract_embedding{values}}}`` from articles with an embedding."""
    fields = [F.col(name) for name in ARTICLE.names]
    vector = F.struct(F.col("embedding").alias("values")).alias("abstract_embedding")
    return articles.select("id", F.struct(*fields, vector).alias("fields"))
