"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("created", T.StringType())]
)

#: One line of the bulk snapshot.
RAW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("submitter", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("journal-ref", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("report-no", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("versions", T.ArrayType(VERSION)),
        T.StructField("update_date", T.StringType()),
        T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

#: The canonical article, the same from both ingests.
ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("submitter", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("journal_ref", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("report_no", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("license", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("versions", T.ArrayType(VERSION)),
        T.StructField("update_date", T.StringType()),
        T.StructField("update_date_ts", T.LongType()),
        T.StructField("origin", T.StringType()),
    ]
)

AUTHOR_RECORD = T.StructType(
    [
        T.StructField("last_name", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("other_name", T.StringType()),
    ]
)

#: A bulk article before the bulk-only column is dropped.
BULK_ARTICLE = T.StructType(
    ARTICLE.fields + [T.StructField("authors_parsed", T.ArrayType(AUTHOR_RECORD))]
)

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
        ),
        T.StructField(
            "category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))
        ),
        T.StructField("comment", T.StringType()),
        T.StructField("journal_ref", T.StringType()),
    ]
)

#: One Atom result page.
ATOM = T.StructType([T.StructField("entry", T.ArrayType(ENTRY))])

EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

#: A table of search requests.
QUERY = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

CURSOR = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)
