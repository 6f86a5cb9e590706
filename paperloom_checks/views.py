"""Inputs derived from the given tables, in Spark; ``sql.py`` has the same formulas in SQL.

Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import SEARCH_PROFILES
from paperloom.functions.articles import bulk_to_article

PAGE_SIZE = 48
SUBSET = ["en", "src3", "src7"]
RUN_DATE = "2024-06-30"
NEXT_RUN_DATE = "2024-07-01"
CURSOR = "2024-06-29T19:00:00"
POOL_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def raw_id(doc_id: Column) -> Column:
    """``yymm.number`` with a month that depends on the number."""
    month = F.lpad((doc_id % 12 + 1).cast("string"), 2, "0")
    return F.concat(F.lit("24"), month, F.lit("."), F.lpad(doc_id.cast("string"), 12, "0"))


def article_id(doc_id: Column) -> Column:
    """The id after normalisation: the last version by string order is at most v9."""
    return F.concat(raw_id(doc_id), F.lit("v"), F.least(doc_id % 12 + 1, F.lit(9)).cast("string"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, lang = F.col("doc_id"), F.col("lang")
    text = F.lit
    versions = F.transform(
        F.sequence(F.lit(1).cast("bigint"), doc_id % 12 + 1),
        lambda n: F.struct(
            F.concat(text("v"), n.cast("string")).alias("version"),
            text("Mon, 1 Jan 2024 00:00:00 GMT").alias("created"),
        ),
    )
    authors = F.array(
        F.array(
            F.concat(text("Last"), (doc_id % 7).cast("string")),
            F.when(doc_id % 3 == 0, "").otherwise("F."),
            F.when(doc_id % 4 == 0, "Jr").otherwise(""),
        ),
        F.array(text("Doe"), text("J."), text("")),
    )
    return documents(spark, sf_dir).select(
        raw_id(doc_id).alias("id"),
        F.col("source").alias("submitter"),
        text("raw author line").alias("authors"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(doc_id % 3 != 0, F.concat(text("n "), F.col("n_chars").cast("string"))).alias(
            "comments"
        ),
        F.when(doc_id % 4 == 0, F.concat(text("J "), doc_id.cast("string"))).alias("journal-ref"),
        text(None).cast("string").alias("doi"),
        F.when(doc_id % 6 == 0, F.concat(text("R "), doc_id.cast("string"))).alias("report-no"),
        F.concat(
            F.when(doc_id % 5 == 0, F.upper(lang)).otherwise(lang), text(" "), F.col("source")
        ).alias("categories"),
        text(None).cast("string").alias("license"),
        F.col("text").alias("abstract"),
        versions.alias("versions"),
        F.date_format(
            F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 365).cast("int")), "yyyy-MM-dd"
        ).alias("update_date"),
        authors.alias("authors_parsed"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk collection after normalisation."""
    return bulk_to_article(raw_articles(spark, sf_dir))


def api_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded result pages, newest first, one minute apart; the last page is short."""
    doc_id = F.col("doc_id")
    updated = F.lit(f"{RUN_DATE}T00:00:00").cast("timestamp_ntz") - F.make_dt_interval(
        mins=doc_id.cast("int")
    )
    author = F.struct(F.concat(F.lit("Author "), (doc_id % 7).cast("string")).alias("name"))
    return documents(spark, sf_dir).select(
        F.expr(f"doc_id div {PAGE_SIZE}").alias("page"),
        (doc_id % PAGE_SIZE).alias("pos"),
        F.concat(
            F.lit("http://arxiv.org/abs/"),
            raw_id(doc_id),
            F.lit("v"),
            (doc_id % 12 + 1).cast("string"),
        ).alias("id"),
        F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"),
        F.lit("2024-01-01T00:00:00Z").alias("published"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        F.array(author, F.struct(F.lit("J. Doe").alias("name"))).alias("author"),
        F.array(
            F.struct(F.col("lang").alias("_term")), F.struct(F.col("source").alias("_term"))
        ).alias("category"),
        F.when(doc_id % 3 != 0, F.concat(F.lit("n "), F.col("n_chars").cast("string"))).alias(
            "comment"
        ),
        F.lit(None).cast("string").alias("journal_ref"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per benchmark item: its whole text."""
    item_id = F.col("item_id")
    profile = F.element_at(
        F.array(*[F.lit(p) for p in SEARCH_PROFILES]), (item_id % 4 + 1).cast("int")
    )
    return table(spark, sf_dir, "benchmark").select(
        item_id.alias("query_id"),
        F.col("text").alias("query_text"),
        profile.alias("profile"),
        F.when(item_id % 8 == 0, "en").alias("category"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors, keyed by article id."""
    return table(spark, sf_dir, "embeddings").select(
        article_id(F.col("vec_id")).alias("id"), F.col("vec_id").alias("pos"), "embedding"
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vector of a request is the stored vector with its number."""
    stored = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )
    return stored.join(requests(spark, sf_dir).select("query_id"), "query_id", "left_semi")
