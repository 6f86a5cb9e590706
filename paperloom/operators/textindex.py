"""Term postings and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import BM25_B, BM25_K1
from paperloom.functions.text import article_text, tokens
from paperloom.operators.joins import MAX_BROADCAST_ROWS, lookup_join
from paperloom.session import stored_once

# Stands for "an article of this length"; no token is empty.
_LENGTH = ""

#: Folders that stored postings are split into, by a hash of the term.
TERM_BUCKETS = 256


@dataclass(frozen=True)
class TextIndex:
    """What keyword search needs of a collection: either form is enough.

    ``tokenised`` has ``id, categories, terms`` per article, and nothing has been computed.
    ``postings`` has ``id, categories, dl, term, tf`` (``dl`` is the article's token count)
    and was stored together with the one-row ``corpus``.
    """

    tokenised: DataFrame | None = None
    postings: DataFrame | None = None
    corpus: DataFrame | None = None


@dataclass(frozen=True)
class Matches:
    """Postings of the wanted terms, and the corpus statistics that weigh them."""

    postings: DataFrame
    corpus: DataFrame


def index_articles(articles: DataFrame) -> TextIndex:
    """Index a collection on the fly: nothing runs until a search does."""
    text = article_text(F.col("title"), F.col("abstract"))
    return TextIndex(articles.select("id", "categories", tokens(text).alias("terms")))


def save_index(index: TextIndex, path: str) -> None:
    """Store the index, for collections that are searched more than once.

    Postings are kept in folders by term hash, so that a search reads only the folders of
    its terms. A frequent term makes its folder large, not its files: the writer splits it.
    """
    corpus_stats(index).write.mode("overwrite").parquet(f"{path}/corpus")
    (
        all_postings(index)
        .withColumn("bucket", term_bucket(F.col("term")))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )


def load_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(
        postings=spark.read.parquet(f"{path}/postings"),
        corpus=spark.read.parquet(f"{path}/corpus"),
    )


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def all_postings(index: TextIndex) -> DataFrame:
    """``id, categories, dl, term, tf`` for every term of every article."""
    if index.postings is not None:
        return index.postings.drop("bucket")
    return _count_terms(_occurrences(index)).where(F.col("term").isNotNull())


def match_terms(index: TextIndex, terms: DataFrame, n_terms: int) -> Matches:
    """Postings of the given distinct ``term`` rows (at most ``n_terms``), read once.

    Postings are used several times by a search (weights, scores, ranks), and the articles
    must not be tokenised again for each. So the postings that match, a small part of the
    text, are written to the shared folder.

    The same pass measures the corpus: every article also yields the impossible term ``''``
    without its id, and these rows collapse to one per article length inside each task.
    """
    if index.postings is not None:
        wanted = terms.withColumn("bucket", term_bucket(F.col("term")))
        found = lookup_join(index.postings, wanted, ["bucket", "term"], ["id"], n_terms)
        return Matches(stored_once(found.drop("bucket"), "matches"), index.corpus)

    marked = terms.unionByName(terms.sparkSession.range(1).select(F.lit(_LENGTH).alias("term")))
    rows = _occurrences(index, F.array_append("terms", F.lit(_LENGTH)))
    is_term = F.col("term") != _LENGTH
    rows = rows.withColumns(
        {c: F.when(is_term, F.col(c)) for c in ("id", "categories")}
    )
    if n_terms <= MAX_BROADCAST_ROWS:
        found = _count_terms(lookup_join(rows, marked, ["term"], ["id"], n_terms + 1))
    else:
        found = lookup_join(_count_terms(rows), marked, ["term"], ["id"], n_terms + 1)
    stored = stored_once(found, "matches")
    lengths = stored.where(~is_term)
    corpus = lengths.agg(
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n_articles"),
        F.try_divide(F.sum(F.col("tf") * F.col("dl")), F.sum("tf")).alias("mean_length"),
    )
    return Matches(stored.where(is_term), corpus)


def term_stats(index: TextIndex) -> DataFrame:
    """Document frequency and total frequency of every term, with one exchange of partial sums.

    Each article's distinct terms come before all its tokens in one array, so a row's place
    tells what it counts for, and no pair of article and term is ever grouped.
    """
    if index.postings is not None:
        return (
            index.postings.groupBy("term")
            .agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
        )
    listed = index.tokenised.select(F.array_distinct("terms").alias("distinct"), "terms").select(
        F.size("distinct").alias("n"),
        F.posexplode_outer(F.concat("distinct", "terms")).alias("place", "term"),
    )
    return (
        listed.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.count_if(F.col("place") < F.col("n")).alias("df"),
            F.count_if(F.col("place") >= F.col("n")).alias("total_tf"),
        )
    )


def corpus_stats(index: TextIndex) -> DataFrame:
    """One row: number of articles and their mean length."""
    if index.corpus is not None:
        return index.corpus
    return index.tokenised.agg(
        F.count("*").alias("n_articles"), F.avg(F.size("terms")).alias("mean_length")
    )


def weights(matches: Matches) -> DataFrame:
    """``term, df, idf, mean_length, most`` of the matched terms, one row per distinct term;
    ``most`` is the term's largest contribution."""
    mean_length = matches.corpus.select("mean_length").scalar()
    n = matches.corpus.select("n_articles").scalar()
    df = F.col("df")
    return (
        matches.postings.groupBy("term")
        .agg(
            F.count("*").alias("df"),
            F.max(bm25(F.col("tf"), F.col("dl"), F.lit(1.0), mean_length)).alias("share"),
        )
        .withColumn("idf", F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)))
        .select(
            "term", "df", "idf", mean_length.alias("mean_length"),
            (F.col("idf") * F.col("share")).alias("most"),
        )
    )


def bm25(tf: Column, dl: Column, idf: Column, mean_length: Column) -> Column:
    """Okapi BM25 contribution of one term."""
    saturation = tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean_length)
    return idf * tf * (BM25_K1 + 1) / saturation


def _occurrences(index: TextIndex, terms: Column | None = None) -> DataFrame:
    """One row per token. The outer form keeps the planner from tokenising twice, once to
    drop articles without tokens and once to explode them."""
    exploded = F.explode_outer(F.col("terms") if terms is None else terms)
    return index.tokenised.withColumn("dl", F.size("terms")).select(
        "id", "categories", "dl", exploded.alias("term")
    )


def _count_terms(occurrences: DataFrame) -> DataFrame:
    """All tokens of an article are in one row, so tasks finish these counts before the
    shuffle and no token travels twice."""
    return occurrences.groupBy("id", "categories", "dl", "term").agg(F.count("*").alias("tf"))

