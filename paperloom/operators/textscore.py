"""BM25 scores of requests, and the best of them without scoring every match.

A posting's contribution depends on the term and the article only, so every term has a largest
one. Terms whose largest contributions together stay below what a request's k-th best match is
known to reach cannot bring an article among the best by themselves: articles are looked for by
the other, rarer terms, and only those whose bound reaches the floor are scored in full.
Contributions are summed as whole numbers, so a score is the same whichever way it was summed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import SCORE_DIGITS
from paperloom.operators.joins import by_article, lookup_join
from paperloom.operators.textindex import Matches, bm25
from paperloom.operators.topk import top_k
from paperloom.session import stored_once

PAIR = ["query_id", "id"]
#: Contributions are summed in units of this.
UNIT = 1e-13
#: Matches up to which all are scored. Either way gives the same rows.
ALL_MATCHES = 50_000_000
#: What rounded scores may differ by from those that bounds are compared with.
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class Asked:
    """Requests to be answered from matched postings.

    ``terms`` has a row per request and distinct term that any article has: ``query_id, category,
    profile, n_terms, term, df, idf, mean_length, most``, ``most`` being the term's largest
    contribution. ``bound`` is a proven bound on its rows, and ``cost`` one on the postings
    that the requests' terms have together, so on the matches of all requests.
    """

    matches: Matches
    terms: DataFrame
    bound: int
    cost: int

    def of(self, profile: str) -> Asked:
        return replace(self, terms=self.terms.where(F.col("profile") == profile))

    @property
    def is_small(self) -> bool:
        """Whether scoring every match costs less than the jobs that find out which to score."""
        return self.cost <= ALL_MATCHES


def contribution() -> Column:
    score = bm25(F.col("tf"), F.col("dl"), F.col("idf"), F.col("mean_length"))
    return F.round(score / UNIT).cast("long")


def summed(contributions: Column) -> Column:
    return F.round(F.sum(contributions) * UNIT, SCORE_DIGITS)


def score_matches(asked: Asked) -> DataFrame:
    """Every article with any term of a request: ``query_id, id, text, n_matched, n_terms``.

    Postings are brought together by article and the terms are joined to them where they are, so
    the sums need no further shuffle, in as many tasks as the matches need. The result has a row for nearly every request and article
    where requests hold common words; the searches read it only to count ranks.
    """
    postings = by_article(asked.matches.postings.drop("categories"), asked.cost)
    return _by_pair(lookup_join(postings, asked.terms, ["term"], ["id"], asked.bound))


def score_pairs(asked: Asked, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """The same for given pairs of request and article that share a term."""
    postings = asked.matches.postings.drop("categories")
    held = lookup_join(postings, pairs.select(*PAIR), ["id"], ["term"], n_pairs)
    return _by_pair(lookup_join(held, asked.terms, ["query_id", "term"], ["id"], asked.bound))


def _by_pair(matched: DataFrame) -> DataFrame:
    return matched.groupBy(*PAIR).agg(
        summed(contribution()).alias("text"),
        F.count("*").alias("n_matched"),
        F.max("n_terms").alias("n_terms"),
    )


def matches_of_all_terms(asked: Asked) -> DataFrame:
    """Scores of the articles that hold all terms of a request, in its category if it names one.

    Only articles with the request's rarest term can hold all, and those are what is scored. A
    request with a term that no article has is not looked for.
    """
    rarest = asked.terms.groupBy("query_id").agg(
        F.min(F.struct("df", "term")).alias("least"),
        F.first("category").alias("category"),
        (F.count("*") == F.max("n_terms")).alias("possible"),
    )
    wanted = rarest.where("possible").select("query_id", "category", F.col("least.term").alias("term"))
    found = lookup_join(asked.matches.postings, wanted, ["term"], ["id"], asked.bound)
    in_category = F.col("category").isNull() | F.array_contains("categories", F.col("category"))
    pairs = stored_once(found.where(F.coalesce(in_category, F.lit(False))).select(*PAIR), "rarest")
    return score_pairs(asked, pairs, pairs.count()).where("n_matched = n_terms")


def candidate_pairs(asked: Asked, k: int, without: DataFrame | None = None) -> DataFrame:
    """``query_id, id``: the pairs that can be among a request's ``k`` best, ties included.

    The rarest terms are scored first, as many as have ``k`` postings: their k-th best sum is a
    first floor. It splits off the terms that are not looked for; the sums over the others give
    a higher floor. A pair stays if its sum and the largest contributions of the terms left out
    reach it. Postings meet by article for those sums, so nearly all matches are added up where
    they are found. ``without`` names pairs that are not wanted.
    """
    postings = asked.matches.postings.drop("categories")

    def part(postings: DataFrame, terms: DataFrame) -> DataFrame:
        found = lookup_join(postings, terms, ["term"], ["id"], asked.bound)
        sums = found.groupBy(*PAIR).agg(F.sum(contribution()).alias("units"))
        sums = sums if without is None else sums.join(without.select(*PAIR), PAIR, "left_anti")
        return sums.select(*PAIR, (F.col("units") * UNIT).alias("part"))

    def floor_of(sums: DataFrame) -> DataFrame:
        kth = top_k(sums, k, score="part", rank="nth").where(F.col("nth") == k)
        return kth.select("query_id", (F.col("part") - SLACK).alias("floor"))

    rarer = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.sum("df").over(rarer.rowsBetween(Window.unboundedPreceding, -1))
    first = asked.terms.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    smaller = Window.partitionBy("query_id").orderBy("most", "term")
    split = asked.terms.join(floor_of(part(postings, first)), "query_id", "left").withColumn(
        "left_out", F.coalesce(F.sum("most").over(smaller) < F.col("floor"), F.lit(False))
    )
    split = stored_once(split, "split")
    rest = split.groupBy("query_id").agg(F.sum(F.when(F.col("left_out"), F.col("most")).otherwise(0.0)).alias("rest"))
    looked_for = split.where(~F.col("left_out"))
    n_found = looked_for.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    sums = stored_once(part(by_article(postings, n_found), looked_for), "sums")
    reached = sums.join(rest, "query_id").join(floor_of(sums), "query_id", "left")
    return reached.where(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))).select(*PAIR)


def best_matches(asked: Asked, k: int, without: DataFrame | None = None) -> DataFrame:
    """``query_id, id, text, text_rank`` of the ``k`` best articles per request by any term."""
    pairs = stored_once(candidate_pairs(asked, k, without), "pairs")
    scored = score_pairs(asked, pairs, pairs.count()).select(*PAIR, "text")
    return top_k(scored, k, score="text", rank="text_rank")
