"""Whole searches: every function answers a table of requests in one job.

A request table has ``query_id, query_text, profile, category``. Query vectors come as
``query_id, embedding`` and stored vectors as ``id, embedding``. Results are
``query_id, rank, id, relevance``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.constants import HITS, RRF_K, SCORE_DIGITS, SEARCH_PROFILES, TARGET_HITS
from paperloom.functions.text import highlight, query_casefold, show_marks, tokens
from paperloom.operators.filters import filter_blank_query
from paperloom.operators.joins import MAX_BROADCAST_ROWS, by_article, lookup_join
from paperloom.operators.nearest import nearest
from paperloom.operators.textindex import Matches, TextIndex, match_terms, weights
from paperloom.operators.textscore import (
    PAIR,
    SLACK,
    Asked,
    best_matches,
    matches_of_all_terms,
    score_matches,
    score_pairs,
)
from paperloom.operators.topk import top_k, topk_hits
from paperloom.session import stored_once

#: Text ranks that fusion looks up first; beyond them a rank adds less than 0.0063.
FUSION_DEPTH = 100


@dataclass(frozen=True)
class Terms:
    """Distinct terms per request (``query_id, category, profile, n_terms, term``), and their
    number."""

    rows: DataFrame
    bound: int


def request_terms(requests: DataFrame) -> Terms:
    """Tokenise the requests, once, and count their terms: that decides what is broadcast."""
    analysed = filter_blank_query(requests).select(
        "query_id",
        "category",
        "profile",
        F.array_distinct(tokens(query_casefold(F.col("query_text"), F.col("profile")))).alias(
            "terms"
        ),
    )
    rows = stored_once(
        analysed.select(
            "query_id",
            "category",
            "profile",
            F.size("terms").alias("n_terms"),
            F.explode_outer("terms").alias("term"),
        ).where(F.col("term").isNotNull()),
        "terms",
    )
    return Terms(rows, rows.count())


def matches_for(index: TextIndex, terms: Terms) -> Matches:
    return match_terms(index, terms.rows.select("term").distinct(), terms.bound)


def match_requests(matches: Matches, terms: Terms) -> DataFrame:
    """A row per (request, article, term) that match, with the article's categories.

    They are many times the postings, so they are counted first: tasks get articles by the rows
    that these make, which need not be spilled to be sorted, nor shuffled to be added up.
    """
    found = matches.postings.groupBy("term").agg(F.count("*").alias("df"))
    n_rows = terms.rows.join(found, "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    postings = by_article(matches.postings, n_rows)
    return lookup_join(postings, terms.rows, ["term"], ["id"], terms.bound)


def ask(index: TextIndex, terms: Terms) -> Asked:
    """Read the postings of the requested terms, once, and weigh the terms."""
    matches = matches_for(index, terms)
    weighted = stored_once(terms.rows.join(weights(matches), "term"), "weighted")
    cost = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return Asked(matches, weighted, terms.bound, cost)


def score_text(index: TextIndex, terms: Terms) -> DataFrame:
    """BM25 of every article that holds any term: ``query_id, id, text, n_matched, n_terms``."""
    return score_matches(ask(index, terms))


def search_bm25(
    index: TextIndex, requests: DataFrame, hits: int = HITS, asked: Asked | None = None
) -> DataFrame:
    """Articles that hold all terms of the request, in its category if it names one."""
    asked = asked or ask(index, request_terms(requests))
    complete = matches_of_all_terms(asked)
    return _ranked(topk_hits(complete.withColumnRenamed("text", "relevance"), hits))


def search_semantic(
    vectors: DataFrame,
    query_vectors: DataFrame,
    hits: int = HITS,
    target_hits: int = TARGET_HITS,
    near: DataFrame | None = None,
) -> DataFrame:
    """The nearest articles; no category filter.

    Candidates and hits have the same order here, so only ``hits`` of the ``target_hits``
    candidates are ever looked for.
    """
    if near is None:
        near = nearest(vectors, query_vectors, min(hits, target_hits))
    found = near.where(F.col("near_rank") <= hits)
    return _ranked(found.withColumnsRenamed({"cosine": "relevance", "near_rank": "rank"}))


def merge_candidates(text: DataFrame, near: DataFrame) -> DataFrame:
    """Union of text and vector candidates: a missing score is 0, a missing rank is null."""
    merged = text.join(near, PAIR, "full_outer")
    return merged.withColumns(
        {"text": F.coalesce("text", F.lit(0.0)), "cosine": F.coalesce("cosine", F.lit(0.0))}
    )


def search_hybrid(
    index: TextIndex,
    vectors: DataFrame,
    requests: DataFrame,
    query_vectors: DataFrame,
    hits: int = HITS,
    target_hits: int = TARGET_HITS,
    asked: Asked | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Articles with any term, or among the nearest, by the sum of both scores.

    An article that is not among the nearest has no vector score, so of those only the best
    ``hits`` by text can win. Those among the nearest are all scored. That is exact, and
    ``hits + target_hits`` rows per request, where the matches grow with the collection.
    """
    asked = asked or ask(index, request_terms(requests))
    near = _candidates(vectors, query_vectors, target_hits) if near is None else near
    if asked.is_small:
        text = text_candidates(score_matches(asked), near, hits, target_hits)
    else:
        text = score_pairs(asked, near, near.count()).select(*PAIR, "text")
        text = text.unionByName(best_matches(asked, hits, near).select(*PAIR, "text"))
    blended = merge_candidates(text, near).withColumn(
        "relevance", F.col("text") + F.col("cosine")
    )
    return _ranked(topk_hits(blended, hits))


def search_fusion(
    index: TextIndex,
    vectors: DataFrame,
    requests: DataFrame,
    query_vectors: DataFrame,
    hits: int = HITS,
    target_hits: int = TARGET_HITS,
    asked: Asked | None = None,
    near: DataFrame | None = None,
    depth: int = FUSION_DEPTH,
) -> DataFrame:
    """The same candidates, by reciprocal rank fusion of their two ranks.

    If all matches are few they are scored and stored once, and the ranks are counted there.
    Else the best ``depth`` by text are ranked without scoring every match. An article that is near
    and matches, but is not among them, has a rank beyond ``depth``, which bounds its relevance
    from both sides. Matches are counted for the few whose bound reaches the last hit, if any.
    """
    asked = asked or ask(index, request_terms(requests))
    near = _candidates(vectors, query_vectors, target_hits) if near is None else near
    if asked.is_small:
        scored = stored_once(score_matches(asked).select(*PAIR, "text"), "scored")
        text = stored_once(text_candidates(scored, near, hits, target_hits), "candidates")
        placed = text_ranks(scored, text, asked.bound, hits + target_hits)
        fused = merge_candidates(placed, near).withColumn(
            "relevance", _reciprocal(F.col("text_rank")) + _reciprocal(F.col("near_rank"))
        )
        return _ranked(topk_hits(fused, hits))
    depth = max(depth, hits)
    top = stored_once(best_matches(asked, depth), "top")
    text = score_pairs(asked, near, near.count()).select(*PAIR, "text")
    beyond = text.join(top.select(*PAIR), PAIR, "left_anti")
    known = merge_candidates(top, near).join(
        beyond.withColumnRenamed("text", "beyond"), PAIR, "left"
    )
    by_near = _reciprocal(F.col("near_rank"))
    least = _reciprocal(F.col("text_rank")) + by_near
    most = least + F.when(F.col("beyond").isNotNull(), 1.0 / (RRF_K + depth + 1)).otherwise(0.0)
    known = stored_once(known.withColumns({"relevance": least, "most": most}), "fused")
    last = top_k(known, hits, rank="nth").where(F.col("nth") == hits)
    last = last.select("query_id", (F.col("relevance") - SLACK).alias("last"))
    reached = known.join(last, "query_id", "left").where(
        F.col("last").isNull() | (F.col("most") >= F.col("last"))
    )
    settled = reached.where(F.col("beyond").isNull()).select(*PAIR, "relevance")
    unknown = stored_once(
        reached.where(F.col("beyond").isNotNull()).select(
            *PAIR, F.col("beyond").alias("text"), "near_rank"
        ),
        "unranked",
    )
    if unknown.isEmpty():
        return _ranked(topk_hits(settled, hits))
    open_terms = asked.terms.join(unknown.select("query_id"), "query_id", "left_semi")
    scored = score_matches(replace(asked, terms=open_terms)).select(*PAIR, "text")
    placed = text_ranks(scored, unknown, asked.bound, target_hits)
    fused = placed.join(unknown.drop("text"), PAIR).withColumn(
        "relevance", _reciprocal(F.col("text_rank")) + by_near
    )
    return _ranked(topk_hits(settled.unionByName(fused.select(*PAIR, "relevance")), hits))


def text_candidates(
    scored: DataFrame, near: DataFrame, hits: int, target_hits: int
) -> DataFrame:
    """Of all text matches, those among the nearest and the best ``hits`` of the others.

    ``near`` is a stored table, so it is counted before it is broadcast; if it is too large,
    both sides shuffle on the pair, which has no hot keys.
    """
    known = near.select(*PAIR, F.lit(True).alias("is_near"))
    if near.count() <= MAX_BROADCAST_ROWS:
        known = F.broadcast(known)
    flagged = scored.join(known, PAIR, "left").withColumn(
        "is_near", F.coalesce("is_near", F.lit(False))
    )
    best = top_k(
        flagged, max(hits, target_hits), score="text", rank="nth", per=("query_id", "is_near")
    )
    return best.where(F.col("is_near") | (F.col("nth") <= hits)).select(*PAIR, "text")


def text_ranks(
    scored: DataFrame, wanted: DataFrame, n_requests: int, per_request: int
) -> DataFrame:
    """Add each wanted row's rank among *all* text matches of its request.

    Ordering all matches of a request in one task would not scale. Instead every match is
    placed between the wanted rows of its request by binary search, matches are counted
    per gap with partial sums, and the counts are added up over the few gaps. Matches behind
    the last wanted row, mostly nearly all, are not placed.
    """
    key = F.struct((-F.col("text")).alias("worse"), F.col("id"))
    ladders = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(key)).alias("ladder"))
    gap = _upper_bound(F.col("ladder"), key, per_request)
    counted = (
        lookup_join(
            scored, ladders, ["query_id"], ["id"], n_requests, MAX_BROADCAST_ROWS // per_request
        )
        .where(key <= F.element_at("ladder", -1))
        .select("query_id", gap.alias("gap"))
        .groupBy("query_id", "gap")
        .agg(F.count("*").alias("n"))
    )
    so_far = Window.partitionBy("query_id").orderBy("gap")
    above = counted.select("query_id", "gap", F.sum("n").over(so_far).alias("n_above"))
    steps = ladders.select("query_id", F.posexplode("ladder").alias("gap", "step"))
    return steps.join(above, ["query_id", "gap"], "left").select(
        "query_id",
        F.col("step.id").alias("id"),
        (-F.col("step.worse")).alias("text"),
        (F.coalesce("n_above", F.lit(0)) + 1).alias("text_rank"),
    )


def search_dispatch(
    index: TextIndex,
    vectors: DataFrame,
    requests: DataFrame,
    query_vectors: DataFrame,
    hits: int = HITS,
    target_hits: int = TARGET_HITS,
) -> DataFrame:
    """Answer each request by its own profile; no profile means bm25, a wrong one fails.

    Profiles without requests add nothing to the plan. All text profiles share one pass over
    the articles, and all vector profiles one pass over the vectors.
    """
    asked = filter_blank_query(requests).withColumn(
        "profile", F.coalesce("profile", F.lit(SEARCH_PROFILES[0]))
    )
    counts = asked.agg(
        *[F.count_if(F.col("profile") == p).alias(p) for p in SEARCH_PROFILES],
        F.count_if(~F.col("profile").isin(*SEARCH_PROFILES)).alias("unknown"),
    ).first()
    if counts["unknown"]:
        raise ValueError(f"{counts['unknown']} requests have an unknown profile")

    def of(*profiles: str) -> DataFrame:
        return asked.where(F.col("profile").isin(*profiles))

    def near_of(*profiles: str) -> DataFrame:
        return near.join(of(*profiles).select("query_id"), "query_id", "left_semi")

    blends = [p for p in ("hybrid", "fusion") if counts[p]]
    by_text = [p for p in ("bm25", *blends) if counts[p]]
    by_vector = [p for p in ("semantic", *blends) if counts[p]]
    text = near = None
    if by_text:
        text = ask(index, request_terms(of(*by_text)))
    if by_vector:
        searched = query_vectors.join(of(*by_vector).select("query_id"), "query_id", "left_semi")
        near = _candidates(vectors, searched, target_hits if blends else min(hits, target_hits))

    def answer(profile: str) -> DataFrame:
        if profile == "semantic":
            return search_semantic(vectors, query_vectors, hits, target_hits, near_of(profile))
        if profile == "bm25":
            return search_bm25(index, of(profile), hits, text.of(profile))
        blend = {"hybrid": search_hybrid, "fusion": search_fusion}[profile]
        return blend(
            index,
            vectors,
            of(profile),
            query_vectors,
            hits,
            target_hits,
            text.of(profile),
            near_of(profile),
        )

    answers = [answer(p).withColumn("profile", F.lit(p)) for p in SEARCH_PROFILES if counts[p]]
    if not answers:
        raise ValueError("there are no requests to answer")
    return reduce(DataFrame.unionByName, answers)


def hydrate_hits(hits: DataFrame, articles: DataFrame, n_hits: int | None = None) -> DataFrame:
    """All article fields for each hit.

    ``n_hits`` is a proven bound on the hits; with one, the hits are broadcast and the
    articles are read in place.
    """
    small = n_hits is not None and n_hits <= MAX_BROADCAST_ROWS
    return articles.join(F.broadcast(hits) if small else hits, "id")


def highlight_matches(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Mark the request's terms in the title and abstract of its hydrated hits."""
    terms = requests.select("query_id", tokens(F.col("query_text")).alias("_terms"))
    marked = {c: highlight(F.col(c), F.col("_terms")) for c in ("title", "abstract")}
    return found.join(terms, "query_id").withColumns(marked).drop("_terms")


def result_cards(found: DataFrame) -> DataFrame:
    """What the result page shows of each hydrated hit."""
    title = F.concat(
        F.lit("[**"),
        show_marks(F.col("title"), "*"),
        F.lit("**](https://arxiv.org/abs/"),
        F.col("id"),
        F.lit(")"),
    )
    return found.select(
        "query_id",
        "rank",
        "id",
        title.alias("title"),
        F.format_string("Relevance: %10f", "relevance").alias("relevance"),
        F.array_join("categories", " ").alias("categories"),
        "update_date",
        show_marks(F.col("abstract"), "**").alias("abstract"),
    )


def _ranked(top: DataFrame) -> DataFrame:
    return top.select("query_id", "rank", "id", "relevance")


def _reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + rank), F.lit(0.0))


def _candidates(vectors: DataFrame, query_vectors: DataFrame, target_hits: int) -> DataFrame:
    """At most ``target_hits`` rows per request, stored because a blend uses them twice and
    comparing all vectors is the dear part."""
    return stored_once(nearest(vectors, query_vectors, target_hits), "near")


def _upper_bound(ladder: Column, key: Column, max_size: int) -> Column:
    """How many of the sorted ``ladder`` come before ``key`` or equal it.

    Halving steps: take each if the entry it leads to is still not after the key. A step
    past the end finds null and is not taken.
    """
    steps = [F.lit(1 << i) for i in reversed(range(max_size.bit_length()))]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, step: F.when(F.get(ladder, at + step - 1) <= key, at + step).otherwise(at),
    )
