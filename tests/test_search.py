from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from support import plan_of, rows
from pyspark.sql import functions as F

from paperloom.operators import joins, textindex, textscore, topk
from paperloom.plans import search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def tokens(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


@pytest.fixture(scope="module")
def corpus(spark):
    """300 articles, a third of them copies, with vectors for most of them."""
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(WORDS, size=random.integers(1, 30))) for _ in range(200)]
    texts += [texts[0]] * 100
    data = [
        (f"a{i:04d}", text.split()[0], text, ["en", "x"] if i % 2 else ["de"])
        for i, text in enumerate(texts)
    ]
    vectors = [(i, random.normal(size=6).astype("float32").tolist()) for i, *_ in data[:250]]
    requests = [
        (1, "Alpha beta", "bm25", None),
        (2, "gamma", "bm25", "en"),
        (3, "delta DELTA epsilon", "hybrid", "en"),
        (4, "zeta eta nowhere", "fusion", None),
        (5, "kappa", "semantic", None),
        (6, "", "bm25", None),
        (7, "nowhere", None, None),
        (8, "theta iota", "fusion", None),
    ]
    asked = [(r[0], random.normal(size=6).astype("float32").tolist()) for r in requests]
    return {
        "articles": spark.createDataFrame(
            data, "id string, title string, abstract string, categories array<string>"
        ).repartition(5),
        "vectors": spark.createDataFrame(vectors, "id string, embedding array<float>").repartition(3),
        "requests": spark.createDataFrame(
            requests, "query_id long, query_text string, profile string, category string"
        ),
        "query_vectors": spark.createDataFrame(asked, "query_id long, embedding array<float>"),
        "data": data,
        "vector_data": vectors,
        "request_data": requests,
        "asked_data": dict(asked),
    }


def text_scores(corpus):
    """BM25 of all matches, straight from its definition."""
    counts = {i: Counter(tokens(f"{title} {text}")) for i, title, text, _ in corpus["data"]}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    scores = {}
    for query_id, text, *_ in corpus["request_data"]:
        terms = set(tokens(text))
        df = {t: sum(t in c for c in counts.values()) for t in terms}
        for i, c in counts.items():
            found = [t for t in terms if t in c]
            if found:
                total = 0.0
                for t in found:
                    idf = math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5))
                    dl = sum(c.values())
                    total += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / mean))
                scores[query_id, i] = (round(total, 6), len(found) == len(terms))
    return scores


def cosines(corpus, target_hits):
    best = {}
    for query_id, b in corpus["asked_data"].items():
        scored = [
            (round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6), i)
            for i, a in corpus["vector_data"]
        ]
        scored.sort(key=lambda s: (-s[0], s[1]))
        best[query_id] = dict((i, s) for s, i in scored[:target_hits])
    return best


def expected(corpus, profile, query_id, hits, target_hits):
    category = {r[0]: r[3] for r in corpus["request_data"]}[query_id]
    categories = {i: c for i, _, _, c in corpus["data"]}
    text = {i: s for (q, i), s in text_scores(corpus).items() if q == query_id}
    near = cosines(corpus, target_hits)[query_id]
    if profile == "bm25":
        scored = {
            i: s for i, (s, full) in text.items() if full and (not category or category in categories[i])
        }
    elif profile == "semantic":
        scored = near
    elif profile == "hybrid":
        scored = {i: text.get(i, (0,))[0] + near.get(i, 0) for i in {*text, *near}}
    else:
        by_text = sorted(text, key=lambda i: (-text[i][0], i))
        by_near = sorted(near, key=lambda i: (-near[i], i))
        scored = Counter()
        for order in (by_text, by_near):
            for n, i in enumerate(order):
                scored[i] += 1 / (61 + n)
    rounded = {i: round(s, 6) for i, s in scored.items()}
    best = sorted(rounded, key=lambda i: (-rounded[i], i))[:hits]
    return [(query_id, n + 1, i, rounded[i]) for n, i in enumerate(best)]


def same(found, wanted):
    mine = sorted(tuple(r) for r in found.select("query_id", "rank", "id", "relevance").collect())
    assert [m[:3] for m in mine] == [w[:3] for w in sorted(wanted)]
    assert np.allclose([m[3] for m in mine], [w[3] for w in sorted(wanted)], atol=3e-6)


@pytest.fixture(params=["broadcast", "shuffled"])
def join_mode(request, monkeypatch):
    """The second mode pretends that every lookup table is too large to broadcast."""
    if request.param == "shuffled":
        for module in (joins, search, textindex):
            monkeypatch.setattr(module, "MAX_BROADCAST_ROWS", 0)
        monkeypatch.setattr(joins.lookup_join, "__defaults__", (0,))
    return request.param


@pytest.fixture(params=["all scored", "pruned"])
def score_mode(request, monkeypatch):
    if request.param == "pruned":
        monkeypatch.setattr(textscore, "ALL_MATCHES", 0)


@pytest.mark.parametrize("hits,target_hits", [(10, 1000), (3, 20)])
def test_profiles(spark, corpus, join_mode, score_mode, hits, target_hits):
    answered = search.search_dispatch(
        textindex.index_articles(corpus["articles"]),
        corpus["vectors"],
        corpus["requests"],
        corpus["query_vectors"],
        hits,
        target_hits,
    )
    wanted = []
    for query_id, text, profile, _ in corpus["request_data"]:
        if text:
            wanted += expected(corpus, profile or "bm25", query_id, hits, target_hits)
    same(answered, wanted)


def test_text_ranks_are_exact(spark, corpus, join_mode):
    scores = {k: s for k, (s, _) in text_scores(corpus).items()}
    scored = spark.createDataFrame(
        [(q, i, s) for (q, i), s in scores.items()], "query_id long, id string, text double"
    )
    wanted = scored.where("hash(id, query_id) % 3 = 0")
    ranked = search.text_ranks(scored, wanted, 10, 300)
    for query_id, i, _, rank in ranked.collect():
        mine = scores[query_id, i]
        above = [1 for (q, j), s in scores.items() if q == query_id and (-s, j) < (-mine, i)]
        assert rank == 1 + len(above)
    assert ranked.count() == wanted.count()


def test_stored_index_gives_the_same_answers(spark, corpus, tmp_path):
    fresh = textindex.index_articles(corpus["articles"])
    path = str(tmp_path / "index")
    textindex.save_index(fresh, path)
    stored = textindex.load_index(spark, path)
    answers = [search.search_bm25(i, corpus["requests"]) for i in (fresh, stored)]
    assert rows(answers[0]) == rows(answers[1]) != []
    assert rows(textindex.term_stats(fresh)) == rows(textindex.term_stats(stored))
    wanted = spark.createDataFrame([("alpha",)], "term string")
    bucketed = wanted.withColumn("bucket", textindex.term_bucket(F.col("term")))
    looked_up = joins.lookup_join(stored.postings, bucketed.where("term = 'alpha'"), ["bucket", "term"], ["id"], 1)
    assert "dynamicpruning" in plan_of(looked_up).lower()


def test_plan_of_keyword_search(spark, corpus):
    """Sums are partial before they shuffle, and each top-k step cuts before it sends."""
    plan = plan_of(search.search_bm25(textindex.index_articles(corpus["articles"]), corpus["requests"]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 4
    assert plan.count("Exchange hashpartitioning(query_id") == 3


def test_term_counts(spark, corpus):
    index = textindex.index_articles(corpus["articles"])
    postings = textindex.all_postings(index)
    assert plan_of(textindex.term_stats(index)).count("Exchange hash") == 1
    sums = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
    assert rows(textindex.term_stats(index)) == rows(sums)
    counted = {(r.id, r.term): (r.tf, r.dl) for r in postings.collect()}
    wanted = {}
    for i, title, text, _ in corpus["data"]:
        found = tokens(f"{title} {text}")
        wanted.update({(i, t): (n, len(found)) for t, n in Counter(found).items()})
    assert counted == wanted


@pytest.fixture(scope="module")
def long_tail(spark):
    """4,000 articles of common words, and a few that also hold rare ones."""
    random = np.random.default_rng(8)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    data = []
    for n in range(4000):
        text = random.choice(common, size=20).tolist() + random.choice(rare, size=n % 3).tolist()
        data.append((f"a{n:05d}", text[0], " ".join(text[1:]), ["x"]))
    requests = [
        (q, " ".join([*common, *random.choice(rare, size=4)]), "hybrid", None) for q in range(15)
    ] + [(90, "c0 c1", "hybrid", None), (91, "r1 absent", "hybrid", None), (92, "absent", "hybrid", None)]
    articles = spark.createDataFrame(data, "id string, title string, abstract string, categories array<string>")
    asked = spark.createDataFrame(requests, "query_id long, query_text string, profile string, category string")
    index = textindex.index_articles(articles.repartition(6))
    return search.ask(index, search.request_terms(asked))


@pytest.mark.parametrize("k", [1, 10, 200])
def test_pruned_matches_are_the_best(spark, long_tail, k):
    everything = textscore.score_matches(long_tail).select("query_id", "id", "text")
    best = topk.top_k(everything, k, score="text", rank="text_rank")
    assert rows(textscore.best_matches(long_tail, k)) == rows(best)
    some = everything.where("hash(id) % 5 = 0")
    best = topk.top_k(everything.where("hash(id) % 5 <> 0"), k, score="text", rank="text_rank")
    assert rows(textscore.best_matches(long_tail, k, some)) == rows(best)


def test_few_pairs_are_scored(spark, long_tail):
    """Nearly every article holds a common word of every request; few of the pairs are scored."""
    n_all = textscore.score_matches(long_tail).count()
    assert n_all > 60_000
    pairs = textscore.candidate_pairs(long_tail, 10).where("query_id < 90")
    assert pairs.count() < 15 * 60


@pytest.mark.parametrize("depth", [1, 7, 100])
def test_fusion_looks_deep_ranks_up(spark, corpus, depth, monkeypatch):
    """Whatever the depth, articles beyond it get their exact rank if it matters."""
    monkeypatch.setattr(textscore, "ALL_MATCHES", 0)
    index = textindex.index_articles(corpus["articles"])
    requests = corpus["requests"].where("query_text <> ''")
    vectors = corpus["query_vectors"].where("query_id <> 6")
    found = search.search_fusion(index, corpus["vectors"], requests, vectors, 3, 20, depth=depth)
    asked = [r[0] for r in corpus["request_data"] if r[1]]
    same(found, [row for q in asked for row in expected(corpus, "fusion", q, 3, 20)])


def test_unknown_profile_fails(spark, corpus):
    bad = corpus["requests"].withColumn("profile", F.lit("magic"))
    with pytest.raises(ValueError, match="unknown profile"):
        search.search_dispatch(
            textindex.index_articles(corpus["articles"]), corpus["vectors"], bad, corpus["query_vectors"]
        )


def test_fusion_adds_up_and_counts_matches_where_they_are(spark, long_tail, monkeypatch):
    """Sums of candidates shuffle postings only, and ranks place only what can precede a row."""
    plans = {}

    def spy(df, label):
        plans[label] = plan_of(df)
        return df

    with monkeypatch.context() as patched:
        patched.setattr(textscore, "stored_once", spy)
        patched.setattr(joins, "ROWS_PER_TASK", 20)
        textscore.candidate_pairs(long_tail, 10)
    assert plans["sums"].count("Exchange hashpartitioning(id#") == 1
    assert "Exchange hashpartitioning(query_id#" not in plans["sums"].split("BroadcastExchange")[0]
    scored = textscore.score_matches(long_tail).select("query_id", "id", "text")
    best = topk.top_k(scored, 7, score="text", rank="text_rank").where("text_rank in (2, 7)")
    ranked = search.text_ranks(scored, best.select("query_id", "id", "text"), 20, 2)
    assert "element_at(ladder" in plan_of(ranked)
    names = ("query_id", "id", "text_rank")
    assert rows(ranked.select(*names)) == rows(best.select(*names))


def test_matched_rows_meet_by_article_in_counted_tasks(spark, corpus, monkeypatch):
    index = textindex.index_articles(corpus["articles"])
    terms = search.request_terms(corpus["requests"])
    matches = search.matches_for(index, terms)
    whole = rows(search.match_requests(matches, terms))
    asked = search.ask(index, terms)
    scores = rows(textscore.score_matches(asked))
    assert asked.cost == len(whole) > 500
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 50)
    n_tasks = math.ceil(len(whole) / 50)
    matched = search.match_requests(matches, terms)
    grouped = matched.groupBy("query_id", "id").agg(F.sum("tf").alias("tf"))
    assert plan_of(grouped).count("Exchange hashpartitioning") == 1  # of postings, not of matches
    scored = textscore.score_matches(asked)
    for parts in (matched, grouped, scored):
        assert parts.rdd.getNumPartitions() == n_tasks
    assert (rows(matched), rows(scored)) == (whole, scores)


def test_merge_candidates(spark):
    text = spark.createDataFrame([(1, "a", 2.0, 1)], "query_id long, id string, text double, text_rank int")
    near = spark.createDataFrame(
        [(1, "a", 0.5, 2), (1, "b", 0.9, 1)], "query_id long, id string, cosine double, near_rank int"
    )
    assert rows(search.merge_candidates(text, near)) == [
        (1, "a", 2.0, 1, 0.5, 2),
        (1, "b", 0.0, None, 0.9, 1),
    ]


def test_cards(spark):
    found = spark.createDataFrame(
        [(1, 1, "2401.1v1", 0.25, "Sparse codes", "about SPARSE", ["a", "b"], "2024-01-01T00:00:00")],
        "query_id long, rank int, id string, relevance double, title string, abstract string, "
        "categories array<string>, update_date string",
    )
    requests = spark.createDataFrame([(1, "sparse")], "query_id long, query_text string")
    card = search.result_cards(search.highlight_matches(found, requests)).first()
    assert card.title == "[***Sparse* codes**](https://arxiv.org/abs/2401.1v1)"
    assert card.abstract == "about **SPARSE**"
    assert card.relevance == "Relevance:   0.250000" and card.categories == "a b"


def test_salted_lookup_equals_broadcast(spark):
    """One key holds most rows of the large side."""
    large = spark.range(2000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k long, v string")
    salted = joins.lookup_join(large, small, ["k"], ["id"], 3, max_broadcast_rows=2)
    assert rows(salted.select("k", "id", "v")) == rows(large.join(small, "k").select("k", "id", "v"))
    assert "_salt" in plan_of(salted)
