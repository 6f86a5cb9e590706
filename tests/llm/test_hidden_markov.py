"""The hidden Markov model against plain loops over words."""

from __future__ import annotations

import itertools
import math
import random
import re
import timeit
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import hidden_markov as hmm

NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Plain:
    """Counts, training and scores of small corpora, one token at a time."""

    def __init__(self, rows):
        self.rows = [(i, held_out(i), words(t)) for i, t in rows]
        train = [w for _, held, w in self.rows if not held]
        self.count, self.ends = Counter(w for text in train for w in text), len(train)
        self.tokens = sum(self.count.values()) + self.ends
        self.mass = self.tokens + 0.5 * (len(self.count) + (self.ends > 0) + 1)
        own = sorted((w for w, n in self.count.items() if n * hmm.OWN >= self.tokens), key=self.hash)
        self.own = {w: 1 + i for i, w in enumerate(own)}
        self.buckets = Counter()
        for w, n in self.count.items():
            if w not in self.own:
                self.buckets[self.hash(w) % hmm.BUCKETS] += n + 0.5
        self.size = 2 + len(own) + hmm.BUCKETS
        share = [self.ends + 0.5, *(self.count[w] + 0.5 for w in own), *(self.buckets[i] for i in range(hmm.BUCKETS)), 0.5]
        self.share = np.array(share) / self.mass
        self.added = self.share * self.mass - np.array([self.ends, *(self.count[w] for w in own), *self.plain_buckets(), 0])

    def plain_buckets(self):
        found = Counter()
        for w, n in self.count.items():
            if w not in self.own:
                found[self.hash(w) % hmm.BUCKETS] += n
        return [found[i] for i in range(hmm.BUCKETS)]

    @staticmethod
    def hash(word):
        return int(hmm.hashes([word])[0])

    def symbol(self, word):
        if word not in self.count:
            return self.size - 1, 0.0
        if word in self.own:
            return self.own[word], 0.0
        bucket = self.hash(word) % hmm.BUCKETS
        return 1 + len(self.own) + bucket, math.log10((self.count[word] + 0.5) / self.buckets[bucket])

    def symbols(self, text):
        return [self.symbol(w)[0] for w in text] + [hmm.END]

    @staticmethod
    def forward(model, symbols):
        steps, at = [], model.start
        for i, s in enumerate(symbols):
            at = (at if not i else at @ model.moves) * model.emits[s]
            steps.append(at)
        return steps

    def train(self, states, iterations):
        model = hmm.first_model(hmm.Vocabulary(self.tokens, self.mass, self.ends, self.share, None, None, None, None, None), states)
        for _ in range(iterations):
            start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((self.size, states))
            for _, held, text in self.rows:
                if held:
                    continue
                symbols = self.symbols(text)
                ahead, back = self.forward(model, symbols), [np.ones(states)]
                for s in reversed(symbols[1:]):
                    back.insert(0, model.moves @ (model.emits[s] * back[0]))
                total = ahead[-1].sum()
                for i, s in enumerate(symbols):
                    emits[s] += ahead[i] * back[i] / total
                    if i:
                        moves += np.outer(ahead[i - 1], model.emits[s] * back[i]) * model.moves / total
                start += ahead[0] * back[0] / total
            for k in range(states):
                total = emits[:, k].sum()
                smoothed = (emits[:, k] + total / self.tokens * self.added) / (total * self.mass / self.tokens)
                emits[:, k] = (1 - hmm.UNIGRAM) * smoothed + hmm.UNIGRAM * self.share
            moves, start = moves + 1 / states, start + 1 / states
            model = hmm.Model(start / start.sum(), moves / moves.sum(1)[:, None], emits / emits.sum(0))
        return model

    def scores(self, states, iterations):
        model, out = self.train(states, iterations), []
        for i, held, text in self.rows:
            hidden = math.log10(self.forward(model, self.symbols(text))[-1].sum())
            known = sum(w in self.count for w in text) + (self.ends > 0)
            base = sum(math.log10((n + 0.5) / self.mass) for n in [self.ends, *(self.count[w] for w in text)])
            within = sum(self.symbol(w)[1] for w in text)
            out.append((i, held, len(text) + 1, known, self.tokens, base, hidden + within))
        return out


def compare(got, want):
    assert got.columns == NAMES
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-9)


def corpus(n, size=12, seed=3):
    rng = random.Random(seed)
    first, second = [f"en{i}" for i in range(30)], [f"De{i}" for i in range(30)]
    return [
        (i, " ".join(rng.choice(first if i % 2 else second) for _ in range(rng.randrange(1, size))) + rng.choice(["", " rare%d" % i]))
        for i in range(n)
    ]


EDGES = [
    (900, None), (901, ""), (902, " \t\n"), (903, "ÀB  ab\x0bAB\r\nab"), (906, None), (907, "unseen words only"), (910, "nbsp\xa0inside"),
    (None, "no id"), (5, "same id"), (5, "same id"), (911, "en1 never-seen en1 never-seen"), (916, "never-seen once more"),
]


@pytest.fixture
def small(monkeypatch):
    """Few symbols, so that the small corpus has words of every kind."""
    monkeypatch.setattr(hmm, "OWN", 60)
    monkeypatch.setattr(hmm, "BUCKETS", 5)
    monkeypatch.setattr(hmm, "KNOWN", 100)


def test_equals_plain_loops(spark, docs, small):
    rows = corpus(60) + EDGES
    got = hmm.score_texts(docs(rows).repartition(3), states=3, iterations=3)
    compare(got, Plain(rows).scores(3, 3))


def test_equals_plain_loops_with_default_sizes(spark, docs):
    rows = corpus(30) + EDGES
    compare(hmm.score_texts(docs(rows), states=2, iterations=2), Plain(rows).scores(2, 2))


def test_buckets_without_training_words(spark, docs, small, monkeypatch):
    monkeypatch.setattr(hmm, "BUCKETS", 4000)
    rows = corpus(40) + EDGES
    compare(hmm.score_texts(docs(rows), states=2, iterations=1), Plain(rows).scores(2, 1))


def test_how_often_a_task_emits_changes_nothing(spark, docs, small, monkeypatch):
    rows = corpus(40) + EDGES
    want = sorted(map(tuple, hmm.score_texts(docs(rows), states=2, iterations=1).collect()), key=str)
    monkeypatch.setattr(hmm, "KEPT_WORDS", 4)
    got = sorted(map(tuple, hmm.score_texts(docs(rows), states=2, iterations=1).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9)


def test_likelihood_sums_over_all_paths(monkeypatch):
    """The scaled recursion over chained stretches gives the sum over every path of states."""
    monkeypatch.setattr(hmm, "STRETCH", 2)
    rng = np.random.default_rng(7)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, size=3), rng.dirichlet([1] * 4, size=3).T)
    texts = [[0], [1, 0], [2, 3, 0], [1, 1, 2, 3, 0], [3, 2, 1, 1, 2, 3, 0]]
    got = hmm.Work(np.array([s for t in texts for s in t]), np.array(list(map(len, texts)))).score(model)
    for text, log in zip(texts, got, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]]
            for i, (state, s) in enumerate(zip(path, text, strict=True)):
                p *= (model.moves[path[i - 1], state] if i else 1) * model.emits[s, state]
            total += p
        assert log == pytest.approx(math.log10(total), rel=1e-12)


def test_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet([1] * 4), rng.dirichlet([1] * 4, size=4), rng.dirichlet([1] * 9, size=4).T)
    sizes = rng.integers(1, 60, size=40)
    symbols = rng.integers(0, 9, size=sizes.sum())
    found = []
    for stretch, rescaled in ((1000, 8), (7, 3), (1, 1), (20, 2)):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        monkeypatch.setattr(hmm, "RESCALED", rescaled)
        work = hmm.Work(symbols, sizes)
        found.append([np.ravel(x) for x in (*work.expected(model), work.score(model))])
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a == pytest.approx(b, rel=1e-9)
    assert found[0][2].sum() == pytest.approx(sizes.sum()) and found[0][1].sum() == pytest.approx(sizes.sum() - 40)


def test_expected_states_of_a_token_sum_to_one(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 300)
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([0.01] * 3, size=3), rng.dirichlet([0.1] * 9, size=3).T + 1e-9)
    lanes = hmm.Work(rng.integers(0, 9, size=900), np.array([300, 1, 299, 300])).first
    emits = model.emits[lanes.symbols]
    seen, scale = lanes.forward(model, emits, np.tile(model.start, (4, 1)), False)
    lanes.backward(model, emits, seen, scale, seen[:0], np.ones((4, 3)), False)
    assert seen.sum(1) == pytest.approx(np.ones(900))


def test_words_are_not_made_one_by_one():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(2_000)) for i in range(60)], pa.large_string())
    index, _, distinct = hmm.words_of(texts)
    assert len(distinct) == len(index) == 120_000
    given = pa.array(distinct, pa.large_string())
    whole, single = (min(timeit.repeat(f, number=1, repeat=3)) for f in (lambda: hmm.words_of(texts), given.to_pylist))
    assert whole < single


def test_runs_of_texts(monkeypatch):
    texts = ["", "a" * 9, None, "ä B", "", "c" * 3, " "] * 3
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(len(texts)))})
    for piece in (1, 4, 1000):
        monkeypatch.setattr(hmm, "PIECE", piece)
        parts = list(hmm.pieces(batch, ["n"]))
        assert [t for p, _ in parts for t in p.to_pylist()] == [t or "" for t in texts]
        assert [n for _, p in parts for n in p.to_pylist()] == list(range(len(texts)))
        index, sizes, distinct = zip(*(hmm.words_of(p) for p, _ in parts), strict=True)
        assert [w for i, d in zip(index, distinct, strict=True) for w in np.array(d, object)[i]] == [w for t in texts for w in words(t)]
    lists = pa.array([[1], [], [2, 3], [4] * 9, [5]], pa.list_(pa.int32()))
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 3)
    assert [(f.tolist(), n.tolist()) for f, n in hmm._batches(lists)] == [([1, 2, 3], [1, 0, 2]), ([4] * 9, [9]), ([5], [1])]


def test_long_text_does_not_underflow(spark, docs):
    rows = [*corpus(20), (21, "en1 en2 De3 " * 70_000)]
    found = {r.doc_id: r for r in hmm.score_texts(docs(rows), states=2, iterations=2).collect()}
    assert found[21].n_tokens == 210_001 and math.isfinite(found[21].score) and found[21].score < -100_000


def test_training_raises_the_likelihood_and_beats_single_words(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = hmm.score_texts(given)
    per_token = scored.where("held_out").agg(
        (F.sum("score") / F.sum("n_tokens")).alias("hmm"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")
    ).first()
    assert per_token.hmm > per_token.base + 0.05


def test_empty_and_without_training(spark, docs):
    assert hmm.score_texts(docs([])).count() == 0
    only = next(i for i in range(100) if held_out(i))
    (row,) = hmm.score_texts(docs([(only, "two words")])).collect()
    assert tuple(row)[:5] == (only, True, 3, 0, 0)
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(3 * math.log10(0.5))
