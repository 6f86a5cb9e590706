"""Operators on whole corpora against brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import decontam, jaccard, multi_index
from paperloom.llm.components import connected_components
from paperloom.llm.decontam import leaks, without_leaks
from paperloom.llm.jaccard import jaccard_components, without_copies
from paperloom.llm.mixing import MOST, WEIGHTS, mix_sources, mixed_documents
from paperloom.llm.multi_index import cells_in_order, nearest_by_index
from paperloom.llm.toxicity import _toxic_wording, toxicity, windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components_by_force(rows, words, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").lower())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    links = [
        (i, j)
        for j in range(len(rows))
        for i in range(j)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    top = roots(len(rows), links)
    low = defaultdict(list)
    for (i, _), t in zip(rows, top, strict=True):
        if i is not None:
            low[t].append(i)
    return [(i, len(s), min(low[t]) if low[t] else None) for (i, _), s, t in zip(rows, sets, top, strict=True)]


def copies(seed, groups, members):
    """Texts with near copies around the threshold, chains of copies, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(50)]
    texts = ["", None, " \n ", "One", "one", "a b c", "A b C", "x y z w"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, members)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            if rng.random() < 0.3:
                copy = passage + copy[: rng.randint(3, 30)]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(100 + i if i % 17 else None, t) for i, t in enumerate(texts)] + [(102, texts[2]), (102, texts[2]), (7, texts[5])]


@pytest.mark.parametrize(("small", "share"), [(False, 0.25), (True, 9), (True, 0)])
def test_jaccard_components(docs, monkeypatch, small, share):
    monkeypatch.setattr(jaccard, "CLUB_SHARE", share)  # 9: clubs find next to nothing, 0: all they meet
    if small:  # every way of joining on a few rows
        ways = (("BLOCK", 4), ("TINY", 2), ("PER_PIVOT", 3), ("ROUNDS", 2), ("FREQUENT", 4), ("COLUMNS", 7))
        for name, value in ways:
            monkeypatch.setattr(jaccard, name, value)
    rows = copies(1, 12, 9)
    got = sorted(map(str, (tuple(r) for r in jaccard_components(docs(rows), 4, 85).drop("copy", "group").collect())))
    assert got == sorted(map(str, components_by_force(rows, 4, 85)))


def test_a_pair_of_sets_is_worked_on_in_one_region():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in (0, 10, 20, 130, 390)]
    regions = [[1, 5, 9], [1, 5, 9], [5, 9], [1, 5, 9], [1, 5, 9]]  # of each set
    asked = []
    for region in (1, 5, 9):
        inside = [i for i, own in enumerate(regions) if region in own]
        rows = pd.DataFrame(
            {
                "origin": region,
                "n": [len(sets[i]) for i in inside],
                "club": inside,
                "d": np.nan,
                "own": [regions[i] for i in inside],
                "sketch": [jaccard.sketch(sets[i]) for i in inside],
            }
        )
        asked += [(inside[i], inside[j]) for _, i, j, _ in jaccard.open_pairs(rows, 85, False)]
    # once each, and none that is far apart
    assert sorted(asked) == [(0, 1), (0, 2), (1, 2)]


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**20, n).astype(np.uint64) << np.uint64(rng.integers(0, 44))) for n in rng.integers(1, 90_000, 40)]
    rows = np.stack([np.frombuffer(jaccard.sketch(x), dtype=np.uint8) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    least = jaccard.unlike(rows, i, j)
    assert (least <= [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)]).all() and least.max() > 1000


@pytest.mark.parametrize("marks", [64, 1 << 12])
def test_regions_that_pivots_do_not_part_are_not_tried_again(docs, monkeypatch, marks):
    """Texts around one passage: a round of pivots takes out nothing but the pivots."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(20)]) for _ in range(30)]
    rows = list(enumerate(texts + [texts[3] + " end", texts[9] + " end"]))
    tried = []
    bounds = jaccard._seed_bounds
    monkeypatch.setattr(jaccard, "_seed_bounds", lambda *a: tried.append(1) or bounds(*a))
    for name, value in (("BLOCK", 8), ("MARKS", marks), ("CLUB_SHARE", 9)):
        monkeypatch.setattr(jaccard, name, value)
    got = sorted(map(str, (tuple(r) for r in jaccard_components(docs(rows), 4, 85).drop("copy", "group").collect())))
    assert got == sorted(map(str, components_by_force(rows, 4, 85)))
    assert len(tried) == 1


def test_coarse_sketches_leave_out_no_pair_that_sketches_allow():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in range(0, 600, 6)]
    rows = np.stack([np.frombuffer(jaccard.sketch(x), dtype=np.uint8) for x in sets])
    sizes = np.array(list(map(len, sets)))
    pairs = np.argwhere(np.triu(np.ones((len(sets),) * 2, dtype=bool), 1))
    i, j = pairs.T
    fine = 185 * jaccard.unlike(rows, i, j) <= 15 * (sizes[i] + sizes[j])
    assert jaccard.near_pairs(sizes, rows, pairs, 85).tolist() == pairs[fine].tolist()
    assert 0 < fine.sum() < len(fine)


def test_a_pair_of_a_large_region_is_worked_on_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sizes = [20 + k % 30 for k in range(60)]
    regions = spark.createDataFrame([(5, k, n, k) for k, n in enumerate(sizes)], "region long, node long, n long, club long")
    met = Counter()
    for _, rows in jaccard._by_blocks(regions, 85).toPandas().groupby("region"):
        rows = rows.drop_duplicates("node").sort_values("node")
        for a, b in itertools.combinations(zip(rows["node"], rows["sides"]), 2):
            met[a[0], b[0]] += not a[1] & b[1]
    fit = [(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])]
    assert {met[pair] for pair in fit} == {1}


def test_empty_tables(spark, docs):
    none = docs([(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert jaccard_components(none, 4, 85).count() == 0
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0
    assert toxicity(none, labels).count() == 0
    assert leaks(none, items).count() == 0 and leaks(docs([(1, "x")]), items).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nearest_by_index(vectors, 20, 20).count() == 0


def test_one_copy_stays(docs):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, ""), (3, ""), (4, None), (5, "q w e r t"), (5, "q w e r t"), (5, "other words here now ok")]
    kept = without_copies(docs(rows), 5, 80)
    assert kept.columns == docs(rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, rows[0][1]), (3, ""), (3, ""), (4, None), (5, rows[6][1]), (5, rows[8][1])])


def test_components_of_chains(spark):
    rng = random.Random(1)
    order = rng.sample(range(1000), 300)
    links = [(order[i], order[i + 1]) for i in range(299) if i % 50] + [(5000, k) for k in range(6000, 6100)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint")).collect()}
    nodes = sorted({n for link in links for n in link})
    place = {n: i for i, n in enumerate(nodes)}
    top = roots(len(nodes), [(place[a], place[b]) for a, b in links])
    assert got == {n: nodes[top[place[n]]] for n in nodes}


def test_mix(docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "é", "Z", None])) for i in range(600)]
    rows += [(900 + i, "big " * 400, "small") for i in range(2)] + [(1000, None, "none"), (1001, "x", "a")]
    got = mix_sources(docs(rows)).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_names, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_names)
        full = {s for s in open_names if MOST * sums[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = float(MOST * sums[s])
            left -= target[s]
        open_names -= full
    target.update({s: level * weight[s] for s in open_names})
    taken = Counter()
    for r in got:
        assert (r.size, r.source, r.source_size) == (size[r.doc_id], source[r.doc_id], sums[source[r.doc_id]])
        assert abs(r.target - target[r.source]) < 1e-6
        assert r.size == 0 and r.taken == 0 or r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = Counter()
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs(rows)).collect()), key=str)
    often = Counter(r.doc_id for r in mixed_documents(docs(rows)).collect())
    assert all(often[r.doc_id] == r.taken // r.size for r in got if r.size)


def test_leaks(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    common = [word() for _ in range(30)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n))
    items = [(i, text(rng.randint(15, 60)).capitalize() + ".") for i in range(40)] + [(99, ""), (98, None), (97, "Two words")]
    rows, expected = [], set()
    for i, (_, t) in enumerate(items[:40]):
        for kind in range(4):
            doc = 10 * i + kind
            words = t.lower().rstrip(".").split()
            if kind == 1:  # a paraphrase: some words dropped, some added, the end as it was
                cut = len(words) * 2 // 3
                words = [w for k, w in enumerate(words[:cut]) if k % 6] + ["also"] + words[cut:]
            if kind == 2:  # a short quotation is no leak
                words = words[: len(words) // 4]
            if kind < 2:
                expected.add((doc, i))
            words = words if kind < 3 else []
            rows.append((doc, f"{text(rng.randint(0, 150))} {', '.join(words)}! {text(rng.randint(0, 150))}"))
    rows += [(5000, "these Two words: yes"), (5001, "two other words"), (5002, ""), (5003, None), (None, items[0][1])]
    expected |= {(5000, 97), (None, 0)}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs(rows), bench).collect()} == expected
    kept = without_leaks(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_leaks_without_telling_words(spark, docs):
    rng = random.Random(8)
    common = [f"common{i}" for i in range(60)]
    rare, middle = [f"rare{i}" for i in range(12)], [f"middle{i}" for i in range(20)]
    often = " ".join("zorblat" if i % 5 == 0 else f"plain{i % 3}" for i in range(30)) + "."
    item = " ".join([*(w for pair in zip(rare, middle) for w in pair), "end.", *middle[12:]])
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(40)] + [f"plain{k}" for k in range(3) if (i + k) % 4 == 0]
        words += [w for k, w in enumerate(rare) if i % 66 == k] + [w for k, w in enumerate(middle) if i % 13 == k % 13]
        words += ["zorblat"] * (i % 50 == 0)
        rows.append((i, " ".join(rng.sample(words, len(words)))))
    reworded = item
    for w in rare:  # the rare words are replaced, order and answer stay
        reworded = reworded.replace(w + " ", f"other{w[4:]} ")
    rows += [(1000, often), (1001, "common1 " * 37 + often + " common2" * 50), (1002, reworded), (1003, item)]
    bench = spark.createDataFrame([(1, often), (2, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs(rows), bench).collect()} == {(1000, 1), (1001, 1), (1002, 2), (1003, 2)}


def test_leaks_against_every_window(spark, docs):
    """All documents against all items, at every start: nothing false, nine tenths found, verbatim ones all."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(1500)}"
    items = [[word() for _ in range(rng.choice([5, 12, 30, 60, 110]))] for _ in range(60)]
    bench = [(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:])) for i, w in enumerate(items)]
    rows, whole = [(9000, ""), (9001, None)], set()
    for doc in range(240):
        i, lost = doc % 60, 0.12 * (doc // 60)
        body = [w if rng.random() >= lost else f"x{rng.randrange(999)}" for w in items[i][:-4]] + items[i][-4:]
        if body == items[i]:
            whole.add((doc, i))
        around = [[word() for _ in range(rng.randint(0, 90))] for _ in range(2)]
        rows.append((doc, " ".join([*around[0], *body, *around[1], *(body if doc % 7 == 0 else ())])))
    rows.append((8000, " ".join(items[2] * 30 + [word() for _ in range(30_000)] + items[3])))  # long, and the item over and over
    expected = {}
    answers = [np.array(w[-4:]) for w in items]
    for doc, text in rows[2:-1]:
        words = np.array(text.split())
        for i, item in enumerate(items):
            width = decontam._width(len(item))[0]
            held = np.concatenate([[0], np.cumsum(np.isin(words, item))])
            starts = np.arange(max(1, len(words) - width + 1))
            enough = held[np.minimum(starts + width, len(words))] - held[starts] >= decontam.LOOSE * len(item)
            for s in starts[enough].tolist():
                part = words[s : s + width]
                share = decontam.common_order(np.array(item), part) / len(item)
                if decontam._holds(len(item), share, decontam.common_order(answers[i], part) / 4):
                    expected[doc, i] = max(share, expected.get((doc, i), 0.0))
    got = {(r.doc_id, r.item_id): r for r in leaks(docs(rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert {i for d, i in got if d == 8000} >= {2, 3}
    found = {k: r for k, r in got.items() if k[0] != 8000}
    assert whole <= found.keys() <= expected.keys()
    assert all(r.overlap <= expected[k] + 1e-9 for k, r in found.items())
    assert len(found) >= 0.9 * len(expected) and len(expected) > 120


def test_windows_that_share_enough():
    """The bound on a window is the words that both have, as often as both have them."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        place, item = rng.integers(0, 12, 300), rng.integers(0, 10, rng.integers(1, 40))
        times = np.bincount(item, minlength=13)
        low = np.array([0, 70, 200])
        high = np.array([60, 190, 300])
        width, step = decontam._width(len(item))
        need = max(1, len(item) // 2)
        expected = set()
        for r in range(3):
            for s in range(low[r], max(low[r], high[r] - width) + step, step):
                e = min(s + width, high[r])
                both = int(np.minimum(np.bincount(place[s:e], minlength=13), times).sum())
                assert decontam.common_order(item, place[s:e]) <= both
                if both >= need:
                    expected.add((r, s, e, both))
        got = list(decontam._windows_sharing(low, high, place, times, len(item), need))
        assert len(got) == len(set(got)) and {w[:3] for w in expected} - {w[:3] for w in got} == set()
        assert set(got) == expected


def test_common_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randint(0, 12))], dtype=np.int64) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontam.common_order(a, b) == best[-1, -1]


def test_toxicity_on_held_out_rows(spark, docs):
    rng = random.Random(5)
    plain = ["".join(rng.choice(["ba", "lo", "ti", "re", "na"]) for _ in range(3)) for _ in range(150)]
    bad = ["grimwicket", "snorfblat", "vexhound"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 150))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * rng.randint(2, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    rows += [(2000, ""), (2001, None), (None, "x"), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (3, 0, None), (None, 0, 1), (0, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity(docs(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert "".join(w.decode()[:48] for w in windows("ab cd " * 100)) in "ab cd " * 100


def test_toxic_wording_of_noisy_labels():
    """A tenth of the toxic rows are labelled ordinary."""
    rng = random.Random(9)
    plain = ["".join(rng.choice(["ba", "lo", "ti", "re", "na"]) for _ in range(3)) for _ in range(150)]
    rows = []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 150))]
        for _ in range(3 * (i % 3 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(["grimwicket", "snorfblat", "vexhound"]))
        rows.append((" ".join(words), int(i % 3 == 0 and rng.random() > 0.1)))
    found = _toxic_wording(*([t for t, c in rows if c == k] for k in (0, 1)))
    assert {w for part in found for w in part.split()} == {b"grimwicket", b"snorfblat", b"vexhound"}


def test_nearest_by_index(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:140] = x[100]  # equal vectors tie by id
    rows = [(i, v.tolist(), "v") for i, v in enumerate(x)]
    rows += [(20, rows[20][1], "v"), (9000, None, "v"), (9020, [0.0] * 16, "v"), (9040, [float("nan")] * 16, "v"), (9060, [None, *[1.0] * 15], "v"), (9080, [1.0], "v"), (None, [1.0] * 16, "v")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = defaultdict(list)
    for r in nearest_by_index(frame, 20, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float32).astype(float)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        ids = np.lexsort((np.arange(3000), -np.round(s, 12)))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
        assert [v for _, v, _ in found] == sorted((v for _, v, _ in found), key=lambda v: (-round(s[v], 12), v))
        hits += len({v for _, v, _ in found} & set(ids.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = nearest_by_index(frame.where("vec_id in (0, 1, 2, 9000)"), 20, 20)
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("total", [30, 200, 400, 2000, 5000])
def test_recall_of_half_the_entries(spark, monkeypatch, total):
    """Vectors without structure, at sizes where all were visited or codewords were few."""
    x = np.random.default_rng(total).normal(size=(total, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    seen = []

    def watched(queries, books, counts, enough):
        visits = visits_of(queries, books, counts, enough)
        seen.append((counts, visits.select("query_id", "first", "seconds").collect()))
        return visits

    visits_of = multi_index.visits_of
    monkeypatch.setattr(multi_index, "visits_of", watched)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in nearest_by_index(frame, 20, 20).collect():
        got[r.query_id].add(r.vec_id)
    [(counts, visits)] = seen
    held = Counter()
    for r in visits:
        held[r.query_id] += int(counts[r.first, r.seconds].sum())
    most = max(multi_index.SHARE * total, 21) + counts.max()
    assert set(held) == set(range(0, total, 20)) and max(held.values()) <= most
    y = x.astype(float)
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        assert len(found) == 20
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(held)) >= 0.9


def test_cells_come_by_distance():
    rng = np.random.default_rng(7)
    a, b = rng.random(9), rng.random(7)
    sums = [a[i] + b[j] for i, j in cells_in_order(a, b)]
    assert len(sums) == 63 and sums == sorted(sums)


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == columns, name
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted(r.doc_id for r in stages["n-gram Jaccard join"](spark, docs, sf_dir).collect())
    groups = components_by_force([(r.doc_id, r.text) for r in rows], 5, 80)
    assert kept == sorted(i for i, n, c in groups if n == 0 or i == c)
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < got.count()
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]


def test_whole_texts_come_in_small_batches(spark, docs):
    given = docs([(i, f"{i} " + "word " * 4_000) for i in range(400)]).coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    jaccard_components(given, 4, 85)
    sizes = given.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint")
    assert sizes.agg(F.max("n")).first()[0] < 2 << 20
    spark.conf.set(key, "3m")
    jaccard_components(given.limit(1), 4, 85)
    assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)


def test_marks_reach_the_driver_as_arrow(spark, monkeypatch):
    rows = spark.createDataFrame([(5,), (69,), (-1,)], "region bigint")
    monkeypatch.setattr(type(rows), "collect", None)  # toPandas() makes an object of every row by it
    bits = jaccard.marked(rows)
    assert {i * 64 + b for i in np.flatnonzero(bits).tolist() for b in range(64) if int(bits[i]) >> b & 1} == {5, 69, jaccard.MARKS - 1}
