"""Benchmark decontamination by latent semantic retrieval.

Passages of ``PASSAGE`` words become TF-IDF vectors over the benchmark's words, weighted by how
many of all documents hold a word. A randomised SVD of the benchmark's passages, computed by Spark
tasks that multiply their rows, gives a latent space. Every passage of every document is
projected into it and compared with the benchmark's passages by cosine. Around the candidates
the longest common subsequence with the whole item decides, and for looser matches
(paraphrases) also the one with the item's answer, its last sentence. It is computed where the
words shared with the item, counted as often as both have them, leave it possible.

A space is fitted for every block of items, so that it keeps most of their energy however large
the benchmark is. Documents are read once for a group of blocks. It is not fitted on the corpus as well: the leading directions of a corpus are
its common words, which say nothing about an item. Corpus statistics cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import MARKS, word_hashes

PASSAGE, STEP = 32, 16
#: Items of a block, and latent dimensions; a block of usual items has few more passages.
BLOCK_ITEMS, RANK, OVERSAMPLE, POWERS = 128, 128, 16, 2
GROUP_ITEMS = 2_048
#: Known words that are projected, windows that are compared, and words around candidates, at a time.
ROWS, WINDOWS, FLAT = 512, 2_048, 1 << 18
#: A candidate has this cosine, less for items below a passage's length by the root of the words
#: they fill of it, and this share of the item passage's latent energy.
COSINE, ENERGY = 0.4, 0.3
#: Share of the item's words in common order that decides alone, and with the answer's share.
ALONE, LOOSE, ANSWER = 0.75, 0.5, 0.8
#: Items with fewer words must occur whole.
SHORT = 8
ANSWER_WORDS = 3


@dataclass(frozen=True)
class Block:
    """The items of a block and their latent space."""

    items: tuple[tuple[int, np.ndarray, np.ndarray], ...]  # id, words, words of the answer
    vocabulary: np.ndarray  # sorted word hashes
    basis: np.ndarray  # vocabulary x rank, times the word's weight
    passages: np.ndarray  # latent vectors
    owner: np.ndarray  # item of each passage


def _words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, words, first in word_hashes(pa.array(texts, pa.string()), MARKS):
        out.extend(words[a:b] for a, b in zip(first[:-1], first[1:], strict=True))
    return out


def _answer(text: str) -> str:
    """The last sentence that has a few words."""
    cut = text
    for mark in "!?\n":
        cut = cut.replace(mark, ".")
    found = [s for s in cut.split(".") if len(s.split()) >= ANSWER_WORDS]
    return found[-1] if found else text


def _read_groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in groups; each is bounded, and one is held at a time."""
    items = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    items = items.select("item_id", F.lower("text").alias("text")).distinct()
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for i in range(groups):
        rows = items.where(group == i).orderBy("item_id", "text").collect()
        yield [(r.item_id, r.text) for r in rows]


def document_counts(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each word, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for batch in batches:
            rows += len(batch)
            for _, words, first in word_hashes(batch.column("text"), MARKS):
                place, known = _look_up(vocabulary, words)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.unique(owner[known] * np.int64(len(vocabulary)) + place[known])
                seen[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        seen[-1] = rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["place", "n"])

    found = (
        documents.select(_lowered(F.col("text")).alias("text"))
        .mapInArrow(count, "place bigint, n bigint")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    totals = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    totals[found["place"].to_numpy(dtype=np.int64)] = found["n"]
    return totals[:-1], int(totals[-1])


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _look_up(vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return place, vocabulary[place] == words


def _passages(words: int) -> list[tuple[int, int]]:
    """Starts and ends of the passages of so many words; the last ends with the text."""
    if words <= PASSAGE:
        return [(0, words)]
    starts = [*range(0, words - PASSAGE, STEP), words - PASSAGE]
    return [(s, s + PASSAGE) for s in starts]


def _rows_times(passages: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """``A' (A matrix)`` for the passage rows of ``A``: tasks multiply their rows and add up."""
    size, width = matrix.shape

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(matrix.shape)
        for frame in frames:
            for places, values in zip(frame["places"], frame["weights"], strict=True):
                own = np.asarray(values) @ matrix[places]
                np.add.at(total, places, np.outer(values, own))
        yield pd.DataFrame({"part": [0], "total": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        parts = (np.frombuffer(t) for t in frame["total"])
        return pd.DataFrame({"part": [0], "total": [sum(parts).tobytes()]})

    parts = passages.mapInPandas(multiply, "part int, total binary")
    found = parts.groupBy("part").applyInPandas(add, "part int, total binary").first()
    return np.frombuffer(found.total).reshape(size, width)


def randomised_svd(passages: DataFrame, size: int) -> np.ndarray:
    """The leading right singular vectors of the passage rows, ``size`` x rank."""
    width = min(size, RANK + OVERSAMPLE)
    basis = np.random.default_rng(11).standard_normal((size, width))
    for _ in range(POWERS + 1):
        basis, _ = np.linalg.qr(_rows_times(passages, basis))
    inner = basis.T @ _rows_times(passages, basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(values)[::-1][:RANK]
    return basis @ vectors[:, top[values[top] > 1e-9 * max(values.max(), 1e-9)]]


def fit_groups(documents: DataFrame, benchmark: DataFrame) -> Iterator[list[Block]]:
    """The blocks of each group of items."""
    for items in _read_groups(benchmark):
        words = _words([text for _, text in items])
        answers = _words([_answer(text) for _, text in items])
        held = [(i, w, a) for (i, _), w, a in zip(items, words, answers, strict=True) if len(w)]
        if not held:
            continue
        vocabulary = np.unique(np.concatenate([w for _, w, _ in held]))
        counts, rows = document_counts(documents, vocabulary)
        weights = np.log((1 + rows) / (1 + counts)) + 1e-3
        blocks = []
        for i in range(0, len(held), BLOCK_ITEMS):
            part = tuple(held[i : i + BLOCK_ITEMS])
            own = np.unique(np.concatenate([w for _, w, _ in part]))
            blocks.append(_fit(documents.sparkSession, part, own, weights[np.searchsorted(vocabulary, own)]))
        yield blocks


def _fit(spark: SparkSession, items: tuple, vocabulary: np.ndarray, weights: np.ndarray) -> Block:
    rows, owner = [], []
    for k, (_, words, _) in enumerate(items):
        place, _ = _look_up(vocabulary, words)
        for start, end in _passages(len(words)):
            own, times = np.unique(place[start:end], return_counts=True)
            rows.append((own.tolist(), (times * weights[own]).tolist()))
            owner.append(k)
    table = spark.createDataFrame(rows, "places array<int>, weights array<double>")
    basis = randomised_svd(table, len(vocabulary))
    latent = np.array([np.asarray(v) @ basis[p] for p, v in rows])
    basis = (weights[:, None] * basis).astype(np.float32)
    return Block(items, vocabulary, basis, latent.astype(np.float32), np.array(owner))


def _latent_windows(block: Block, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and latent vector of every window of a run of documents; each shares half with the next."""
    counts = np.diff(first)
    steps = -(-counts // STEP)
    begin = np.cumsum(steps) - steps
    owner = np.repeat(np.arange(len(counts)), counts)
    here = np.flatnonzero(place < len(block.vocabulary))
    step = begin[owner[here]] + (here - first[owner[here]]) // STEP
    total = np.zeros((int(steps.sum()) + 1, block.basis.shape[1]), dtype=np.float32)
    for i in range(0, len(here), ROWS):
        own = step[i : i + ROWS]
        runs = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[runs]] += np.add.reduceat(block.basis[place[here[i : i + ROWS]]], runs)
    # a window is a step and the next one; a text of one step is a window by itself
    windows = np.where(counts > 0, np.maximum(1, steps - 1), 0)
    doc = np.repeat(np.arange(len(counts)), windows)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[doc] + inner
    following = np.where(steps[doc] > 1, at + 1, len(total) - 1)
    return first[doc] + inner * STEP, total[at] + total[following]


def _candidates(block: Block, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage start, item and cosine of every candidate of a run of documents."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
    starts, latent = _latent_windows(block, place, first)
    energy = (block.passages * block.passages).sum(1)
    lengths = np.sqrt((latent * latent).sum(1))
    # other words fill the window around an item that is shorter than it
    filled = np.array([min(1.0, len(words) / PASSAGE) for _, words, _ in block.items])[block.owner]
    least = (COSINE * np.sqrt(filled)).astype(np.float32)
    for i in range(0, len(starts), WINDOWS):
        inner = latent[i : i + WINDOWS] @ block.passages.T
        w, p = np.nonzero(inner >= ENERGY * energy)
        both, inner = lengths[i + w] * np.sqrt(energy[p]), inner[w, p]
        near = (both > 1e-6) & (inner >= least[p] * both)
        w, p = w[near], p[near]
        found.append((starts[i + w], block.owner[p], inner[near] / both[near]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _bits(words: list[int]) -> dict[int, int]:
    """The places of each word, as the bits of a number."""
    where: dict[int, int] = {}
    for i, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << i
    return where


def _in_order(where: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a row at a time in the bits of a number."""
    row, full = 0, (1 << size) - 1
    for w in words:
        hit = where.get(w)
        if hit is None:
            continue
        grown = row | hit
        row = grown & ~(grown - (row << 1 | 1)) & full
    return row.bit_count()


def common_order(a: np.ndarray, b: np.ndarray) -> int:
    return _in_order(_bits(a.tolist()), len(a), b.tolist())


def _width(size: int) -> tuple[int, int]:
    """Words of a window in which an item is looked for, and the distance of their starts."""
    return (size, 1) if size < SHORT else (-(-5 * size // 4), max(1, size // 8))


def _regions(starts: np.ndarray, near: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Document, start, end and best cosine of the regions around an item's candidates, merged where they meet."""
    order = np.argsort(starts, kind="stable")
    starts, near = starts[order], near[order]
    doc = np.searchsorted(first, starts, "right") - 1
    low = np.maximum(first[doc], starts - width)
    high = np.minimum(first[doc + 1], starts + PASSAGE + width)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])]))
    return doc[new], low[new], np.maximum.reduceat(high, new), np.maximum.reduceat(near, new)


def _shared(spot: np.ndarray, times: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each word of an item, where the window must begin at the latest for it to be one too many.

    A word that the item has t times counts in a window if fewer than t equal ones stand before
    it there: if the t-th before it lies before the window (-1: there is none).
    """
    order = np.lexsort((spot, place, owner))
    spot, times, owner, place = spot[order], times[order], owner[order], place[order]
    before = np.arange(len(spot)) - times
    valid = before >= 0
    valid[valid] = (owner[before[valid]] == owner[valid]) & (place[before[valid]] == place[valid])
    last = np.full(len(spot), -1, dtype=np.int64)
    last[valid] = spot[before[valid]]
    out = np.empty(len(spot), dtype=np.int64)
    out[order] = last
    return out


def _windows_sharing(
    low: np.ndarray, high: np.ndarray, place: np.ndarray, times: np.ndarray, size: int, need: int
) -> Iterator[tuple[int, int, int, int]]:
    """Region, start, end and bound of the windows that share ``need`` words with the item.

    The bound counts an item's word as often as both have it, so the common order is never longer.
    """
    width, step = _width(size)
    length = high - low
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(owner)) + (low - begin)[owner]
    held = times[place[at]]
    spot = np.flatnonzero(held)
    sums = np.concatenate([[0], np.cumsum(held > 0)])
    number = 1 + -(-np.maximum(0, length - width) // step)
    region = np.repeat(np.arange(len(length)), number)
    inner = np.arange(len(region)) - np.repeat(np.cumsum(number) - number, number)
    start = begin[region] + inner * step
    end = np.minimum(start + width, (begin + length)[region])
    some = sums[end] - sums[start] >= need
    region, start, end = region[some], start[some], end[some]
    if not len(start):
        return
    last = np.full(len(held) + 1, len(held), dtype=np.int64)
    last[spot] = _shared(spot, held[spot], owner[spot], place[at[spot]])
    rows = max(1, FLAT // width)
    for i in range(0, len(start), rows):
        own = np.minimum(start[i : i + rows, None] + np.arange(width), len(held))
        inside = own < end[i : i + rows, None]
        bound = ((last[own] < start[i : i + rows, None]) & inside).sum(1)
        for j in np.flatnonzero(bound >= need):
            r = int(region[i + j])
            shift = int(low[r] - begin[r])
            yield r, int(start[i + j]) + shift, int(end[i + j]) + shift, int(bound[j])


def _matches(
    block: Block, place: np.ndarray, first: np.ndarray
) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Document, item id, share, answer's share, cosine and start of all that holds near candidates.

    Of the windows of a region that hold, the one with the largest share counts, then the first.
    """
    starts, items, near = _candidates(block, place, first)
    times = np.zeros(len(block.vocabulary) + 1, dtype=np.int64)
    for k in np.unique(items).tolist():
        item_id, item, answer = block.items[k]
        size = len(item)
        words, said = _look_up(block.vocabulary, item)[0], _look_up(block.vocabulary, answer)[0]
        where, where_said = _bits(words.tolist()), _bits(said.tolist())
        times[:] = np.bincount(words, minlength=len(times))
        need = size if size < SHORT else int(np.ceil(LOOSE * size))
        doc, low, high, cosine = _regions(starts[items == k], near[items == k], first, _width(size)[0])
        parts = np.flatnonzero(np.diff(np.cumsum(high - low) // FLAT, prepend=-1))
        for a, b in zip(parts, [*parts[1:], len(doc)], strict=True):
            best: dict[int, tuple[float, float, int]] = {}
            open_ = _windows_sharing(low[a:b], high[a:b], place, times, size, need)
            for r, start, end, bound in sorted(open_, key=lambda w: (-w[3], w[1])):
                known = best.get(r)
                if known and bound / size <= known[0]:
                    continue
                part = place[start:end]
                share = _in_order(where, size, part[times[part] > 0].tolist()) / size
                if share < LOOSE or known and share <= known[0]:
                    continue
                told = _in_order(where_said, len(said), part.tolist()) / len(said) if len(said) else 1.0
                if _holds(size, share, told):
                    best[r] = (share, told, start)
            for r, (share, told, start) in best.items():
                d = int(doc[a + r])
                yield d, item_id, share, told, float(cosine[a + r]), start - int(first[d])


def _holds(size: int, share: float, answer: float) -> bool:
    if size < SHORT:
        return share == 1.0
    return share >= ALONE or share >= LOOSE and answer >= ANSWER


def leaks_in(blocks: list[Block], text: Column) -> Column:
    """The items that a text holds: array of (item_id, overlap, answer, cosine, start word)."""
    kind = pa.list_(
        pa.struct(
            [
                ("item_id", pa.int64()),
                ("overlap", pa.float64()),
                ("answer", pa.float64()),
                ("cosine", pa.float64()),
                ("start", pa.int64()),
            ]
        )
    )

    @F.arrow_udf("array<struct<item_id bigint, overlap double, answer double, cosine double, start bigint>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found: list[list[dict]] = []
            for _, words, first in word_hashes(texts, MARKS):
                run: list[dict[int, dict]] = [{} for _ in range(len(first) - 1)]
                for block in blocks if len(words) else ():
                    place, known = _look_up(block.vocabulary, words)
                    place = np.where(known, place, len(block.vocabulary))
                    for doc, item_id, share, said, cosine, start in _matches(block, place, first):
                        if item_id not in run[doc] or share > run[doc][item_id]["overlap"]:
                            run[doc][item_id] = {"item_id": item_id, "overlap": share, "answer": said, "cosine": cosine, "start": start}
                found.extend([d[i] for i in sorted(d)] for d in run)
            yield pa.array(found, kind)

    return search(_lowered(text))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, overlap, answer, cosine, start`` for every item a document holds.

    One row per document row and item; ``start`` counts words from the text's beginning. Null
    and empty texts hold nothing; items without words are ignored; an item id given twice with
    different texts is searched in both. Words are runs of letters and digits in either case.
    Repeated document rows repeat their rows. Other columns are ignored.
    """
    found = None
    for blocks in fit_groups(documents, benchmark):
        held = documents.select("doc_id", F.explode(leaks_in(blocks, F.col("text"))).alias("leak"))
        held = held.select("doc_id", "leak.*")
        found = held if found is None else found.unionByName(held)
    if found is None:
        schema = "doc_id bigint, item_id bigint, overlap double, answer double, cosine double, start bigint"
        return documents.sparkSession.createDataFrame([], schema)
    return found


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    kept = documents
    for blocks in fit_groups(documents, benchmark):
        kept = kept.where(F.size(leaks_in(blocks, F.col("text"))) == 0)
    return kept
