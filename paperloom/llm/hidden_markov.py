"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

*Words and symbols.* Every word of every training text is counted. A word that makes up at least
one in ``OWN`` training tokens is a symbol of its own; the others share ``BUCKETS`` symbols by
their hash, and within its bucket a word has its smoothed share of the bucket's tokens. So a
state emits a word with P(symbol | state) P(word | symbol), a proper distribution over all words,
and what training gathers per state has a fixed size while the counts grow with the corpus.

*Training.* Each iteration is one job over the stored symbols: a task runs the scaled forward and
backward recursions over its texts and emits expected counts, which are summed by symbol. The
counts travel as whole numbers, so their sum does not depend on the order of tasks.

*Long texts.* The recursions run over many stretches of ``STRETCH`` tokens at once. What a stretch
does to the vector of states is a matrix; the product of these carries the recursion over the
ends of stretches exactly, so a text of any length takes its tokens' time and no more steps.

*Rare words.* Words that make up at least one in ``KNOWN`` tokens go to every task. Each other one
is found by a join on its hash, in which therefore no key is hot. Words are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import stored_once

STATES, ITERATIONS = 8, 6
OWN, BUCKETS, KNOWN = 1 << 14, 1 << 14, 1 << 20
#: Tokens that the recursions run over at once before stretches are chained, and share of a
#: state's emissions that follows the counts of all words.
STRETCH, UNIGRAM = 256, 0.02
#: Steps after which the matrices of stretches are scaled.
RESCALED = 8
#: Characters tokenised at a time, tokens of a training batch, and words a task counts before it emits.
PIECE, BATCH_TOKENS, KEPT_WORDS = 2 << 20, 1 << 19, 1 << 20
#: Expected counts are summed in units of this.
UNIT = 2.0**-24

END = 0  # the symbol behind every text


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per word of all texts the place among the distinct ones, words per text, distinct words."""
    plain = pc.ascii_lower(texts)
    for space in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, space, " ")
    lists = pc.split_pattern(plain, " ")
    size = np.diff(np.asarray(lists.offsets))
    words = lists.flatten()
    filled = np.asarray(pc.greater(pc.binary_length(words), 0).cast(pa.int8())).astype(bool)
    owner = np.repeat(np.arange(len(texts)), size)[filled]
    coded = words.filter(pa.array(filled)).dictionary_encode()
    # as objects at once: to_pylist() makes a scalar of every word first
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.asarray(coded.indices), np.bincount(owner, minlength=len(texts)), distinct


def hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)


def pieces(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[pa.Array, ...]]:
    """The text column, nulls as empty, in runs of about ``PIECE`` characters, with other columns."""
    texts = pc.fill_null(pc.cast(batch.column("text"), pa.large_string()), "")
    size = np.cumsum(np.asarray(pc.binary_length(texts)))
    low = 0
    while low < len(texts):
        floor = int(size[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(size, floor + PIECE, side="right")))
        yield texts.slice(low, high - low), *(batch.column(n).slice(low, high - low) for n in names)
        low = high


def count_words(documents: DataFrame) -> DataFrame:
    """``word, in_training, in_all``: tokens by the hash of their word, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def merged() -> list[np.ndarray]:
            word, at = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([k[i] for k in kept]), minlength=len(word)) for i in (1, 2)]
            return [word, *(s.astype(np.int64) for s in sums)]

        for batch in batches:
            for texts, held_out in pieces(batch, ["held_out"]):
                index, size_of, words = words_of(texts)
                training = np.repeat(~np.asarray(held_out).astype(bool), size_of)
                everywhere = np.bincount(index, minlength=len(words))
                kept.append([hashes(words), np.bincount(index[training], minlength=len(words)), everywhere])
                size += len(words)
                if size > KEPT_WORDS:
                    found = merged()
                    if len(found[0]) > KEPT_WORDS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["word", "t", "a"])
                        kept, size = [], 0
                    else:
                        kept, size = [found], len(found[0])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged()], ["word", "t", "a"])

    counted = documents.select("text", "held_out").mapInArrow(count, "word bigint, t bigint, a bigint")
    return counted.groupBy("word").agg(F.sum("t").alias("in_training"), F.sum("a").alias("in_all"))


@dataclass
class Vocabulary:
    """Symbols and unigram counts of what every task needs to know; at most ``KNOWN + OWN`` words."""

    tokens: int  # of all training texts, ends included
    mass: float  # by which a smoothed count is divided
    ends: int
    share: np.ndarray  # smoothed share of each symbol among training tokens
    added: np.ndarray  # what smoothing adds to each symbol: 0.5 per word, and for unknown ones
    word: np.ndarray  # sorted hashes
    count: np.ndarray
    symbol: np.ndarray
    within: np.ndarray  # log10 share of the word within its symbol
    buckets: int = BUCKETS

    @property
    def unknown(self) -> int:
        return len(self.share) - 1

    def bucket(self, word: np.ndarray) -> np.ndarray:
        return self.unknown - self.buckets + word % self.buckets

    def base(self, count: np.ndarray | int) -> np.ndarray:
        return np.log10((count + 0.5) / self.mass)


def build_vocabulary(counts: DataFrame, ends: int, texts: int) -> Vocabulary:
    """``counts`` with ``within`` is left to joins; only frequent words and sums of buckets are gathered."""
    total = counts.agg(
        F.coalesce(F.sum("in_training"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("in_all"), F.lit(0)).alias("a"),
        F.count_if(F.col("in_training") > 0).alias("v"),
    ).first()
    tokens, everywhere = total.n + ends, total.a + texts
    mass = tokens + 0.5 * (total.v + (ends > 0) + 1)
    own = (F.col("in_training") * OWN >= tokens) & (F.col("in_training") > 0)
    shared = counts.where(~own & (F.col("in_training") > 0)).groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket"))
    in_bucket, added = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in shared.agg(F.sum("in_training").alias("n"), F.count("*").alias("v")).collect():  # one per bucket
        in_bucket[row.bucket], added[row.bucket] = row.n + 0.5 * row.v, 0.5 * row.v
    known = counts.where(own | (F.col("in_all") * KNOWN >= everywhere)).withColumn("own", own).toArrow()
    word = known.column("word").to_numpy()
    order = np.argsort(word)
    word, count = word[order], known.column("in_training").to_numpy()[order]
    own = known.column("own").to_numpy(zero_copy_only=False)[order]
    smoothed = count + 0.5
    share = np.concatenate([[ends + 0.5], smoothed[own], in_bucket, [0.5]]) / mass
    added = np.concatenate([[0.5], np.full(own.sum(), 0.5), added, [0.5]])
    symbol = len(share) - 1 - BUCKETS + word % BUCKETS
    symbol[own] = 1 + np.arange(own.sum())
    symbol[count == 0] = len(share) - 1
    with np.errstate(divide="ignore"):
        within = np.where(own | (count == 0), 0.0, np.log10(smoothed / np.maximum(in_bucket[word % BUCKETS], 0.5)))
    return Vocabulary(tokens, mass, ends, share, added, word, count, symbol.astype(np.int32), within, BUCKETS)


ENCODED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double, "
    "symbols array<int>, rare array<bigint>, rare_n array<int>"
)


def encode_texts(documents: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Symbols of every text and its end. Words that the vocabulary leaves out are listed in
    ``rare``; in a training text they have their bucket's symbol, and in a held-out one, where
    they may be unknown, the symbol is -1 less their place in ``rare``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        base, row = known.base(known.count), TaskContext.get().partitionId() << 40
        for batch in batches:
            for texts, held_out, ids in pieces(batch, ["held_out", "doc_id"]):
                index, n_words, words = words_of(texts)
                rows, word = len(texts), hashes(words)
                at = np.searchsorted(known.word, word)
                at[at == len(known.word)] = 0
                found = known.word[at] == word if len(known.word) else np.zeros(len(word), bool)
                symbol = known.bucket(word)
                symbol[found] = known.symbol[at[found]]
                value = np.zeros((3, len(word)))
                if len(known.word):
                    value[:, found] = (known.count > 0)[at[found]], base[at[found]], known.within[at[found]]
                held = np.asarray(held_out).astype(bool)
                owner = np.repeat(np.arange(rows), n_words)
                sums = [np.bincount(owner, weights=v[index], minlength=rows) for v in value]
                symbols = symbol[index]
                # distinct rare words per text
                rare = np.flatnonzero(~found[index])
                key, back, n = np.unique(owner[rare] * len(words) + index[rare], return_inverse=True, return_counts=True)
                rare_at = np.searchsorted(key, np.arange(rows + 1) * max(len(words), 1))
                place = back - rare_at[owner[rare]]
                apart = held[owner[rare]]
                symbols[rare[apart]] = -1 - place[apart]
                ends = np.cumsum(n_words)
                symbols = np.insert(symbols, ends, END)
                upto = np.concatenate([[0], ends + np.arange(1, rows + 1)])
                end_known, end_base = int(known.ends > 0), float(known.base(known.ends))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row + np.arange(rows)),
                    "doc_id": ids,
                    "held_out": held_out,
                    "n_tokens": pa.array(n_words + 1, pa.int64()),
                    "n_known": pa.array(sums[0].astype(np.int64) + end_known),
                    "base": pa.array(sums[1] + end_base),
                    "within": pa.array(sums[2]),
                    "symbols": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(symbols, pa.int32())),
                    "rare": pa.ListArray.from_arrays(
                        pa.array(rare_at, pa.int32()), pa.array(word[key % max(len(words), 1)] if len(key) else [], pa.int64())
                    ),
                    "rare_n": pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(n, pa.int32())),
                })
                row += rows

    return documents.select("text", "held_out", "doc_id").mapInArrow(encode, ENCODED)


@dataclass
class Model:
    """First state, transitions, and emissions as (symbols, states)."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def first_model(vocabulary: Vocabulary, states: int = STATES) -> Model:
    """States that differ a little in what they emit and tend to stay; the same for one vocabulary."""
    noise = np.random.default_rng(0).exponential(size=(len(vocabulary.share), states))
    emits = vocabulary.share[:, None] * (0.5 + noise)
    emits[-1] = vocabulary.share[-1]
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(0))


class Lanes:
    """Stretches of tokens that are walked side by side, longest first.

    Tokens are laid out by step, so a step's tokens and what belongs to them are one slice.
    """

    def __init__(self, text: np.ndarray, number: np.ndarray, start: np.ndarray, length: np.ndarray, symbols: np.ndarray) -> None:
        order = np.argsort(-length, kind="stable")
        self.text, self.number, self.length = text[order], number[order], length[order]
        steps = int(self.length[0]) if len(order) else 0
        self.active = np.searchsorted(-self.length, -np.arange(1, steps + 1), side="right")
        self.upto = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(steps), self.active)
        lane = np.arange(len(step)) - self.upto[step]
        self.symbols = symbols[start[order][lane] + step]
        self.last = self.upto[self.length - 1] + np.arange(len(order)) if steps else np.zeros(0, np.int64)

    def steps(self) -> Iterator[tuple[int, int, slice]]:
        for t, n in enumerate(self.active.tolist()):
            yield t, n, slice(int(self.upto[t]), int(self.upto[t]) + n)

    def forward(self, model: Model, emits: np.ndarray, entry: np.ndarray, move_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scaled states at every token, and their scales."""
        seen, scale = np.empty_like(emits), np.empty(len(emits))
        one = np.ones(len(model.start))  # sums short rows faster than sum() does
        now = entry
        for t, n, at in self.steps():
            new = seen[at]
            if t or move_first:
                np.matmul(now[:n], model.moves, out=new)
                new *= emits[at]
            else:
                np.multiply(now[:n], emits[at], out=new)
            total = np.matmul(new, one, out=scale[at])
            new /= total[:, None]
            now = new
        return seen, scale

    def matrices(self, model: Model, emits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each stretch does to the states, and the log10 of its scale."""
        k, lanes = len(model.start), len(self.length)
        product, spare = (np.empty((lanes, k, k)) for _ in range(2))
        product[:] = np.eye(k)
        scale = np.zeros(lanes)
        for t, n, at in self.steps():
            np.matmul(product[:n].reshape(-1, k), model.moves, out=spare[:n].reshape(-1, k))
            np.multiply(spare[:n], emits[at][:, None, :], out=product[:n])
            if t % RESCALED == RESCALED - 1:
                top = product[:n].max(axis=(1, 2))
                product[:n] /= top[:, None, None]
                scale[:n] += np.log10(top)
        return product, scale

    def backward(
        self, model: Model, emits: np.ndarray, seen: np.ndarray, scale: np.ndarray, entry: np.ndarray, behind: np.ndarray, move_first: bool
    ) -> np.ndarray:
        """Turns ``seen`` into the expected states of every token; returns expected transitions
        before the model's own, given the states before each stretch and the weights behind it.

        Divided by the scales of the forward recursion, weights stay such that the expected
        states of a token sum to one, once they do for a stretch's last.
        """
        k = len(model.start)
        moves, back_moves = np.zeros((k, k)), np.ascontiguousarray(model.moves.T)
        behind /= np.einsum("nk,nk->n", seen[self.last], behind)[:, None]
        for t, n, at in reversed(list(self.steps())):
            ahead = emits[at] * behind[:n]
            seen[at] *= behind[:n]
            if not (t or move_first):
                break
            ahead /= scale[at][:, None]
            before = seen[int(self.upto[t - 1]) :][:n] if t else entry[:n]
            moves += before.T @ ahead
            np.matmul(ahead, back_moves, out=behind[:n])
        return moves


class Work:
    """Some texts' symbols, cut into stretches: each text's first, and the chained ones."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray) -> None:
        """``size`` tokens per text, none empty."""
        self.texts = len(size)
        pieces = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(size) - size, pieces) + number * STRETCH
        length = np.minimum(np.repeat(size, pieces) - number * STRETCH, STRETCH)
        self.first, self.rest = (
            Lanes(text[w], number[w], start[w], length[w], symbols) for w in (number == 0, number > 0)
        )
        # lanes of the second, third, ... stretches
        by_number = np.argsort(self.rest.number, kind="stable")
        self.rounds = np.split(by_number, np.flatnonzero(np.diff(self.rest.number[by_number])) + 1) if len(by_number) else []

    def _along(self, model: Model):
        """The forward recursion over first stretches and, by matrices, over the ends of the others."""
        emits = model.emits[self.first.symbols]
        start = np.broadcast_to(model.start, (self.texts, len(model.start)))
        seen, firsts = self.first.forward(model, emits, start, False)
        score = np.zeros(self.texts)
        lane = np.arange(len(firsts)) - np.repeat(self.first.upto[:-1], self.first.active)
        score[self.first.text] = np.bincount(lane, weights=np.log10(firsts), minlength=self.texts)
        if not self.rounds:
            return score, (emits, seen, firsts), None
        state = np.empty((self.texts, len(model.start)))
        state[self.first.text] = seen[self.first.last]
        chained = model.emits[self.rest.symbols]
        product, scale = self.rest.matrices(model, chained)
        entry = np.empty((len(self.rest.text), len(model.start)))
        for lanes in self.rounds:
            owner = self.rest.text[lanes]
            entry[lanes] = state[owner]
            after = np.einsum("ni,nij->nj", state[owner], product[lanes])
            total = after.sum(1)
            score[owner] += np.log10(total) + scale[lanes]
            state[owner] = after / total[:, None]
        return score, (emits, seen, firsts), (chained, product, entry)

    def score(self, model: Model) -> np.ndarray:
        """log10 likelihood of each text."""
        return self._along(model)[0]

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected first states, transitions and states by symbol, and the log10 likelihood."""
        k = len(model.start)
        score, (emits, seen, scale), chained = self._along(model)
        later = np.ones((self.texts, k))
        moves, by_symbol = np.zeros((k, k)), np.zeros(model.emits.shape)
        if chained:
            of_rest, product, entry = chained
            behind = np.ones((len(entry), k))
            for lanes in reversed(self.rounds):
                owner = self.rest.text[lanes]
                behind[lanes] = later[owner]
                before = np.einsum("nij,nj->ni", product[lanes], later[owner])
                later[owner] = before / before.sum(1)[:, None]
            del product
            inside, inner = self.rest.forward(model, of_rest, entry, True)
            moves += self.rest.backward(model, of_rest, inside, inner, entry, behind, True)
            by_symbol += _by_symbol(self.rest.symbols, inside, len(by_symbol))
        moves += self.first.backward(model, emits, seen, scale, seen[:0], later[self.first.text], False)
        by_symbol += _by_symbol(self.first.symbols, seen, len(by_symbol))
        return seen[: self.texts].sum(0), moves * model.moves, by_symbol, float(score.sum())


def _by_symbol(symbols: np.ndarray, states: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(symbols, weights=states[:, i], minlength=size) for i in range(states.shape[1])], axis=1)


def _batches(symbols: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts with about ``BATCH_TOKENS`` tokens, or one longer text."""
    offsets = np.asarray(symbols.offsets).astype(np.int64)
    flat = np.asarray(symbols.values)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BATCH_TOKENS, side="right")) - 1)
        yield flat[offsets[low] : offsets[high]], np.diff(offsets[low : high + 1])
        low = high


def smoothed_emissions(expected: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """What states emit, from expected counts and their share of what smoothing adds: the states
    together give every symbol, the unknown one too, its share among all words. A little of each
    state's follows those shares alone."""
    total = expected.sum(0)
    part = total / max(vocabulary.tokens, 1)
    own = (expected + part * vocabulary.added[:, None]) / np.maximum(part * vocabulary.mass, 1e-300)
    mixed = np.where(total > 0, (1 - UNIGRAM) * own, 0) + np.where(total > 0, UNIGRAM, 1.0) * vocabulary.share[:, None]
    return mixed / mixed.sum(0)


def baum_welch_step(encoded: DataFrame, model: Model, vocabulary: Vocabulary) -> tuple[Model, float]:
    """One pass over the training texts: the next model, and the log10 likelihood under this one."""
    spark: SparkSession = encoded.sparkSession
    size, k = model.emits.shape
    given = spark.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = given.value
        emits, moves, start, score = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k), 0.0
        for batch in batches:
            for symbols, sizes in _batches(batch.column("symbols")):
                first, steps, of_symbols, log = Work(symbols, sizes).expected(model)
                start, moves, emits, score = start + first, moves + steps, emits + of_symbols, score + log
        seen = np.flatnonzero(emits.any(1))
        # transitions, first states and the likelihood follow the symbols
        table = np.concatenate([emits[seen], moves, start[None], np.full((1, k), score)])
        key = np.concatenate([seen, size + np.arange(k + 2)])
        whole = np.rint(table / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int32()), *(pa.array(whole[:, i]) for i in range(k))], ["symbol", *(f"s{i}" for i in range(k))]
        )

    columns = [f"s{i}" for i in range(k)]
    expected = encoded.where(~F.col("held_out")).select("symbols")
    expected = expected.mapInArrow(expect, "symbol int, " + ", ".join(f"{c} bigint" for c in columns))
    # at most one row per symbol comes back; sums of long texts may pass 63 bits
    sums = expected.groupBy("symbol").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).cast("double").alias(c) for c in columns)).toArrow()
    given.unpersist()
    table = np.zeros((size + k + 2, k))
    table[sums.column("symbol").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in columns], axis=1) * UNIT
    emits, moves, start, score = table[:size], table[size : size + k], table[size + k], table[size + k + 1, 0]
    emits = smoothed_emissions(emits, vocabulary)
    moves, start = moves + 1.0 / k, start + 1.0 / k
    return Model(start / start.sum(), moves / moves.sum(1)[:, None], emits), score


def train(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """The model and the likelihood of the training texts before each iteration."""
    model, scores = first_model(vocabulary, states), []
    for _ in range(iterations):
        model, score = baum_welch_step(encoded, model, vocabulary)
        scores.append(score)
    return model, scores


def _score(encoded: DataFrame, model: Broadcast, unknown: int) -> DataFrame:
    """``row, hidden``: log10 likelihood of the symbols; ``unseen`` names the unknown words of a row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            symbols, unseen = batch.column("symbols"), batch.column("unseen")
            offsets, missing = np.asarray(symbols.offsets).astype(np.int64), np.asarray(unseen.offsets)
            flat, names = np.array(symbols.values), np.asarray(unseen.values)
            buckets, at = batch.column("rare"), np.asarray(batch.column("rare").offsets)
            words = np.asarray(buckets.values)
            rare = np.flatnonzero(flat < 0)
            if len(rare):
                owner = np.searchsorted(offsets, rare, side="right") - 1
                place = at[owner] + (-1 - flat[rare])
                symbol = unknown - BUCKETS + words % BUCKETS
                symbol[np.repeat(at[:-1], np.diff(missing)) + names] = unknown
                flat[rare] = symbol[place]
            low = 0
            whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            for part, sizes in _batches(whole):
                found.append(Work(part, sizes).score(model.value))
                low += len(sizes)
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "hidden": pa.array(np.concatenate(found) if found else [])})

    return encoded.select("row", "symbols", "rare", "unseen").mapInArrow(score, "row bigint, hidden double")


def score_texts(documents: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A document is held out from training if the crc32 of its id as text is 1 modulo 5; a null id
    is in training. A null text is empty: its only token is its end. Rows with one id, and equal
    rows, each count and each give a row. Without training texts every word is unknown:
    the base score is 0, and the model gives an end and an unknown word one half each. A text of any length is read whole. An empty table gives no rows.
    Other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held_out"))
    counts = stored_once(count_words(docs), "hmm-words")
    sizes = docs.agg(F.count_if(~F.col("held_out")).alias("ends"), F.count("*").alias("texts")).first()
    vocabulary = build_vocabulary(counts, sizes.ends, sizes.texts)
    given = spark.sparkContext.broadcast(vocabulary)
    encoded = stored_once(encode_texts(docs, given), "hmm-symbols")
    model, _ = train(encoded, vocabulary, states, iterations)

    # rare words: their counts, and which of a held-out text's are unknown
    own = F.col("in_training") * OWN >= vocabulary.tokens
    bucket = F.pmod("word", F.lit(BUCKETS)).cast("int")
    in_bucket = spark.createDataFrame(
        pa.table({"bucket": np.arange(BUCKETS, dtype=np.int32), "mass": vocabulary.share[-1 - BUCKETS : -1] * vocabulary.mass})
    )
    listed = counts.where(~own).withColumn("bucket", bucket).join(F.broadcast(in_bucket), "bucket")
    seen = F.col("in_training") > 0  # a bucket without training words has no mass
    listed = listed.select("word", "in_training", F.when(seen, F.log10((F.col("in_training") + 0.5) / F.col("mass"))).alias("share"))
    rare = encoded.select("row", F.posexplode(F.arrays_zip("rare", "rare_n")).alias("place", "x"))
    rare = rare.select("row", "place", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    per_row = rare.join(listed, "word").groupBy("row").agg(
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((F.col("in_training") + 0.5) / vocabulary.mass)).alias("rare_base"),
        F.sum(F.when(seen, F.col("n") * F.col("share")).otherwise(0.0)).alias("rare_within"),
        F.collect_list(F.when(~seen, F.col("place"))).alias("unseen"),
    )
    per_row = stored_once(per_row, "hmm-rare")
    final = spark.sparkContext.broadcast(model)
    none = F.array().cast("array<int>")
    training = encoded.where(~F.col("held_out")).select("row", "symbols", "rare", none.alias("unseen"))
    rest = encoded.where("held_out").join(per_row.select("row", "unseen"), "row", "left")
    rest = rest.select("row", "symbols", "rare", F.coalesce("unseen", none).alias("unseen"))
    hidden = _score(training, final, vocabulary.unknown).unionByName(_score(rest, final, vocabulary.unknown))
    joined = encoded.drop("symbols", "rare", "rare_n").join(hidden, "row").join(per_row.drop("unseen"), "row", "left")

    def plus(name: str, extra: str) -> F.Column:
        return F.col(name) + F.coalesce(extra, F.lit(0))

    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "rare_known").alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"),
        (F.col("hidden") + plus("within", "rare_within")).alias("score"),
    )
