"""Toxicity by compression distance: two zstandard dictionaries and calibrated lengths.

One dictionary is trained on ordinary text, one on the telling words of toxic text. A text is cut into overlapping
windows; each is compressed with the ordinary dictionary and with the toxic one laid before the
same ordinary content, so that a window without toxic wording takes the same bytes either way
and only toxic wording is cheaper. A logistic model, calibrated on labelled rows that trained no
dictionary, turns the savings into a score.

Bounds: the dictionaries see at most ``DICTIONARY_ROWS`` labelled rows of each class and the
calibration ``CALIBRATION_ROWS`` more, chosen by a hash of the id; of a text over ``FIT_CHARS``
characters fitting takes evenly spaced pieces. Of more than ``DICTIONARY_WINDOWS`` windows of
ordinary rows the dictionary is trained on evenly spaced ones, from all of the rows. Scoring
reads every window of every text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import bound_batches

WINDOW = 96
DICTIONARY_ROWS = 2_000
CALIBRATION_ROWS = 2_000
FIT_CHARS = 64_000
DICTIONARY_WINDOWS = 120_000
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 2_048
#: Byte n-grams that mark toxic wording.
GRAM = 5
#: Windows compressed in one call.
CALL = 2_000


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def train_toxicity(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the labelled rows whose crc32 of the id modulo 5 is not 0.

    Labels that are null or have no document teach nothing; a row labelled twice counts once.
    Without rows of both classes the model gives every text the share of toxic labels.
    """
    bound_batches(documents.sparkSession)
    key = F.col("doc_id").cast("string")
    taught = (
        labels.where(F.col("toxic").isin(0, 1) & (F.crc32(key) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = DICTIONARY_ROWS + CALIBRATION_ROWS
    chosen = [taught.where(F.col("toxic") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    found = (
        documents.select("doc_id", _pieces(F.col("text")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .select("doc_id", "toxic", "text")
        .dropDuplicates(["doc_id"])
        .orderBy(*order)
        .toArrow()
    )
    share = taught.agg(F.avg("toxic")).first()[0]
    rows = list(zip(found.column("text").to_pylist(), found.column("toxic").to_pylist(), strict=True))
    return fit(rows, 0.5 if share is None else float(share))


def _pieces(text: Column) -> Column:
    """The text, or 64 evenly spaced pieces of a longer one."""
    size, piece = F.length(text), FIT_CHARS // 64
    starts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * size / 64).cast("int") + 1)
    cut = F.array_join(F.transform(starts, lambda s: F.substring(text, s, F.lit(piece))), "\n")
    return F.coalesce(F.when(size > FIT_CHARS, cut).otherwise(text), F.lit(""))


def fit(rows: list[tuple[str, int]], share: float) -> ToxicityModel:
    by_class = [[t for t, c in rows if c == k] for k in (0, 1)]
    trained, spare = [], []
    for texts in by_class:
        cut = min(DICTIONARY_ROWS, max(1, len(texts) * 2 // 3))
        trained.append(texts[:cut])
        spare.append(texts[cut:])
    if not all(spare):
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return ToxicityModel(b"", b"", (float(odds),))
    seen = [w for t in trained[0] for w in windows(t)]
    ordinary = _dictionary(seen[:: -(-len(seen) // DICTIONARY_WINDOWS) or 1], ORDINARY_BYTES)
    toxic = _dictionary(_toxic_wording(*trained), TOXIC_BYTES)
    model = ToxicityModel(ordinary, toxic, ())
    texts = spare[0] + spare[1]
    x = np.array([f for f in features(model, texts)])
    y = np.repeat([0.0, 1.0], [len(spare[0]), len(spare[1])])
    # classes as frequent as among the labels, whatever was drawn of each
    balance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return ToxicityModel(ordinary, toxic, _logistic(x, y, balance))


def _toxic_wording(ordinary: list[str], toxic: list[str]) -> list[bytes]:
    """Of each toxic text, the words that tell most, as many different ones as fill the dictionary.

    A word tells how unlikely its best n-gram is as often in toxic rows, were it as frequent there
    as in ordinary ones (a Poisson deviance); words that chance explains among so many tell nothing.
    """
    counts = [Counter(g for t in texts for g in set().union(*map(_grams, _words(t)))) for texts in (ordinary, toxic)]

    def told(gram: bytes) -> float:
        n, expected = counts[1][gram], (counts[0][gram] + 0.5) * len(toxic) / len(ordinary)
        return float(n * np.log(n / expected) - n + expected) if n > expected else 0.0

    words = {w for t in toxic for w in _words(t) if len(w) + 2 >= GRAM}
    ranked = {w: max(map(told, _grams(w))) for w in words}
    marked, size = set(), 0
    for w in sorted(ranked, key=lambda w: (-ranked[w], w)):
        if size >= TOXIC_BYTES or ranked[w] <= np.log(len(counts[1])):
            break
        marked.add(w)
        size += len(w) + 1
    kept = ([w for w in _words(t) if w in marked] for t in toxic)
    return [b" " + b" ".join(words) + b" " for words in kept if words]


def _words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x20]+", _bytes(text))


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(text: str) -> list[bytes]:
    """All windows of the text; each shares half with the next."""
    data = _bytes(text)
    if len(data) <= WINDOW:
        return [data] if data else []
    return [data[i : i + WINDOW] for i in range(0, len(data) - WINDOW // 2, WINDOW // 2)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    made = []
    for content in (ordinary, toxic + ordinary):
        settings = zstandard.ZstdCompressionParameters(
            window_log=17,
            hash_log=15,
            chain_log=15,
            search_log=5,
            min_match=4,
            target_length=16,
            strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings))
    return tuple(made)


def savings(model: ToxicityModel, parts: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    lengths = []
    for compressor in _compressors(model.ordinary, model.toxic):
        sizes: list[int] = []
        for i in range(0, len(parts), CALL):
            sizes.extend(map(len, compressor.multi_compress_to_buffer(parts[i : i + CALL], threads=1)))
        lengths.append(np.array(sizes, dtype=np.int64))
    return lengths[0] - lengths[1]


def features(model: ToxicityModel, texts: Iterable[str]) -> Iterator[tuple[float, ...]]:
    for text in texts:
        parts = windows(text)
        if not parts:
            yield (0.0, 0.0, 0.0, 0.0, 0.0)
            continue
        saved = savings(model, parts)
        best = np.sort(saved)[::-1][:3]
        mean, most, top = float(saved.mean()), float(best[0]), float(best.sum())
        yield (min(mean, 8.0), most, top, float((saved >= 3).mean()), float(np.log(len(parts))))


def _logistic(x: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    mid, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mid) / spread])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (balance * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (balance * (y - p)) - ridge @ w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / spread
    return (float(w[0] - slopes @ mid), *map(float, slopes))


def score_text(model: ToxicityModel, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, slopes = model.weights[0], np.array(model.weights[1:])
        for texts in batches:
            if not len(slopes):
                logits = np.full(len(texts), bias)
            else:
                x = np.array(list(features(model, texts)), dtype=float).reshape(-1, len(slopes))
                logits = bias + x @ slopes
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return scores(F.coalesce(text, F.lit("")))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, repeated rows included.

    Null and empty texts get the score of a text without windows. A null id is not held out
    and teaches nothing. Other columns are ignored, whatever their names.
    """
    model = train_toxicity(documents, labels)
    return documents.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        score_text(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
