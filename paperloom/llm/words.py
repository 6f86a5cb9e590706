"""Hashes of the words of whole Arrow batches, computed with array operations.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A word's hash is a polynomial in its bytes modulo 2^64 followed by an
avalanche step; words, shingles and sets are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; a longer document is cut between words.
PIECE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits, for words without their punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _values() -> np.ndarray:
    """A number for each byte, the same for both cases of a letter."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        run = np.full(size, base, dtype=np.uint64)
        run[0] = 1
        out.append(np.multiply.accumulate(run))
    return tuple(out)


def _hash_piece(data: np.ndarray, breaks: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word; no word goes over a break."""
    blank = blanks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[breaks] = True
    before = np.concatenate([[True], blank[:-1]]) | first[:-1]
    after = np.concatenate([blank[1:], [True]]) | first[1:]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    powers, inverses = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_values()[data] * powers[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64))


def _cuts(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Offsets of documents, and more of them between words inside long ones."""
    long = np.flatnonzero(np.diff(offsets) > PIECE)
    if not len(long):
        return offsets
    more = []
    for i in long:
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > PIECE:
            window = np.flatnonzero(blanks[data[at + PIECE // 2 : at + PIECE]])
            if len(window):
                at = at + PIECE // 2 + int(window[-1]) + 1
            else:  # a word longer than a piece stays whole
                rest = np.flatnonzero(blanks[data[at + PIECE : end]])
                at = at + PIECE + int(rest[0]) + 1 if len(rest) else end
            more.append(at)
    return np.unique(np.concatenate([offsets, more]))


def word_hashes(texts: pa.Array, blanks: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: the first one's index, word hashes, and each one's first word.

    The last array has one entry more than the run has documents. Nulls count as empty.
    """
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        own = offsets[i : j + 1]
        cuts = _cuts(data, own, blanks)
        parts, places = [], []
        k = 0
        while k < len(cuts) - 1:
            m = max(k + 1, int(np.searchsorted(cuts, cuts[k] + PIECE, side="right")) - 1)
            at, end = int(cuts[k]), int(cuts[m])
            if end > at:
                with np.errstate(over="ignore"):
                    starts, hashes = _hash_piece(data[at:end], cuts[k : m + 1] - at, blanks)
                parts.append(hashes)
                places.append(starts + at)
            k = m
        hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        starts = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        yield i, hashes, np.searchsorted(starts, own)
        i = j


_ROLES = [np.uint64(m) for m in (0x8BB84B93962EACC9, 0x4B33A62ED433D4A3, 0x4D5A2DA51DE1AA47, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashes of its runs of ``size`` words.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    with np.errstate(over="ignore"):
        for _, words, first in word_hashes(texts):
            runs = max(0, len(words) - size + 1)
            total = np.zeros(runs, dtype=np.uint64)
            for k in range(size):
                total += words[k : k + runs] * _ROLES[k]
            shingles = mix(total)
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a >= size:
                    yield np.unique(shingles[a : b - size + 1])
                elif b > a:
                    short = np.uint64(b - a)
                    for k, w in enumerate(words[a:b]):
                        short = short * _ROLES[-1] + w * _ROLES[k]
                    yield mix(np.array([short], dtype=np.uint64))
                else:
                    yield np.zeros(0, dtype=np.uint64)
