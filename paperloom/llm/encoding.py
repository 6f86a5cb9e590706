"""Token ids by the ``tokenizers`` library, with the ids of frequent words kept per worker.

The byte-level pattern of these vocabularies never takes a token over a single space between
two characters that are not white space, nor over a single line feed between such characters,
nor from a run of letters to the mark behind it. A text is therefore encoded as its words, each
with the space or line feed before it, and a word that a worker has met before needs no second
encoding. Words that it has not met are encoded many at a time, as one text. The ids are those
of the whole text; ``tests/llm`` compares them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Appended to every document.
END = 2
#: Words that a worker keeps, and characters that it encodes at a time.
KEPT_WORDS, PIECE = 800_000, 6 << 20
#: New words that are encoded as one text, and words whose ids are copied at a time.
JOINED, COPIED = 1_024, 1 << 18

#: White space other than space and line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks the first word of a text; no other word can begin with it.
FIRST = "\n\n"
#: Marks what follows letters without a space; a plain text has no tab.
BEHIND, _CUT = "\t", "([A-Za-z])([!-/:-@\\[-`{-~])"
_MARK, _SPACE = "^(\n\n|\n|\t)", "^$|[\\s\x0b\x1c-\x1f\u0085\\pZ]"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _is_plain(text: str) -> bool:
    """Whether all white space is single spaces and single line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return not _OTHER_SPACE.search(text)


def default_vocabulary() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds one of their strings is encoded whole
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin with a space (byte-level vocabularies write it as U+0120), or a line feed.
        self.begins = {mark: np.zeros(max(vocabulary.values()) + 1, dtype=bool) for mark in " \n"}
        self.begins[" "][[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.begins["\n"][[i for token, i in vocabulary.items() if token == "\u010a"]] = True
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Drop what came last: frequent words come early."""
        keep = KEPT_WORDS // 2
        self.words = pa.concat_arrays([self.words[:keep]])
        self.starts = self.starts[: keep + 1].copy()
        self.ids = self.ids[: self.starts[-1]].copy()

    def _keep(self, words: pa.Array, sizes: list[np.ndarray], ids: list[np.ndarray]) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.cumsum(np.concatenate([[0], np.diff(self.starts), *sizes]), dtype=np.int64)
        self.ids = np.concatenate([self.ids, *ids])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _encode_joined(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of words without white space, each behind its mark, all as one text.

        The mark is a space or a line feed, so the ids that begin with it are where the words
        begin; None if they are not as many as words.
        """
        ids = self._ids(mark + mark.join(words))
        at = np.flatnonzero(self.begins[mark][ids])
        if len(at) != len(words) or at[0]:
            return None
        return np.diff(at, append=len(ids)), ids

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Keep the ids of words and say which places they have: a text's first one is marked by two line feeds, one after a line
        feed begins with it, what is behind letters is marked by a tab, all others follow a space."""
        bodies = pc.replace_substring_regex(words, _MARK, "", max_replacements=1)
        spaced = np.asarray(pc.match_substring_regex(bodies, _SPACE))
        marked = np.asarray(pc.not_equal(pc.binary_length(bodies), pc.binary_length(words)))
        order = [np.flatnonzero(x) for x in (~spaced & ~marked, ~spaced & marked, spaced)]
        kinds = [words.take(pa.array(x)) for x in order]
        bodies = [bodies.take(pa.array(x)) for x in order]
        sizes, ids, places = [], [], np.empty(len(words), dtype=np.int64)
        places[np.concatenate(order)] = len(self.words) + np.arange(len(words))
        for kind, some in enumerate(kinds):
            for i in range(0, len(some), JOINED):
                part = some[i : i + JOINED].to_pylist()
                # a word without the line feed is encoded behind one, which is then taken off
                bare = np.array([w[:2] == FIRST or w[0] == BEHIND for w in part], dtype=np.int64)
                joined = None if kind == 2 else self._encode_joined(bodies[kind][i : i + JOINED].to_pylist(), " \n"[kind])
                if joined is None:
                    texts = [w[2:] if w[:2] == FIRST else w[1:] if w[0] == BEHIND else w if w[0] == "\n" else " " + w for w in part]
                    found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    joined = np.array(list(map(len, found))), np.array([x for f in found for x in f], dtype=np.int32)
                elif kind == 1:
                    begin = np.cumsum(joined[0]) - joined[0]
                    joined = joined[0] - bare, np.delete(joined[1], begin[bare > 0])
                sizes.append(joined[0])
                ids.append(joined[1])
        self._keep(pa.concat_arrays(kinds), sizes, ids)
        return places

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of every word; each distinct one is looked up once."""
        found = words.dictionary_encode()
        known = pc.index_in(found.dictionary, value_set=self.words)
        new = np.asarray(pc.is_null(known))
        places = np.asarray(pc.fill_null(known, 0), dtype=np.int64)
        if new.any():
            places[new] = self._learn(found.dictionary.filter(pa.array(new)))
        return places[found.indices.to_numpy()]

    def _copied(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of all words, in order."""
        out = [np.zeros(0, np.int32)]
        for i in range(0, len(places), COPIED):
            first, size = self.starts[places[i : i + COPIED]], sizes[i : i + COPIED]
            ends = np.cumsum(size)
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)])
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text begins."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        plain, split = [], []
        for text in texts:
            whole = any(a in text for a in self.added)
            easy = not text or not whole and _is_plain(text)
            plain.append(FIRST + text.replace("\n", " \n") if text and easy else None)
            split.append(None if easy else [FIRST + text] if whole else _SAFE.split(FIRST + text))
        cut = pc.replace_substring_regex(pa.array(plain, pa.large_string()), _CUT, f"\\1 {BEHIND}\\2")
        del plain
        lists = [pc.split_pattern(cut, " "), pa.array(split, pa.large_list(pa.large_string()))]
        counts = [np.asarray(pc.fill_null(pc.list_value_length(x), 0), dtype=np.int64) for x in lists]
        words = pa.concat_arrays([x.flatten() for x in lists])
        del cut, split, lists
        places = self._places(words)
        del words
        if counts[1].any():  # back into the order of the texts
            size = counts[0] + counts[1]
            begin = np.where(counts[1] > 0, counts[0].sum() + np.cumsum(counts[1]) - counts[1], np.cumsum(counts[0]) - counts[0])
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            places = places[np.repeat(begin, size) + inner]
        sizes = np.diff(self.starts)[places]
        ends = np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
        return self._copied(places, sizes), np.concatenate([[0], ends])[upto].astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_runs(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and beginnings of runs of texts; a run has about ``PIECE`` characters or one text."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= PIECE:
            yield _encoded(run, path)
            run, size = [], 0
    if run:
        yield _encoded(run, path)


def _encoded(run: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The encoded run; a worker outlives it, so what Arrow holds in reserve is given back."""
    found = encoder(path).encode(run)
    pa.default_memory_pool().release_unused()
    return found


def count_tokens(text: Column, path: str) -> Column:
    """How many ids a text has, without an end id; a null text has none."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = [np.diff(upto) for _, upto in encode_runs(texts, path)]
            yield pa.array(np.concatenate(sizes) if sizes else [], pa.int64())

    return count(F.coalesce(text, F.lit("")))
