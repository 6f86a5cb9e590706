"""Alignment of two tokenizers: which ids of one cover which ids of the other, and how often.

A text is cut where tokens of both vocabularies end at the same byte. Most of the groups so made
are one token on either side with the same bytes. Which token of the second vocabulary has the
bytes of a token of the first is known before any text is read, so such groups are counted in a
vector as long as the first vocabulary; only the links of all other groups are counted as pairs.

Three passes over what is stored, none of which holds a table that grows with the corpus:

1. every text is encoded once; a row keeps its ids of matching groups and its other pairs, each
   once with its number;
2. both are summed, first within a task, then over all;
3. a row looks its pairs up. The frequent ones, at most ``FREQUENT`` by the way they are chosen,
   go to every task; each of the others makes up less than a millionth of all, so the join that
   finds them has no hot key.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.session import stored_once

#: Pairs that every task is given: those that make up at least one in so many links.
FREQUENT = 1 << 19
#: Words whose ids a worker keeps, characters encoded at a time, pairs a task counts before it emits.
KEPT_WORDS, PIECE, KEPT_PAIRS = 400_000, 1 << 20, 1 << 20

_SPACED = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")

ENCODED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "same array<int>, same_n array<int>, pairs array<bigint>, pairs_n array<int>"
)


def default_vocabularies() -> tuple[str, str]:
    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and all others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Vocabularies:
    """Both tokenizers, the bytes of all their tokens, and the token of B with the bytes of one of A."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        char, size = _byte_of_char(), self.a.get_vocab_size()
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            known = all(c in char for c in token)
            self.bytes_a[i] = bytes(char[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        first: dict[bytes, int] = {}
        for i in sorted(range(len(pieces)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                first.setdefault(self.bytes_b[i], i)
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        self.space = pieces.index("▁")
        # words can be encoded one by one if no piece holds a space behind another character
        self.by_words = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.len_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)


class Store:
    """Ids of both vocabularies for the words that a worker has met.

    A word is a stretch of a text that begins with a single space, or the line feed that ends a
    line: neither vocabulary has a token over such a place. Its key leaves the leading space out,
    unless the rest would begin with a space or a line feed as well.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.known = Vocabularies(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.start = [array("q", [0]), array("q", [0])]
        self.ids = [array("i"), array("i")]
        self.good = array("b")

    def forget(self) -> None:
        """Keep what came first, as frequent words do."""
        keep = KEPT_WORDS // 2
        self.places = dict(islice(self.places.items(), keep))
        for start, ids in zip(self.start, self.ids, strict=True):
            del start[keep + 1 :]
            del ids[start[-1] :]
        del self.good[keep:]

    def words_of(self, text: str) -> list[str]:
        """Keys of the words of a space and the text."""
        if not text:
            return []
        if not self.known.by_words:
            return [text if text[0] not in " \n" else " " + text]
        plain = (
            text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and "\n\n" not in text
            and " \n" not in text and "\n " not in text and not _OTHER_SPACE.search(text)
        )
        if plain:
            return text.replace("\n", " \n").split(" ")
        return [w if w[0] not in " \n" else " " + w for w in _SPACED.split(text)]

    def learn(self, words: list[str]) -> None:
        known = self.known
        for i in range(0, len(words), 8192):
            keys = words[i : i + 8192]
            full = [w if w[0] in " \n" else " " + w for w in keys]
            of_a = [e.ids for e in known.a.encode_batch_fast(full, add_special_tokens=False)]
            # B puts a space before what it is given
            of_b = known.b.encode([w[1:] if w[0] == " " else w for w in full], num_threads=1)
            of_b = [ids if w[0] == " " else ids[1:] for ids, w in zip(of_b, full, strict=True)]
            self.good.extend(self._gives_back(full, of_a, of_b))
            self.places.update(zip(keys, range(len(self.start[0]) - 1, len(self.start[0]) - 1 + len(keys)), strict=True))
            for side, found in enumerate((of_a, of_b)):
                self.start[side].extend(accumulate(map(len, found), initial=self.start[side].pop()))
                self.ids[side].extend(chain.from_iterable(found))

    def _gives_back(self, full: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of either side give the bytes of each word."""
        want = [w.encode() for w in full]
        sides = ((of_a, self.known.bytes_a), (of_b, self.known.bytes_b))
        sizes = [[sum(map(len, map(known.__getitem__, ids))) for ids in found] for found, known in sides]
        total = b"".join(want)
        if all(x == list(map(len, want)) for x in sizes) and all(
            b"".join(map(known.__getitem__, chain.from_iterable(found))) == total for found, known in sides
        ):
            return [True] * len(full)
        return [all(b"".join([known[k] for k in found[i]]) == w for found, known in sides) for i, w in enumerate(want)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per vocabulary the ids of all texts and how many each text has; both 0 for a text whose
        tokens do not give its bytes."""
        if len(self.places) > KEPT_WORDS:
            self.forget()
        lists = [self.words_of(t) for t in texts]
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        found = pa.array(list(chain.from_iterable(lists)), pa.large_string()).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.places])
        places = np.array([self.places[w] for w in distinct], dtype=np.int64)[found.indices.to_numpy()]
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[np.frombuffer(self.good, dtype=np.int8)[places] == 0]] = True
        kept = ~bad[owner]
        places, owner = places[kept], owner[kept]
        result = []
        for start, ids in zip(self.start, self.ids, strict=True):
            starts, flat = np.frombuffer(start, dtype=np.int64), np.frombuffer(ids, dtype=np.int32)
            first, sizes = starts[places], starts[places + 1] - starts[places]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            taken = flat[np.arange(total) + np.repeat(first - (ends - sizes), sizes)] if total else np.zeros(0, np.int32)
            result.append((taken, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)))
        return result


@functools.lru_cache(maxsize=1)
def store(path_a: str, path_b: str) -> Store:
    return Store(path_a, path_b)


def _joined(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Decimal ids of each stretch, comma-joined."""
    names = pc.cast(pa.array(ids, pa.int32()), pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), names), ",")


def _per_owner(owner: np.ndarray, value: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values under ``size`` per owner, their numbers, and where each owner's begin."""
    key = np.sort(owner * size + value)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(at, len(key)))
    found = key[at]
    return found % size, n, np.searchsorted(found, np.arange(rows + 1) * size)


def align(texts: list[str], paths: tuple[str, str]) -> dict[str, pa.Array]:
    """The columns of ``ENCODED`` behind ``doc_id`` for some texts."""
    kept = store(*paths)
    (ids_a, n_a), (ids_b, n_b) = kept.encode(texts)
    known, rows = kept.known, len(texts)
    end_a, end_b = np.cumsum(known.len_a[ids_a]), np.cumsum(known.len_b[ids_b])
    # both cover the same bytes, so every stretch between two ends lies in one token of either
    mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=np.int8)
    mark[end_a] = 1
    mark[end_b] += 2
    ends = np.flatnonzero(mark)
    mark = mark[ends]
    is_cut = mark == 3
    at_a, at_b = np.cumsum(mark & 1), np.cumsum(mark >> 1)
    before = np.concatenate([[0], np.cumsum(is_cut)])
    group = before[:-1]
    link_a = ids_a[at_a - (mark & 1)].astype(np.int64)
    link_b = ids_b[at_b - (mark >> 1)].astype(np.int64)
    # where the links and the groups of each text end
    text_end = np.concatenate([[0], end_a])[np.cumsum(n_a)] if len(end_a) else np.zeros(rows, np.int64)
    upto = np.searchsorted(ends, text_end, side="right")
    n_links, n_groups = np.diff(upto, prepend=0), np.diff(before[upto], prepend=0)
    owner = np.repeat(np.arange(rows), n_links)
    alone = np.bincount(group, minlength=1)[group] == 1
    matched = alone & (known.same[link_a] == link_b)
    size_a, size_b = len(known.len_a), len(known.len_b)
    same, same_n, same_at = _per_owner(owner[matched], link_a[matched], size_a, rows)
    pairs, pairs_n, pairs_at = _per_owner(owner[~matched], (link_a * size_b + link_b)[~matched], size_a * size_b, rows)

    bounds_a, bounds_b = (np.concatenate([[0], x[is_cut]]) for x in (at_a, at_b))
    both = pc.binary_join_element_wise(_joined(ids_a, bounds_a), _joined(ids_b, bounds_b), "|")
    per_text = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), both)
    digests = [
        hashlib.sha256(memoryview(s.as_buffer())).hexdigest() if n else ""
        for s, n in zip(pc.binary_join(per_text, ";"), n_groups, strict=True)
    ]

    def lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))

    return {
        "n_a": pa.array(n_a, pa.int64()),
        "n_b": pa.array(n_b, pa.int64()),
        "n_groups": pa.array(n_groups, pa.int64()),
        "n_links": pa.array(n_links, pa.int64()),
        "groups_sha256": pa.array(digests, pa.string()),
        "same": lists(same_at, same, pa.int32()),
        "same_n": lists(same_at, same_n, pa.int32()),
        "pairs": lists(pairs_at, pairs, pa.int64()),
        "pairs_n": lists(pairs_at, pairs_n, pa.int32()),
    }


def encode_documents(documents: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``ENCODED`` of every document; ``row`` tells rows with one id apart once it is stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40

        def one(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            columns = {"row": pa.array(range(row, row + len(texts)), pa.int64()), "doc_id": ids}
            columns.update(align(texts, paths))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            run, size, done = [], 0, 0
            for text in batch.column("text"):
                run.append(text.as_py() or "")
                size += len(run[-1])
                if size >= PIECE:
                    yield one(batch.column("doc_id").slice(done, len(run)), run)
                    row, done = row + len(run), done + len(run)
                    run, size = [], 0
            if run:
                yield one(batch.column("doc_id").slice(done), run)
                row += len(run)

    return documents.select("doc_id", "text").mapInArrow(encode, ENCODED)


def pair_counts(encoded: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``a, b, n``: how many links of all texts hold A's id ``a`` and B's id ``b``.

    Matching groups are summed in one vector per task, other pairs in a sorted table that is
    emitted whenever it is full.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = store(*paths).known
        same, size_b = known.same, len(known.len_b)
        vector = np.zeros(len(same), dtype=np.int64)
        keys, sums, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(at, weights=np.concatenate(sums), minlength=len(found)).astype(np.int64)

        def emit(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "a": pa.array(found // size_b, pa.int32()),
                "b": pa.array(found % size_b, pa.int32()),
                "n": pa.array(n, pa.int64()),
            })

        for batch in batches:
            ids = batch.column("same").flatten().to_numpy()
            vector += np.bincount(ids, weights=batch.column("same_n").flatten().to_numpy(), minlength=len(same)).astype(np.int64)
            keys.append(batch.column("pairs").flatten().to_numpy())
            sums.append(batch.column("pairs_n").flatten().to_numpy().astype(np.int64))
            size += len(keys[-1])
            if size > KEPT_PAIRS:
                found, n = merged()
                if len(found) > KEPT_PAIRS // 2:
                    yield emit(found, n)
                    found, n = found[:0], n[:0]
                keys, sums, size = [found], [n], len(found)
        seen = np.flatnonzero(vector)
        yield emit(seen * size_b + same[seen], vector[seen])
        if size:
            yield emit(*merged())

    counted = encoded.select("same", "same_n", "pairs", "pairs_n").mapInArrow(count, "a int, b int, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _frequent_pairs(counts: DataFrame, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, numbers and whether the number is its B id's highest, for pairs that are one in
    ``FREQUENT`` links: by that choice at most ``FREQUENT`` of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") * FREQUENT >= total).toArrow()
    key = found.column("a").to_numpy().astype(np.int64) * size_b + found.column("b").to_numpy()
    order = np.argsort(key)
    return key[order], found.column("n").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]


def align_tokens(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros
    and an empty digest. Rows with the same id, or equal ones, each give a row and each count.
    A null id is kept. An empty table gives no rows. Other columns are ignored. A text of any
    length is encoded whole.
    """
    paths = vocabularies or default_vocabularies()
    spark: SparkSession = documents.sparkSession
    encoded = stored_once(encode_documents(documents, paths), "aligned")
    counts = stored_once(pair_counts(encoded, paths), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    # one row per id of B
    counts = stored_once(
        counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best")),
        "pair-ranks",
    )
    size_b = len(store(*paths).known.len_b)
    frequent = spark.sparkContext.broadcast(_frequent_pairs(counts, size_b))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_b = store(*paths).known.same
        keys, numbers, best = frequent.value
        for batch in batches:
            rows = batch.num_rows
            parts = []
            for name in ("same", "pairs"):
                values = batch.column(name)
                owner = np.repeat(np.arange(rows), np.diff(values.offsets.to_numpy()))
                key = values.flatten().to_numpy().astype(np.int64)
                key = key * size_b + same_b[key] if name == "same" else key
                parts.append((owner, key, batch.column(f"{name}_n").flatten().to_numpy().astype(np.int64)))
            owner, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.searchsorted(keys, key)
            hit = np.zeros(len(key), dtype=bool)
            inside = at < len(keys)
            hit[inside] = keys[at[inside]] == key[inside]
            there, good = at[hit], owner[hit]
            count_sum, n_best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(count_sum, good, numbers[there] * n[hit])
            np.add.at(n_best, good, best[there] * n[hit])
            rare = np.bincount(owner[~hit], minlength=rows)
            upto = pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32())
            order = np.argsort(owner[~hit], kind="stable")
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"),
                "count_sum": pa.array(count_sum),
                "n_best": pa.array(n_best),
                "rare": pa.ListArray.from_arrays(upto, pa.array(key[~hit][order], pa.int64())),
                "rare_n": pa.ListArray.from_arrays(upto, pa.array(n[~hit][order], pa.int64())),
            })

    looked_up = stored_once(
        encoded.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(
            look_up, "row bigint, count_sum bigint, n_best bigint, rare array<bigint>, rare_n array<bigint>"
        ),
        "pairs-found",
    )
    rare = looked_up.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(
        "row",
        F.expr(f"x.rare div {size_b}").cast("int").alias("a"),
        (F.col("x.rare") % size_b).cast("int").alias("b"),
        F.col("x.rare_n").alias("m"),
    )
    from_join = rare.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("n") * F.col("m")).alias("rare_sum"), F.sum(F.col("best").cast("bigint") * F.col("m")).alias("rare_best")
    )
    found = looked_up.select("row", "count_sum", "n_best").join(from_join, "row", "left")
    found = found.select(
        "row",
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
    )
    return encoded.join(found, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
