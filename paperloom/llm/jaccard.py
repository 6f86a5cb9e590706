"""Exact Jaccard join of shingle sets in the metric space of Jaccard distance.

Distance is one minus similarity; two sets link at a distance of ``1 - threshold`` or less.

Seeds. Unrelated texts are all at distance 1 of each other, so pivots drawn from everywhere
would tell none of them apart. Regions therefore start around shared rare shingles: sets that
link share one of the first ``n - ceil(threshold * n) + 1`` shingles of either in any common
order. The order puts shingles of locally frequent hash slots last, then follows the hash. The
first shingle that two linking sets share is, in the smaller one, even among the first
``(1 - threshold) / (1 + threshold) * n + 1``: a set stays in a region only if it, or a smaller
set of a fitting size, has the region's shingle that early. The seeds of two sets also bound
their distance from both sides, so whole sets are only compared where the seeds allow a link.
A sketch bounds it too: it counts the shingles of the whole set in ``BINS`` bins by their hash,
and two sets differ in at least as many shingles as their counts differ by.

Clubs. One pivot for each region comes first. Sets that share many regions with their pivot are
compared with it; what links forms clubs, across all regions. Regions within one club are done,
and no pair of one club is looked at again.

Large regions take pivots from their own sets, one for every ``PER_PIVOT``. A set's home is the
nearest pivot (its Voronoi cell). A set also goes to every cell whose pivot may be no further
than its home plus the link distance: of two partners, the one further from its home is then, by
the triangle inequality, in the home cell of the other. Sets that link to a pivot are connected
through it already; they stay only where a set outside that ball could still reach them, again
by the triangle inequality. What stays forms the next regions, as long as that leaves clearly
less to do. Regions that do not get smaller are split into blocks within windows of the set size.

Small regions are worked on in a task each, round by round: sets that may link by their sketches
form parts (a pair that meets in several regions counts in the first of them), each part takes a pivot, the distances to it are measured, and the next round leaves
out pairs that are connected through pivots or that the triangle inequality excludes. Nothing is
capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.words import shingle_sets
from paperloom.operators.joins import lookup_join
from paperloom.session import bound_batches, stored_once

#: Hash slots whose frequency orders shingles; the table of the frequent ones has no more rows.
SLOTS = 1 << 20
#: A slot is frequent in a task that meets it so often, and so many times more than the mean.
FREQUENT, OVER_MEAN = 16, 8
#: Sets of a region that one task works on, and of one pivot in larger regions.
BLOCK, PER_PIVOT, PIVOTS = 512, 4_096, 16
#: Sets of a region whose few pairs need no pivot.
TINY = 3
#: Rounds of pivots before large regions are split into blocks, and before small ones list
#: what is left; open pairs of a part that are listed at once.
ROUNDS, FEW = 4, 500
#: Large regions are split into blocks when a round of pivots leaves more than this share of rows.
SHRINK = 0.75
#: Rounds of one pivot a region, and the share of the smaller set's seeds that a set must have
#: in regions of its pivot to be compared with it then. It orders the work and loses nothing.
CLUB_ROUNDS, CLUB_SHARE = 2, 0.25
#: Shingles whose owners are multiplied at a time.
COLUMNS = 4_096
SLACK = 1e-9
#: Less than all regions, as good as surely: names for the sides of blocks among a set's regions.
LOWEST = -(1 << 63)
#: Bins of a sketch and of its coarse form, and pairs whose sketches are compared at a time.
BINS, COARSE, COMPARED = 256, 32, 1 << 14
#: Marks of shared seeds: those without a mark are in one set only and are not shuffled again.
MARKS = 1 << 26


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def frequent_slots(texts: DataFrame, words: int) -> np.ndarray:
    """A frequency class for every hash slot, 0 for all but the locally frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column("text"), words):
                np.add.at(seen, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        hot = np.flatnonzero(seen >= max(FREQUENT, OVER_MEAN * seen.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(seen[hot])], ["slot", "n"])

    found = (
        texts.select("text")
        .mapInArrow(count, "slot bigint, n bigint")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    classes = np.zeros(SLOTS, dtype=np.uint8)
    classes[found.column("slot").to_numpy()] = 1 + np.log2(found.column("n").to_numpy().astype(float)).astype(np.uint8)
    return classes


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles are in each bin, by hash bits that nothing else is chosen by; 255 is also more."""
    bins = (shingles >> np.uint64(40)).astype(np.int64) % BINS
    return np.minimum(np.bincount(bins, minlength=BINS), 255).astype(np.uint8).tobytes()


def unlike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that are in one set only, at least, of pairs of sketches (places of rows)."""
    out = [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(i), COMPARED):
        a, b = (sketches[x[k : k + COMPARED]].astype(np.int16) for x in (i, j))
        out.append(np.abs(a - b).sum(1, dtype=np.int64))
    return np.concatenate(out)


def near_pairs(sizes: np.ndarray, sketches: np.ndarray, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Those of the pairs (two columns) whose sketches allow a link; sums of bins tell most apart."""
    coarse = sketches.reshape(len(sketches), COARSE, -1).sum(2, dtype=np.int16)
    for drawn in (coarse, sketches):
        i, j = pairs[:, 0], pairs[:, 1]
        pairs = pairs[(100 + percent) * unlike(drawn, i, j) <= (100 - percent) * (sizes[i] + sizes[j])]
    return pairs


def _rows(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, BINS)


def shingled(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, copy, n, node, seeds, sketch``: set size, set hash, seed shingles and sketch of each text.

    A seed holds its frequency class in the top bits and its hash below; seeds are in order.
    """
    classes = frequent_slots(texts, words).astype(np.uint64) << np.uint64(56)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, seeds, ends, sketches = [], [], [], [0], []
            for s in shingle_sets(batch.column("text"), words):
                n = len(s)
                sizes.append(n)
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) if n else None)
                keys = classes[(s & np.uint64(SLOTS - 1)).astype(np.int64)] | (s >> np.uint64(8))
                count = n + (percent * n) // -100 + 1 if n else 0
                seeds.append(np.sort(np.partition(keys, count - 1)[:count]) if count < n else np.sort(keys))
                ends.append(ends[-1] + len(seeds[-1]))
                sketches.append(sketch(s))
            flat = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
            hashes = pa.array(nodes, pa.uint64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("copy"),
                    pa.array(sizes, pa.int64()),
                    hashes.view(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat))),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "copy", "n", "node", "seeds", "sketch"],
            )

    return texts.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(
        scan, "doc_id bigint, copy bigint, n bigint, node bigint, seeds array<bigint>, sketch binary"
    )


def sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, n, shingles`` of the wanted sets (``copy``: hash of a text that has the set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for i in range(0, len(batch), 256):
                nodes, found = [], []
                for s in shingle_sets(batch.column("text")[i : i + 256], words):
                    node = xxhash.xxh3_64_intdigest(s.tobytes())
                    if len(s) and node not in done:
                        done.add(node)
                        nodes.append(node)
                        found.append(s)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.uint64()).view(pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat))),
                    ],
                    ["node", "n", "shingles"],
                )

    wanted = stored_once(wanted.select("copy").distinct(), "wanted")
    read = texts.select("text", F.xxhash64("text").alias("copy"))
    held = lookup_join(read, wanted, ["copy"], ["text"], wanted.count()).select("text")
    schema = "node bigint, n bigint, shingles array<bigint>"
    return held.mapInArrow(scan, schema).dropDuplicates(["node"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pivot, node, n_pivot, n, both`` of distinct pairs; ``both``: shingles in common."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("theirs", "shingles")]
            flat = [np.asarray(x.flatten()).view(np.uint64) for x in lists]
            ends = [np.asarray(x.offsets) - x.offsets[0].as_py() for x in lists]
            both = [
                len(np.intersect1d(flat[0][ends[0][i] : ends[0][i + 1]], flat[1][ends[1][i] : ends[1][i + 1]], assume_unique=True))
                for i in range(len(batch))
            ]
            columns = [batch.column(c) for c in ("pivot", "node", "n_pivot", "n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(both, pa.int64())], ["pivot", "node", "n_pivot", "n", "both"]
            )

    pivots = sets.select(
        F.col("node").alias("pivot"), F.col("n").alias("n_pivot"), F.col("shingles").alias("theirs")
    )
    return (
        pairs.join(sets, "node")
        .join(pivots, "pivot")
        .select("pivot", "node", "n_pivot", "n", "theirs", "shingles")
        .mapInArrow(measure, "pivot bigint, node bigint, n_pivot bigint, n bigint, both bigint")
    )


def _seed_bounds(pairs: DataFrame, seeds: DataFrame, percent: int) -> DataFrame:
    """``pivot, node, n_pivot, n, least, shared`` of distinct pairs, from their seeds and sketches.

    At least ``least`` shingles are in one of the sets only, at least ``shared`` in both. Sets
    whose sizes alone forbid a link are not compared.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("theirs", "seeds")]
            flat = [np.asarray(x.flatten()).view(np.uint64) for x in lists]
            ends = [np.asarray(x.offsets) - x.offsets[0].as_py() for x in lists]
            least, shared = [], []
            drawn = _rows(batch.column("drawn").to_pylist() + batch.column("sketch").to_pylist())
            at = np.arange(len(batch))
            apart = unlike(drawn, at, at + len(batch)).tolist()
            for i in range(len(batch)):
                a, b = (f[e[i] : e[i + 1]] for f, e in zip(flat, ends, strict=True))
                upto = min(a[-1], b[-1])
                both = len(np.intersect1d(a, b, assume_unique=False))
                known = np.searchsorted(a, upto, "right") + np.searchsorted(b, upto, "right")
                least.append(max(apart[i], int(known) - 2 * both))
                shared.append(both)
            columns = [batch.column(c) for c in ("pivot", "node", "n_pivot", "n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(least, pa.int64()), pa.array(shared, pa.int64())],
                ["pivot", "node", "n_pivot", "n", "least", "shared"],
            )

    sizes = seeds.select(F.col("node").alias("pivot"), F.col("n").alias("n_pivot"))
    pairs = pairs.join(sizes, "pivot")
    alike = 100 * F.least("n", "n_pivot") >= percent * F.greatest("n", "n_pivot")
    differ = pairs.where(~alike).select(
        "pivot", "node", "n_pivot", "n", F.abs(F.col("n") - F.col("n_pivot")).alias("least"), F.lit(0).cast("bigint").alias("shared")
    )
    theirs = seeds.select(F.col("node").alias("pivot"), F.col("seeds").alias("theirs"), F.col("sketch").alias("drawn"))
    measured = (
        pairs.where(alike)
        .join(seeds.select("node", "seeds", "sketch"), "node")
        .join(theirs, "pivot")
        .select("pivot", "node", "n_pivot", "n", "theirs", "seeds", "drawn", "sketch")
        .mapInArrow(measure, "pivot bigint, node bigint, n_pivot bigint, n bigint, least bigint, shared bigint")
    )
    return measured.unionByName(differ)


def _sketched(pairs: DataFrame, seeds: DataFrame, percent: int) -> DataFrame:
    """Those of distinct pairs (``pivot, node, n``) that sizes and sketches allow to link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = _rows(batch.column("drawn").to_pylist() + batch.column("sketch").to_pylist())
            at = np.arange(len(batch))
            total = np.asarray(batch.column("n")) + np.asarray(batch.column("n_pivot"))
            near = (100 + percent) * unlike(drawn, at, at + len(batch)) <= (100 - percent) * total
            yield batch.select(["pivot", "node"]).filter(pa.array(near))

    pivots = seeds.select(F.col("node").alias("pivot"), F.col("n").alias("n_pivot"), F.col("sketch").alias("drawn"))
    alike = 100 * F.least("n", "n_pivot") >= percent * F.greatest("n", "n_pivot")
    return (
        pairs.join(pivots, "pivot")
        .where(alike)
        .join(seeds.select("node", "sketch"), "node")
        .select("pivot", "node", "n", "n_pivot", "drawn", "sketch")
        .mapInArrow(check, "pivot bigint, node bigint")
    )


def possible_pairs(sizes: np.ndarray, earlier: list[np.ndarray], sketches: np.ndarray, percent: int) -> np.ndarray:
    """All pairs (two columns) of a few sets that their sizes and sketches allow to link.

    Pairs that have met in an ``earlier`` region, one that both sets are in, are left to it.
    """
    fits = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    pairs = near_pairs(sizes, sketches, np.argwhere(np.triu(fits, 1)), percent)
    if not len(pairs):
        return pairs
    left, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape)
    earlier = [earlier[k] for k in left]
    flat, owner = np.concatenate(earlier), np.repeat(np.arange(len(earlier)), list(map(len, earlier)))
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    met = times[token] > 1
    kept, token = np.unique(token[met], return_inverse=True)
    owner, by_token = owner[met], np.argsort(token, kind="stable")
    owner, token = owner[by_token], token[by_token]
    apart = np.ones((len(left), len(left)), dtype=bool)
    for start in range(0, len(kept), COLUMNS):
        some = slice(*np.searchsorted(token, [start, start + COLUMNS]))
        held = np.zeros((len(left), min(COLUMNS, len(kept) - start)), dtype=np.float32)
        held[owner[some], token[some] - start] = 1
        apart &= held @ held.T == 0
    return pairs[apart[place[:, 0], place[:, 1]]]


def open_pairs(rows: pd.DataFrame, percent: int, list_all: bool) -> list[tuple[int, int, int, int]]:
    """(part, position, position, leader) of the pairs of a region to measure in this round.

    ``club`` names sets that are connected through pivots, ``d`` is the distance to the pivot
    of the last round, if known; ``own`` lists the regions of a set, of which ``origin`` is this
    one, and a pair is worked on in the first that both are in. Pairs of a part with few open pairs are all listed, else those
    with the part's pivot only.
    """
    far = 1 - percent / 100
    club, d = rows["club"].to_numpy(), rows["d"].to_numpy(dtype=float)
    origin = rows["origin"].iloc[0]
    earlier = [np.asarray(o, dtype=np.int64) for o in rows["own"]]
    earlier = [o[o < origin] for o in earlier]
    found = possible_pairs(rows["n"].to_numpy(), earlier, _rows(rows["sketch"]), percent)
    i, j = found[:, 0], found[:, 1]
    apart = np.abs(d[i] - d[j]) > far + SLACK  # false where a distance is not known
    pairs = found[(club[i] != club[j]) & ~apart].tolist()
    parts: dict[int, list[tuple[int, int]]] = {}
    lead = list(range(len(rows)))

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    for i, j in pairs:
        lead[top(i)] = top(j)
    for i, j in pairs:
        parts.setdefault(top(i), []).append((i, j))
    out = []
    for part, found in parts.items():
        if list_all or len(found) <= FEW:
            out.extend((part, i, j, 0) for i, j in found)
            continue
        uses = np.bincount(np.array(found).ravel())
        pivot = int(uses.argmax())
        out.extend((part, pivot, j if i == pivot else i, 1) for i, j in found if pivot in (i, j))
        # the sets that the pivot does not meet go on to the next round too
        rest = {k for pair in found for k in pair} - {k for i, j in found if pivot in (i, j) for k in (i, j)}
        out.extend((part, k, k, 1) for k in rest)
    return out


def _join_small(
    regions: DataFrame, seeds: DataFrame, texts: DataFrame, words: int, percent: int, split: DataFrame | None = None
) -> DataFrame:
    """Links ``a, b`` between clubs within small regions (``region, node, club``).

    A set is in fewer regions than it has seeds, but in very many blocks; of those the regions
    that were ``split`` are listed. Blocks have ``origin``, such a region, and ``sides``: sets
    that have a bit of it in common are worked on in another block.
    """

    def work(list_all: bool):
        names = ["region", "origin", "sides", "part", "pivot", "node", "pivot_club", "club", "again"]
        nothing = pd.DataFrame({c: np.zeros(0, dtype=bool if c == "again" else np.int64) for c in names})

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            if not rows["node"].is_unique:
                rows = rows.drop_duplicates("node")
            sides = rows["sides"].to_numpy()
            if sides.any():
                also = [[LOWEST + bit for bit in range(3) if side >> bit & 1] for side in sides.tolist()]
                own = [np.append(np.asarray(o, dtype=np.int64), np.array(x, dtype=np.int64)) for o, x in zip(rows["own"], also)]
                rows = rows.assign(own=own)
            out = open_pairs(rows, percent, list_all) if len(rows) > 1 else []
            if not out:
                return nothing
            nodes, clubs = rows["node"].to_numpy(), rows["club"].to_numpy()
            table = np.array(out, dtype=np.int64)
            return pd.DataFrame(
                {
                    "region": int(rows["region"].iloc[0]),
                    "origin": int(rows["origin"].iloc[0]),
                    "sides": sides[table[:, 2]],
                    "part": nodes[table[:, 0]],
                    "pivot": nodes[table[:, 1]],
                    "node": nodes[table[:, 2]],
                    "pivot_club": clubs[table[:, 1]],
                    "club": clubs[table[:, 2]],
                    "again": table[:, 3] > 0,
                }
            )

        return one

    schema = "region bigint, origin bigint, sides bigint, part bigint, pivot bigint, node bigint, pivot_club bigint, club bigint, again boolean"
    if split is None:
        split = regions
        regions = regions.withColumn("origin", F.col("region")).withColumn("sides", F.lit(0).cast("bigint"))
    members = regions.select("region", "origin", "sides", "node", "club", F.lit(None).cast("double").alias("d"))
    listed = split.groupBy("node").agg(F.collect_set("region").alias("own"))
    drawn = seeds.select("node", "n", "sketch").join(listed, "node")
    drawn = stored_once(drawn, "drawn")
    links = None
    for turn in range(ROUNDS + 1):
        filled = members.join(drawn, "node")
        asked = stored_once(filled.groupBy("region").applyInPandas(work(turn == ROUNDS), schema), "asked")
        pairs = asked.where(F.col("pivot") != F.col("node")).select("pivot", "node").distinct()
        exact = stored_once(exact_distances(pairs, seeds, texts, words, percent), "exact")
        found = exact.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        links = found if links is None else links.unionByName(found)
        more = asked.where("again")
        if turn == ROUNDS or not more.limit(1).count():
            return links
        measured = more.join(exact, ["pivot", "node"], "left")
        # sets near the pivot join its club; the pivot itself has met all it can link to
        club = F.when(F.col("near"), F.col("pivot_club")).otherwise(F.col("club"))
        members = stored_once(
            measured.select(F.xxhash64("region", "part").alias("region"), "origin", "sides", "node", club.alias("club"), "d"), "open"
        )
    return links


def _join_tiny(regions: DataFrame, seeds: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` between clubs in regions of ``TINY`` sets: three pairs at most, most shared."""
    other = regions.select("region", F.col("node").alias("pivot"), F.col("club").alias("pivot_club"))
    pairs = regions.select("region", "node", "n", "club").join(other, "region")
    pairs = pairs.where((F.col("pivot") < F.col("node")) & (F.col("club") != F.col("pivot_club")))
    possible = _sketched(stored_once(pairs.select("pivot", "node", "n").distinct(), "met"), seeds, percent)
    exact = stored_once(exact_distances(possible, seeds, texts, words, percent), "exact")
    return exact.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _by_blocks(regions: DataFrame, percent: int) -> DataFrame:
    """Regions that pivots do not part, as pairs of blocks of similar set size.

    Sets that link differ in size by a factor of ``100 / percent`` at most, so each belongs to
    its own band of sizes and the one above it; a band is compared block against block. ``sides``
    has a bit for sets from the band below, which meet in that one, and, where two blocks meet,
    one for the sets of either block, which meet in the block by itself.
    """
    home = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("long")
    bands = regions.withColumn("home", home).withColumn("band", F.explode(F.array("home", F.col("home") + 1)))
    parts = F.ceil(F.col("sets") / (BLOCK // 2)).cast("int")
    size = bands.groupBy("region", "band").agg(F.count("*").alias("sets"))
    below = F.when(F.col("band") > F.col("home"), 1).otherwise(0)
    half = F.when(F.col("own") < F.col("other"), 2).when(F.col("own") > F.col("other"), 4).otherwise(0)
    return (
        bands.join(size.select("region", "band", parts.alias("parts")), ["region", "band"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select(
            F.xxhash64("region", "band", "i", "j").alias("region"),
            F.col("region").alias("origin"),
            (below + half).cast("bigint").alias("sides"),
            "node",
            "club",
        )
    )


def _distinct_regions(regions: DataFrame) -> DataFrame:
    """Regions of two clubs or more; of those with the same sets, one: the shingles of a passage
    that several texts share all start the same region."""
    sums = regions.groupBy("region").agg(
        F.count("*").alias("size"),
        F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("sum"),
        F.min("club").alias("low"),
        F.max("club").alias("high"),
    )
    parted = sums.where(F.col("low") < F.col("high"))
    kept = parted.groupBy("size", "total", "sum").agg(F.min("region").alias("region"))
    return regions.join(kept.select("region", "size"), "region")


def marked(shared: DataFrame) -> np.ndarray:
    """A bit for every value of the low bits of a region, set for those of ``shared``."""
    slot = F.col("region").bitwiseAND(F.lit(MARKS - 1))
    bit = F.expr("shiftleft(1L, cast(region & 63 as int))")
    found = (
        shared.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()  # up to 2^20 rows, which as Python objects take the driver many times their bytes
    )
    bits = np.zeros(MARKS // 64, dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def _first_regions(seeded: DataFrame, percent: int) -> DataFrame:
    """``region, node, n``: sets by the seeds that they share, where those may be the first ones.

    Most seeds are in one set only. Those of the others are marked, so that few rows are shuffled
    a second time; a seed that has its mark by chance goes in the join.
    """
    seeded = seeded.where(F.col("n") > 0).select("node", "n", "seeds")
    rows = seeded.select("node", "n", F.posexplode("seeds").alias("pos", "region"))
    early = (100 + percent) * F.col("pos").cast("bigint") <= (100 - percent) * F.col("n")
    shared = rows.groupBy("region").agg(
        F.min("node").alias("low"),
        F.max("node").alias("high"),
        F.min(F.when(early, F.col("n"))).alias("least"),
        F.max(F.when(early, F.col("n"))).alias("most"),
    )
    # without an early set, least and most are null
    shared = shared.where((F.col("low") < F.col("high")) & F.col("least").isNotNull())
    shared = stored_once(shared.select("region", "least", "most"), "shared")
    bits = marked(shared)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                seeds = some.column("seeds")
                ends = np.asarray(seeds.offsets).astype(np.int64)
                flat, counts = np.asarray(seeds.flatten()), np.diff(ends)
                slots = flat.view(np.uint64) & np.uint64(MARKS - 1)
                held = (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) > 0
                at = np.flatnonzero(held)
                owner = np.repeat(np.arange(len(some)), counts)[at]
                n = np.asarray(some.column("n"))[owner]
                early = (100 + percent) * (at - (ends[:-1] - ends[0])[owner]) <= (100 - percent) * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[at]), pa.array(np.asarray(some.column("node"))[owner]), pa.array(n), pa.array(early)],
                    ["region", "node", "n", "early"],
                )

    found = seeded.mapInArrow(scan, "region bigint, node bigint, n bigint, early boolean")
    fits = (F.col("n") >= F.col("least")) & (percent * F.col("n") <= 100 * F.col("most"))
    return found.join(shared, "region").where(F.col("early") | fits).select("region", "node", "n").distinct()


def _club_links(members: DataFrame, seeds: DataFrame, texts: DataFrame, words: int, percent: int, turn: int) -> DataFrame:
    """Links ``a, b`` of sets with the pivot of many of their regions (``region, node, n, club``).

    The pivot is from the club that comes first by a hash, the same in all regions it is in.
    """
    rank = F.struct(F.xxhash64("club", F.lit(turn)).alias("by"), F.xxhash64("node", F.lit(turn)).alias("and"), "node", "club")
    pivots = members.groupBy("region").agg(F.min(rank).alias("first"))
    pivots = pivots.select("region", F.col("first.node").alias("pivot"), F.col("first.club").alias("pivot_club"))
    met = members.join(pivots, "region").where(F.col("club") != F.col("pivot_club"))
    pairs = met.groupBy("pivot", "node").agg(F.min("n").alias("n"), F.count("*").alias("times"))
    many = F.col("times") >= CLUB_SHARE * (100 - percent) / 100 * F.col("n")
    pairs = stored_once(pairs.where(many).select("pivot", "node", "n"), "met")
    possible = _sketched(pairs, seeds, percent)
    exact = stored_once(exact_distances(possible, seeds, texts, words, percent), "exact")
    return exact.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def links_of(seeded: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect the same sets as all linking pairs do.

    ``seeded`` is the table of ``shingled``. Pairs that link to a common pivot are not listed.
    """
    far = 1 - percent / 100
    first = _first_regions(seeded, percent)
    members = stored_once(first.withColumn("club", F.col("node")), "members")
    seeds = seeded.join(members.select("node").distinct(), "node").dropDuplicates(["node"])
    seeds = stored_once(seeds.select("node", "n", "copy", "seeds", "sketch"), "seeds")
    club_links = None
    for turn in range(CLUB_ROUNDS):
        found = _club_links(members, seeds, texts, words, percent, turn)
        club_links = found if club_links is None else club_links.unionByName(found)
        clubs = connected_components(club_links).withColumnRenamed("label", "new")
        named = members.join(clubs, "node", "left")
        named = named.select("region", "node", "n", F.coalesce("new", "club").alias("club"))
        parted = named.groupBy("region").agg(F.min("club").alias("low"), F.max("club").alias("high"))
        parted = parted.where(F.col("low") < F.col("high")).select("region")
        members = stored_once(named.join(parted, "region"), "clubs")
    members = stored_once(_distinct_regions(members), "regions")
    total = F.col("n") + F.col("n_pivot")
    links = club_links.unionByName(_join_tiny(members.where(F.col("size") <= TINY), seeds, texts, words, percent))
    small = members.where((F.col("size") > TINY) & (F.col("size") <= BLOCK))
    links = links.unionByName(_join_small(small, seeds, texts, words, percent))
    members = members.where(F.col("size") > BLOCK)
    rows = members.count()
    for turn in range(ROUNDS):
        if not rows:
            return links
        if not turn:  # few sets are in large regions
            large = stored_once(members.select("node").distinct(), "large-nodes")
            seeds = stored_once(lookup_join(seeds, large, ["node"], ["copy"], large.count()), "large")
        count = F.least(F.lit(PIVOTS), F.ceil(F.col("size") / PER_PIVOT)).cast("int")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), count)
        pivots = members.groupBy("region", slot.alias("slot")).agg(F.min("node").alias("pivot"))
        met = members.join(pivots.select("region", "pivot"), "region").where(F.col("node") != F.col("pivot"))
        met = stored_once(met, "met")
        pairs = met.select("pivot", "node", "n").distinct()
        bounds = stored_once(_seed_bounds(pairs, seeds, percent), "bounds")
        lower = 2 * F.col("least") / (total + F.col("least"))
        upper = 1 - F.col("shared") / (total - F.col("shared"))
        bounds = bounds.select("pivot", "node", lower.alias("lower"), upper.alias("upper"))
        possible = bounds.where(F.col("lower") <= far + SLACK).select("pivot", "node")
        exact = stored_once(exact_distances(possible, seeds, texts, words, percent), "exact")
        links = links.unionByName(exact.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        known = bounds.join(exact, ["pivot", "node"], "left").select(
            "pivot",
            "node",
            F.coalesce("d", "lower").alias("lower"),
            F.coalesce("d", "upper").alias("upper"),
            F.coalesce("near", F.lit(False)).alias("near"),
        )
        # pivots have met every set of their region and are done
        done = pivots.select("region", F.col("pivot").alias("node"))
        cells = met.join(known, ["pivot", "node"]).join(done, ["region", "node"], "left_anti")
        home = cells.groupBy("region", "node").agg(F.min("upper").alias("home"))
        cells = cells.join(home, ["region", "node"]).where(F.col("lower") <= F.col("home") + far + SLACK)
        outside = cells.where(~F.col("near")).groupBy("region", "pivot").agg(F.min("lower").alias("gap"))
        stay = cells.join(outside, ["region", "pivot"])
        stay = stay.where(~F.col("near") | (F.col("lower") >= F.col("gap") - far - SLACK))
        next_regions = stored_once(stay.select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "club"), "cells")
        members = stored_once(_distinct_regions(next_regions), "regions")
        links = links.unionByName(_join_small(members.where(F.col("size") <= BLOCK), seeds, texts, words, percent))
        members = members.where(F.col("size") > BLOCK)
        before, rows = rows, members.count()
        if rows > SHRINK * before:
            break
    if not rows:
        return links
    return links.unionByName(_join_small(_by_blocks(members, percent), seeds, texts, words, percent, split=members))


def exact_distances(pairs: DataFrame, seeds: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pivot, node, d, near`` of pairs, from their whole sets."""
    pairs = stored_once(pairs, "pairs")
    nodes = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    sets = stored_once(sets_of(texts, seeds.join(nodes, "node"), words), "sets")
    union = F.col("n") + F.col("n_pivot") - F.col("both")
    return _distances(pairs, sets).select(
        "pivot",
        "node",
        (1 - F.col("both") / union).alias("d"),
        (100 * F.col("both") >= percent * union).alias("near"),
    )


def jaccard_components(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, copy, group, n_shingles, component_id`` of every row.

    ``copy`` is the text's xxhash64, ``group`` names the component (null without shingles).

    ``component_id`` is the smallest id reachable over links of ``percent`` similarity or more.
    A null text counts as empty; empty texts and texts without words have no shingle and link
    with nothing, so they keep their own id. Equal texts, repeated rows included, link. A null
    id does not count as smallest; a group of nothing else has none. Other columns are ignored.
    """
    bound_batches(documents.sparkSession)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seeded = stored_once(shingled(texts, words, percent), "shingled")
    links = stored_once(links_of(seeded, texts, words, percent), "links")
    labels = connected_components(links)
    lowest = seeded.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("low"))
    # few sets have a label: the others are their own component
    grouped = labels.join(lowest, "node")
    reached = grouped.groupBy("label").agg(F.min("low").alias("reached"))
    reached = labels.join(reached, "label").select("node", "label", "reached")
    per_set = lowest.join(reached, "node", "left").select(
        "node", F.coalesce("label", "node").alias("group"), F.coalesce("reached", "low").alias("found")
    )
    return (
        seeded.select("doc_id", "copy", "n", "node")
        .join(per_set, "node", "left")
        .select(
            "doc_id",
            "copy",
            "group",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def without_copies(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """One document of every component, the one with the smallest id, with its own columns.

    Documents without words are no copies of each other and all stay. Of repeated rows, and of a
    group without any id, one row stays.
    """
    found = jaccard_components(documents, words, percent)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    # an id may come with different texts: both the id and the text say which row is meant
    kept = found.where(first).select(F.col("doc_id").alias("kept_id"), "copy", "group").distinct()
    lone = kept.where(F.col("group").isNotNull()).groupBy("kept_id", "group").agg(F.min("copy").alias("copy"))
    kept = kept.where(F.col("group").isNull()).unionByName(lone)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_copy"))
    same = F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_copy") == F.col("copy"))
    joined = rows.join(kept, same)
    place = Window.partitionBy("row_id", "row_copy").orderBy("row_id")
    counted = joined.withColumn("place", F.row_number().over(place))
    return counted.where(F.col("group").isNull() | (F.col("place") == 1)).select("row.*")
