"""Mix sources to target weights by histograms of hashed documents.

Every document has a 60-bit hash. Words are summed by source and hash bucket; the bucket in which
a source's budget ends is refined into finer buckets, and only its documents are counted again,
until the bound is a single hash value. The mix is then a filter on the hash: nothing is sorted,
a rerun takes the same documents, and a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.joins import lookup_join
from paperloom.session import stored_once

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Bits of the hash, and bits that one level of the histogram tells apart.
BITS, LEVEL = 60, 12

KEY = ["source_name", "no_source"]


def _hash() -> Column:
    text = F.md5(F.coalesce("text", F.lit("")))
    seed = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(seed), 1, BITS // 4), 16, 10).cast("bigint")


def _key() -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias(KEY[0]), F.col("source").isNull().alias(KEY[1])]


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, hash`` of every document and the join key of its source."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select(
        "doc_id", "source", words.cast("bigint").alias("size"), _hash().alias("hash"), *_key()
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """``source_name, no_source, source_size, target``, one row per source.

    Sources are ranked by code point with the null source last: within ranges of names, and
    the ranges among each other, so no task ranks them all. The excess over ``MOST`` times a
    source's size goes to the others by weight until none is above.
    """
    sums = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    order = [F.col("no_source"), F.col("source_name")]
    ranged = stored_once(
        sums.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sources"
    )
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    # the ranges are no more than shuffle partitions
    weighed = ranged.join(F.broadcast(ranges), "range").select(*KEY, "source_size", weight.alias("weight"))
    weighed = stored_once(weighed, "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    full, level, clipped = F.lit(False), 0.0, -1
    while True:
        row = weighed.agg(
            F.count_if(full).alias("clipped"),
            F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)).alias("spent"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row.clipped == clipped or not row.open:
            break
        clipped, level = row.clipped, (SHARE * total - row.spent) / row.open
        full = MOST * F.col("source_size") <= F.lit(level) * F.col("weight")
    limit = (MOST * F.col("source_size")).cast("double")
    return weighed.select(*KEY, "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _bounds(rows: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    """Add to each source how often all is taken, and the hash up to which once more."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("bigint")
    state = targets.select(
        *KEY,
        "source_size",
        "target",
        whole.alias("whole"),
        (target - whole * size).alias("budget"),
        F.lit(0).cast("bigint").alias("lead"),
        F.lit(0).cast("bigint").alias("under"),
        F.lit(0).cast("bigint").alias("here"),
    )
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        inside = rows.select(*KEY, "size", "hash")
        if shift < BITS - LEVEL:
            lead = state.select(*KEY, "lead")
            inside = lookup_join(inside, lead, KEY, ["hash"], sources)
            inside = inside.where(F.shiftright("hash", shift + LEVEL) == F.col("lead"))
        words = inside.groupBy(*KEY, F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy(*KEY).orderBy("bucket"))
        counted = words.withColumn("upto", upto).join(state, KEY)
        ends = F.col("under") + F.col("upto") > F.col("budget")
        found = counted.where(ends).groupBy(*KEY).agg(
            F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("edge")
        )
        state = stored_once(
            state.join(found, KEY, "left").select(
                *KEY,
                "source_size",
                "target",
                "whole",
                "budget",
                # a source without words ends nowhere
                F.coalesce("edge.bucket", F.lit(-1)).alias("lead"),
                (F.col("under") + F.coalesce(F.col("edge.upto") - F.col("edge.words"), F.lit(0))).alias("under"),
                F.coalesce("edge.words", F.lit(0)).alias("here"),
            ),
            "bounds",
        )
    nearer = F.col("under") + F.col("here") - F.col("budget") < F.col("budget") - F.col("under")
    return state.select(
        *KEY, "source_size", "target", "whole", F.when(nearer, F.col("lead") + 1).otherwise(F.col("lead")).alias("bound")
    )


def _often(whole: Column, hashed: Column, bound: Column) -> Column:
    return whole + F.when(hashed < bound, 1).otherwise(0)


def mix_sources(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    ``taken`` is ``size`` times how often the mix takes the document: 0, 1 or 2. Null and empty
    texts have size 0 and are never counted; an empty table gives an empty result. A null
    source is a source of its own. Rows with one id and text share a hash, so repeated rows are
    taken or left together; rows with one id and different texts are told apart. Other columns
    are ignored.
    """
    rows = stored_once(sized(documents), "sized")
    targets = source_targets(rows)
    sources = targets.count()
    bounds = _bounds(rows, targets, sources)
    taken = F.col("size") * _often(F.col("whole"), F.col("hash"), F.col("bound"))
    return lookup_join(rows, bounds, KEY, ["hash"], sources).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken")
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with their columns."""
    rows = stored_once(sized(documents), "sized")
    targets = source_targets(rows)
    sources = targets.count()
    bounds = _bounds(rows, targets, sources).select(*KEY, "whole", "bound")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    keyed = documents.select(row, _hash().alias("hash"), *_key())
    often = _often(F.col("whole"), F.col("hash"), F.col("bound")).cast("int")
    copies = F.explode(F.sequence(F.lit(1), F.col("often")))
    chosen = lookup_join(keyed, bounds, KEY, ["hash"], sources).withColumn("often", often)
    return chosen.where(F.col("often") > 0).select("row", copies.alias("copy")).select("row.*")
