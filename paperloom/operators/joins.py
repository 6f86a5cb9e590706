"""Joins of a large table with a table that is usually, but not surely, small."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast. At about 100 bytes a row it is 50 MB.
MAX_BROADCAST_ROWS = 500_000

#: Copies of the lookup table, and so the number of tasks one hot key is spread over.
SALTS = 64

#: Rows that a lookup join by article makes in one task, on average.
ROWS_PER_TASK = 1_000_000


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    small_rows: int,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Inner join that broadcasts ``small`` only when its row bound allows it.

    ``small_rows`` is a proven bound on its rows. Beyond the limit both sides shuffle, and
    each key is split over ``SALTS`` tasks by a hash of ``spread_by`` columns of the large
    side, so a key that holds a third of all rows does not end up in one task.
    """
    if small_rows <= max_broadcast_rows:
        return large.join(F.broadcast(small), on)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        large.withColumn("_salt", salt)
        .join(small.withColumn("_salt", copies), [*on, "_salt"])
        .drop("_salt")
    )


def by_article(rows: DataFrame, n_joined: int) -> DataFrame:
    """``rows`` brought together by article id, for a join that makes ``n_joined`` rows of them.

    A posting becomes a row for every request that has its term, so the size of what is shuffled
    says little about what a task then holds. The tasks are counted by the rows that the join
    makes; adaptive execution keeps a given number as it is. Whatever is grouped by id and
    other columns after that needs no further shuffle.
    """
    return rows.repartition(max(1, math.ceil(n_joined / ROWS_PER_TASK)), "id")
