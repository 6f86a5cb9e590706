"""Vector expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector,
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * x.cast("double"),
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Unit length in double; a zero vector stays zero.

    The length is laid out as a second array, because an expression inside the lambda
    would be worked out again for every element.
    """
    length = F.greatest(l2_norm(vector), F.lit(1e-12))
    return F.zip_with(
        vector, F.array_repeat(length, F.size(vector)), lambda x, n: x.cast("double") / n
    )
