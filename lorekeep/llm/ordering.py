"""Rows in the global order of an id, in ranges that tasks handle on their own.

Boundaries are approximate quantiles of the id: one number per range reaches the driver, and the ranges
number a small multiple of the shuffle partitions. Which range a row belongs to is a function of its id
alone, so recomputed tasks agree. A null id counts as the smallest.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def order_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long"))


def boundaries(rows: DataFrame, id_col: str, per_partition: int = 2, least: int = 1) -> list[int]:
    """Ascending cuts c1 < c2 < ...: range 0 is below c1, range k holds c_k <= id < c_(k+1). There are ``per_partition`` ranges
    for each shuffle partition, and at least ``least``."""
    n = max(least, per_partition * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(order_key(id_col), [k / n for k in range(1, n)], 100 * n).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or ()))


def range_number(key: Column, cuts: list[int]) -> Column:
    """Number of the range as nested comparisons, logarithmic in the number of cuts."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def range_of(value: int | None, cuts: list[int]) -> int:
    return bisect_right(cuts, LEAST if value is None else value)
