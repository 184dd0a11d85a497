"""Row-level helpers: last write wins, ordered caps, joins that keep every left row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate rather than a window: each task first keeps one row per key, so a key that holds
    a large share of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*").select(*df.columns)


def first_rows(
    df: DataFrame, keys: list[str], n: int, order: list[str], rank_column: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key in ascending ``order``, a total one.

    Spark limits the groups before the shuffle, so a hot key reaches its task as at most ``n`` rows
    per input task (up to its window group limit). ``rank_column`` names a column for the rank, from 1.
    """
    ranked = _ranked(df, keys, n, order, rank_column or "_rank")
    return ranked if rank_column else ranked.drop("_rank")


def _ranked(df: DataFrame, keys: list[str], n: int, order: list[str], name: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def left_join_fanout(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join for a right side that may repeat one key very often; null keys match nothing.

    A left outer join can only split a hot partition of its left side. The inner part can be split
    on either side at run time, and the rows without a match need only the distinct right keys.
    """
    matched = left.join(right, key)
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
