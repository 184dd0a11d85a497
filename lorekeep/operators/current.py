"""The table of current items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import latest_by


def last_in_batch(batch: DataFrame, *order: str | Column) -> DataFrame:
    """One row per item: the last one of the batch wins."""
    return latest_by(batch, ["item_id"], *order)


def upsert_current(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace whole rows by ``item_id``; items the batch does not have stay as they are.

    ``batch`` has one row per item (:func:`last_in_batch`).
    """
    kept = current.join(batch.select("item_id"), "item_id", "left_anti")
    return kept.select(*current.columns).unionByName(batch.select(*current.columns))


def replace_rows(current: DataFrame, batch: DataFrame) -> DataFrame:
    """:func:`upsert_current` as one join of whole rows: if ``current`` is read in buckets, only the batch is shuffled, and the
    result comes in these buckets."""
    whole = lambda rows, name: rows.select("item_id", F.struct(*current.columns).alias(name))
    joined = whole(current, "old").join(whole(batch, "new"), "item_id", "full_outer")
    return joined.select(F.coalesce("new", "old").alias("row")).select("row.*")
