"""Issue lists and their summary by owner."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.predicates import in_run

ITEM_COLUMNS = ("item_id", "title", "owner")


def capped(df: DataFrame, limit: int | None, *order: str | Column) -> DataFrame:
    """The first rows in a total order, for a list that shows only some; all when no limit."""
    return df if limit is None else df.orderBy(*(order or ("item_id",))).limit(limit)


def missing_tags(items: DataFrame, null_means_missing: bool = True, columns=ITEM_COLUMNS) -> DataFrame:
    return items.filter(P.missing_tags(null_means_missing)).select(*columns)


def missing_description(items: DataFrame, null_means_missing: bool = True, columns=ITEM_COLUMNS) -> DataFrame:
    return items.filter(P.missing_description(null_means_missing)).select(*columns)


def missing_extent(items: DataFrame, null_means_missing: bool = True, columns=ITEM_COLUMNS) -> DataFrame:
    return items.filter(P.missing_extent(null_means_missing)).select(*columns)


def stale_items(items: DataFrame, as_of: datetime | str, columns=(*ITEM_COLUMNS, "modified_at")) -> DataFrame:
    return items.filter(P.stale(as_of)).select(*columns)


def owner_summary(
    items: DataFrame,
    as_of: datetime | str,
    limit: int | None = 20,
    description_column: str = "missing_description",
) -> DataFrame:
    """Items and issues per owner, the largest owners first (ties by name)."""
    totals = items.groupBy("owner").agg(
        F.count("*").alias("total_items"),
        F.count_if(P.missing_tags()).alias("missing_tags"),
        F.count_if(P.missing_description()).alias(description_column),
        F.count_if(P.stale(as_of)).alias("stale"),
    )
    return capped(totals, limit, F.desc("total_items"), F.asc_nulls_last("owner"))


def owner_remediation(
    items: DataFrame, health: DataFrame, run_id: str, as_of: datetime | str
) -> DataFrame:
    """Issues per owner with the broken services of a run, the worst owners first.

    An item counts once per check it had in the run, and once when it had none. The checks are
    counted per item before the join, so repeated checks of one item never meet in one task.
    """
    checks = (
        health.filter(in_run(run_id))
        .groupBy("item_id")
        .agg(F.count("*").alias("checks"), F.count_if(P.broken()).alias("failed"))
    )
    times = F.coalesce("checks", F.lit(1))

    def total(flag: Column) -> Column:
        return F.sum(F.when(flag, times).otherwise(F.lit(0))).cast("bigint")

    totals = (
        items.select("item_id", "owner", "tags_count", "has_description", "modified_at")
        .join(checks, "item_id", "left")
        .groupBy("owner")
        .agg(
            F.sum(times).cast("bigint").alias("total_items"),
            total(P.missing_tags()).alias("missing_tags_count"),
            total(P.missing_description(null_means_missing=False)).alias("missing_description_count"),
            total(P.stale(as_of)).alias("stale_items_count"),
            F.sum(F.coalesce("failed", F.lit(0))).cast("bigint").alias("broken_services_count"),
        )
    )
    return totals.orderBy(
        F.desc("broken_services_count"),
        F.desc("missing_description_count"),
        F.desc("missing_tags_count"),
        F.asc_nulls_last("owner"),
    )


def _counts(df: DataFrame, **named: Column) -> DataFrame:
    return df.agg(*[c.cast("bigint").alias(n) for n, c in named.items()])


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """One row holding the columns of several frames of at most one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def snapshot_summary(items: DataFrame, scores: DataFrame, health: DataFrame, run_id: str) -> DataFrame:
    """All current items, and what the run scored and checked."""
    return run_summary(_counts(items, total_items=F.count("*")), scores, health, run_id)


def run_summary(totals: DataFrame, scores: DataFrame, health: DataFrame, run_id: str) -> DataFrame:
    """:func:`snapshot_summary` where ``totals`` (at most one row) already has total_items."""
    return _side_by_side(
        totals.select("total_items"),
        _counts(scores.filter(in_run(run_id)), scored_items=F.count("*")),
        _counts(health.filter(in_run(run_id)), checked_urls=F.count("*")),
    ).fillna(0)


def status_metrics(items: DataFrame, scores: DataFrame, health: DataFrame, latest: DataFrame) -> DataFrame:
    """The latest run (at most one row) with the size of the warehouse and of that run."""
    run = F.broadcast(latest.select("run_id"))  # one row
    checks = health.join(run, "run_id", "left_semi")
    head = latest.select("run_id", F.substring("run_id", 1, 8).alias("short_id"), "started_at", "finished_at")
    return _side_by_side(
        head,
        _counts(items, items=F.count("*")),
        _counts(scores.join(run, "run_id", "left_semi"), scores=F.count("*")),
        _counts(checks, health_checks=F.count("*"), broken_services=F.count_if(P.broken())),
    ).filter(F.col("run_id").isNotNull())
