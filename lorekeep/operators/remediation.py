"""Prioritised fix lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.predicates import in_run
from ..functions.scoring import priority
from .rows import left_join_fanout

# Recommended action per category.
ACTIONS = {
    "missing_tags": "ADD_TAGS",
    "missing_description": "ADD_DESCRIPTION",
    "stale_items": "REVIEW_STALE",
    "broken_services": "FIX_SERVICE_URL",
}

LIST_COLUMNS = (
    "item_id", "title", "item_type", "owner", "priority",
    "recommended_action", "url", "quality_score", "modified_at",
)
BROKEN_COLUMNS = (*LIST_COLUMNS, "status_code", "error_message", "checked_url")

_ITEM_COLUMNS = (
    "item_id", "title", "item_type", "owner", "url", "modified_at", "tags_count", "has_description",
)


def remediation_base(
    items: DataFrame,
    scores: DataFrame,
    health: DataFrame,
    run_id: str,
    one_per_item: bool = False,
) -> DataFrame:
    """Every item with its score and check of the run, if any; repeated ones repeat the item.

    ``one_per_item`` states that a run scores and checks an item once, as the snapshot run
    guarantees; two plain left joins on one shuffle then do.
    """
    run_scores = scores.filter(in_run(run_id)).select("item_id", F.col("score").alias("quality_score"))
    run_health = health.filter(in_run(run_id)).select(
        "item_id", F.col("ok").alias("health_ok"), "status_code", "error_message", "checked_url"
    )
    base = items.select(*_ITEM_COLUMNS)
    if one_per_item:
        return base.join(run_scores, "item_id", "left").join(run_health, "item_id", "left")
    # Checks may repeat an item very often, scores do not: one fan-out join, the last.
    return left_join_fanout(base.join(run_scores, "item_id", "left"), run_health, "item_id")


def category_filters(as_of: datetime | str) -> dict[str, Column]:
    return {
        "missing_tags": P.missing_tags(),
        "missing_description": P.missing_description(null_means_missing=False),
        "stale_items": P.stale(as_of),
        "broken_services": P.broken("health_ok"),
    }


def remediation_list(base: DataFrame, category: str, as_of: datetime | str) -> DataFrame:
    """The items of one category, the most urgent first (ties by id)."""
    columns = BROKEN_COLUMNS if category == "broken_services" else LIST_COLUMNS
    return (
        base.filter(category_filters(as_of)[category])
        .withColumns(
            {
                "priority": priority(F.col("quality_score"), category),
                "recommended_action": F.lit(ACTIONS[category]),
            }
        )
        .select(*columns)
        .orderBy(F.desc("priority"), "item_id")
    )


def remediation_actions(
    base: DataFrame, as_of: datetime | str, categories: list[str] = list(ACTIONS), columns: tuple[str, ...] = LIST_COLUMNS
) -> DataFrame:
    """All categories in one pass: a row per item and category it falls in, urgent ones first."""
    filters = category_filters(as_of)
    found = F.array(
        *[
            F.when(
                filters[c],
                F.struct(
                    F.lit(c).alias("category"),
                    priority(F.col("quality_score"), c).alias("priority"),
                    F.lit(ACTIONS[c]).alias("recommended_action"),
                ),
            )
            for c in categories
        ]
    )
    exploded = base.withColumn("found", F.explode(found)).filter(F.col("found").isNotNull())
    rows = exploded.select("*", "found.*")
    return rows.select("category", *columns).orderBy("category", F.desc("priority"), "item_id")
