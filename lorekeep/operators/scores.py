"""Quality scores per item and their statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import in_run
from ..functions.scoring import catalog_score, missing_fields, score_breakdown
from ..functions.values import ntz

HIGH_SCORE, LOW_SCORE = 70, 50


def score_items(items: DataFrame, run_id: str | Column, as_of: datetime | str) -> DataFrame:
    """One score row per item row."""
    return items.select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"),
        "item_id",
        catalog_score(as_of).alias("score"),
        score_breakdown(as_of).alias("breakdown_json"),
        missing_fields().alias("missing_json"),
        ntz(as_of).alias("computed_at"),
    )


def quality_stats(scores: DataFrame, run_id: str) -> DataFrame:
    """One row; average, minimum and maximum are null for a run without scores."""
    score = F.col("score")
    return scores.filter(in_run(run_id)).agg(
        F.avg(score).alias("avg_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.count_if(score >= HIGH_SCORE).alias("count_high_quality"),
        F.count_if(score < LOW_SCORE).alias("count_low_quality"),
    )
