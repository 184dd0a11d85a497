"""Quality scores and remediation priority as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clamp, ntz_sql

# Points per catalog rule, in breakdown order (sum of all: 95).
POINTS = {
    "has_description": 20,
    "tags_count": 15,
    "has_extent": 15,
    "has_thumbnail": 5,
    "snippet_len": 5,
    "title_len": 5,
    "freshness": 20,
    "url": 10,
}
FRESH_DAYS = 180

# How much a kind of issue adds to the remediation priority.
PRIORITY_WEIGHT = {
    "broken_services": 30,
    "missing_description": 15,
    "missing_tags": 10,
    "stale_items": 10,
}
UNSCORED = 50


def _rules(as_of: datetime | str) -> dict[str, str]:
    """The condition of each catalog rule; nulls fail a rule, future dates are fresh.

    Age counts whole days, so the last fresh moment is just under ``FRESH_DAYS + 1`` days ago.
    """
    return {
        "has_description": "has_description",
        "tags_count": "tags_count >= 3",
        "has_extent": "has_extent",
        "has_thumbnail": "has_thumbnail",
        "snippet_len": "snippet_len BETWEEN 20 AND 200",
        "title_len": "length(title) BETWEEN 10 AND 120",
        "freshness": f"modified_at > {ntz_sql(as_of)} - INTERVAL '{FRESH_DAYS + 1}' DAY",
        "url": "url <> ''",
    }


def catalog_score(as_of: datetime | str) -> Column:
    points = [f"CASE WHEN {rule} THEN {POINTS[name]} ELSE 0 END" for name, rule in _rules(as_of).items()]
    return clamp(F.expr(" + ".join(points)))


def score_breakdown(as_of: datetime | str) -> Column:
    """JSON object of the rules that gave points."""
    pairs = [f"'{name}', CASE WHEN {rule} THEN {POINTS[name]} END" for name, rule in _rules(as_of).items()]
    return F.expr(f"to_json(map_filter(map({', '.join(pairs)}), (rule, points) -> points IS NOT NULL))")


def missing_fields() -> Column:
    """JSON array of what is absent. A missing extent is scored but never listed."""
    return F.expr(
        """to_json(array_compact(array(
             CASE WHEN NOT coalesce(has_description, false) THEN 'description' END,
             CASE WHEN coalesce(tags_count, 0) = 0 THEN 'tags' END,
             CASE WHEN NOT coalesce(has_thumbnail, false) THEN 'thumbnail' END)))"""
    )


def hit_score(title: Column, snippet: Column, description: Column, tags: Column) -> Column:
    """Score of a search hit: presence of text fields plus one or three tags."""
    given = lambda text: F.coalesce(text != "", F.lit(False))
    n_tags = F.coalesce(F.size(tags), F.lit(0))
    points = [
        (given(title), 20),
        (given(snippet), 30),
        (given(description), 30),
        (n_tags > 0, 10),
        (n_tags >= 3, 10),
    ]
    total = F.lit(0)
    for flag, value in points:
        total = total + F.when(flag, F.lit(value)).otherwise(F.lit(0))
    return F.least(total, F.lit(100))


def priority(score: Column, issue: str) -> Column:
    """Lower quality and graver issues come first; 0 to 100."""
    return clamp(F.lit(100 + PRIORITY_WEIGHT[issue]) - F.coalesce(score, F.lit(UNSCORED)))
