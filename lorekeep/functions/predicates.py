"""Governance checks as boolean columns.

The reports and the remediation pack read a null differently, so the checks take
``null_means_missing``: True counts an unknown value as missing, False leaves it out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ntz_sql

# Item types that can be drawn, and those whose rows can be counted.
PREVIEWABLE_TYPES = ("Feature Service", "Feature Layer", "Map Service")
COUNTABLE_TYPES = ("Feature Service", "Feature Layer")


def missing_tags(null_means_missing: bool = True) -> Column:
    return F.expr("coalesce(tags_count, 0) = 0" if null_means_missing else "tags_count = 0")


def _absent(flag: str, null_means_missing: bool) -> Column:
    return F.expr(f"NOT coalesce({flag}, false)" if null_means_missing else f"NOT {flag}")


def missing_description(null_means_missing: bool = True) -> Column:
    return _absent("has_description", null_means_missing)


def missing_extent(null_means_missing: bool = True) -> Column:
    return _absent("has_extent", null_means_missing)


def stale(as_of: datetime | str, years: int = 2) -> Column:
    """Modified before ``as_of`` minus calendar years, time of day kept; unknown is not stale."""
    return F.expr(f"modified_at < {ntz_sql(as_of)} - INTERVAL '{years}' YEAR")


def broken(flag: str = "ok") -> Column:
    return ~F.col(flag)


def in_run(run_id: str) -> Column:
    return F.col("run_id") == F.lit(run_id)


def has_url(url: str = "url") -> Column:
    return F.col(url) != ""


def previewable(item_type: str = "item_type") -> Column:
    return F.col(item_type).isin(*PREVIEWABLE_TYPES)


def countable(item_type: str = "item_type") -> Column:
    return F.col(item_type).isin(*COUNTABLE_TYPES)
