"""The governance dashboard: six named frames, long lists cut to what is shown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators import health as H
from ..operators import issues

SHOWN_ROWS = 50


def dashboard_frames(
    items: DataFrame, health: DataFrame, run_id: str, as_of: datetime | str, shown: int = SHOWN_ROWS
) -> dict[str, DataFrame]:
    """Lazy frames; a failing one raises when it is used."""
    tag_columns = (*issues.ITEM_COLUMNS, "tags_json")
    broken = H.broken_services(items, health, run_id)
    return {
        "missing_tags": issues.capped(issues.missing_tags(items, columns=tag_columns), shown),
        "missing_description": issues.capped(issues.missing_description(items), shown),
        "missing_extent": issues.capped(issues.missing_extent(items), shown),
        "stale_items": issues.capped(issues.stale_items(items, as_of), shown),
        "broken_services": issues.capped(broken, shown, "item_id", "checked_url"),
        "owner_summary": issues.owner_summary(items, as_of, description_column="missing_desc"),
    }
