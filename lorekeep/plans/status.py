"""Warehouse status: the latest run and how much it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.history import latest_run
from ..operators.issues import status_metrics
from ..sources.warehouse import Warehouse
from .dashboard import dashboard_frames


def status(warehouse: Warehouse) -> DataFrame:
    """One row, or none before the first run."""
    return status_metrics(
        warehouse.items_current(),
        warehouse.quality_scores(),
        warehouse.health_checks(),
        latest_run(warehouse.runs()),
    )


def admin_frames(warehouse: Warehouse, run_id: str, as_of) -> dict[str, DataFrame]:
    """The dashboard frames of a run."""
    return dashboard_frames(warehouse.items_current(), warehouse.health_checks(run_id), run_id, as_of)
