"""The catalog health report of a run, as frames and as CSV files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import report_base_name
from ..operators import history as HI
from ..operators import issues, scores as S
from ..operators.normalize import run_by_id
from ..operators.sections import LISTS, section, section_rows
from ..sources.exports import write_csv
from ..sources.warehouse import Warehouse

CHANGES_SHOWN, OWNERS_SHOWN = 20, 20
CSV_FRAMES = (
    "missing_tags", "missing_description", "missing_extent", "stale_items", "broken_services", "owner_summary",
)
_BROKEN_COLUMNS = ("title", "owner", "checked_url", "status_code", "error_message")
_CHANGE_COLUMNS = ("item_id", "title", "owner", "item_type", "change_type")


def report_frames(
    rows: DataFrame,
    scores: DataFrame,
    health: DataFrame,
    history: DataFrame,
    runs: DataFrame,
    run_id: str,
) -> dict[str, DataFrame]:
    """Every section of the report. ``rows`` are those of :func:`section_rows`: totals and lists cover all items, scores and
    checks the run.

    ``changes`` has no rows when no run started before this one.
    """
    earlier_runs = HI.previous_run(runs, run_id).agg(F.count("*")).scalar()
    changes = HI.changes_of_run(history.filter(earlier_runs > 0), run_id, CHANGES_SHOWN)
    return {
        "run": run_by_id(runs, run_id),
        "snapshot_summary": issues.run_summary(section(rows, "totals"), scores, health, run_id),
        "quality_stats": S.quality_stats(scores, run_id),
        **{name: section(rows, name) for name in LISTS if name != "broken_services"},
        "broken_services": section(rows, "broken_services").select(*_BROKEN_COLUMNS),
        "owner_summary": section(rows, "owner_summary", OWNERS_SHOWN),
        "changes": changes.select(*_CHANGE_COLUMNS),
    }


def generate_report(
    warehouse: Warehouse,
    out_dir: str,
    as_of: datetime | str,
    run_id: str | None = None,
    verify_only: bool = False,
) -> dict:
    """Report of a run, the latest by default.

    Returns ``ok`` with the written paths, or ``ok`` false and the error. ``verify_only`` computes
    every frame and writes no file. Otherwise the items are read once: the rows of all sections are written as one table, in a
    directory per section, and the lists are made from there.
    """
    runs = warehouse.runs()
    chosen = run_by_id(runs, run_id) if run_id else HI.latest_run(runs)
    head = chosen.select("run_id", report_base_name(F.col("started_at"), F.col("run_id")).alias("name")).first()
    if head is None:
        return {"ok": False, "error": f"Run ID {run_id} not found." if run_id else "No runs found."}
    base = f"{out_dir.rstrip('/')}/{head.name}"
    health = warehouse.health_checks(head.run_id)
    rows = section_rows(warehouse.items_current(), health, head.run_id, as_of)
    if not verify_only:
        rows.write.mode("overwrite").partitionBy("section").parquet(f"{base}_sections")
        rows = warehouse.spark.read.schema(rows.schema).parquet(f"{base}_sections")
    frames = report_frames(rows, warehouse.quality_scores(head.run_id), health, warehouse.items_history(), runs, head.run_id)
    if verify_only:
        for frame in frames.values():
            frame.write.format("noop").mode("overwrite").save()
        return {"ok": True, "verified": True, "run_id": head.run_id}
    paths = [write_csv(frames[name], f"{base}_{name}") for name in CSV_FRAMES]
    return {"ok": True, "run_id": head.run_id, "csv_paths": paths, "frames": frames}
