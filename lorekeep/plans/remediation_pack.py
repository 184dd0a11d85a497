"""The remediation pack: prioritised lists per category and the owner summary, as CSV files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import history as HI
from ..operators import issues
from ..operators.normalize import run_by_id
from ..operators.remediation import BROKEN_COLUMNS, LIST_COLUMNS, remediation_actions, remediation_base
from ..sources.exports import write_csv
from ..sources.warehouse import Warehouse


def generate_pack(
    warehouse: Warehouse, out_dir: str, as_of: datetime | str, run_id: str | None = None
) -> dict:
    """Write the pack of a run, the latest by default.

    One pass over the items writes the rows of all categories as a table with a directory per category; the lists are made
    from there, that of broken services with three more columns.
    """
    runs = warehouse.runs()
    head = (run_by_id(runs, run_id) if run_id else HI.latest_run(runs)).select("run_id").first()
    if head is None:
        return {"ok": False, "error": "No run found."}
    items = warehouse.items_current()
    health = warehouse.health_checks(head.run_id)
    # The snapshot run scores and checks an item once.
    base = remediation_base(
        items, warehouse.quality_scores(head.run_id), health, head.run_id, one_per_item=True
    )
    stem = f"{out_dir.rstrip('/')}/remediation_{str(as_of)[:10]}"
    rows = remediation_actions(base, as_of, columns=BROKEN_COLUMNS)
    rows.write.mode("overwrite").partitionBy("category").parquet(f"{stem}_rows")
    rows = warehouse.spark.read.schema(rows.schema).parquet(f"{stem}_rows")
    ordered = lambda frame: frame.orderBy("category", F.desc("priority"), "item_id")
    broken = rows.filter(F.col("category") == "broken_services")
    paths = {
        "actions": write_csv(ordered(rows.filter(F.col("category") != "broken_services").select("category", *LIST_COLUMNS)), f"{stem}_items", "category"),
        "broken_services": write_csv(ordered(broken).select(*BROKEN_COLUMNS), f"{stem}_broken_services"),
        "owner_summary": write_csv(
            issues.owner_remediation(items, health, head.run_id, as_of), f"{stem}_owner_summary"
        ),
    }
    return {"ok": True, "run_id": head.run_id, "paths": paths}
