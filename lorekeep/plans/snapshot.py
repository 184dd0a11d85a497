"""One snapshot run: raw items in, a published version of every catalog table out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.current import replace_rows
from ..operators.health import Fetch, classify_probes, http_fetch, probe_items
from ..operators.history import advance
from ..operators.normalize import scan_items, staged_items
from ..operators.scores import score_items
from ..sources.warehouse import Warehouse, as_datetime


@dataclass(frozen=True)
class SnapshotOptions:
    query: str | None = None
    item_types: list[str] | None = None
    max_items: int | None = None
    enable_history: bool = True
    enable_scores: bool = True
    enable_health: bool = True
    fetch: Fetch = http_fetch
    probe_partitions: int | None = None
    details: dict[str, str] = field(default_factory=dict)


def run_snapshot(
    warehouse: Warehouse,
    raw: DataFrame,
    run_id: str,
    started_at: datetime | str,
    finished_at: datetime | str | Callable[[], datetime],
    options: SnapshotOptions = SnapshotOptions(),
) -> bool:
    """Process ``raw`` (raw JSON text, ``seq`` giving the order within the batch) as one run.

    Returns False when the run was published before; doing it again changes nothing. A run that
    failed earlier keeps the start it was opened with. A ``finished_at`` that is a function is asked
    when the work is done. Errors are raised, and leave the published
    tables as they were.
    """
    opened_at, published = warehouse.run_state(run_id)
    if published:
        return False
    started_at = opened_at or started_at
    latest = warehouse.latest_published()
    if latest is not None and as_datetime(started_at) <= latest[1]:
        raise ValueError(f"run {run_id} starts at {started_at}, not after run {latest[0]} at {latest[1]}")
    if opened_at is None:
        warehouse.open_run(run_id, started_at, **options.details)

    # The raw text is read and parsed once, into a staged table that holds accepted and rejected rows.
    # The batch feeds four tables. Written once, it is read back from shared storage: its lineage
    # ends there, and a lost executor costs no second pass over the raw text.
    parsed = warehouse.write_version("staged", run_id, staged_items(raw, run_id, started_at, carry=("seq",)))
    items = parsed.filter("reason IS NULL").drop("reason", "raw")
    # Equal ``seq`` values, as from two files, are told apart by the content.
    chosen = scan_items(items, options.query, options.item_types, options.max_items, last_wins=("seq", "content_hash"))
    batch = warehouse.write_version("batches", run_id, chosen.drop("seq"))
    warehouse.write_version("rejects", run_id, parsed.filter("reason IS NOT NULL").select("raw", "seq", "reason"))

    tables: list[str] = []
    touched = warehouse.touched(batch)
    if touched:
        # Only the buckets that hold an item of the batch are read, joined and written anew.
        warehouse.write_bucketed("items_current", run_id, replace_rows(warehouse.items_current(touched), batch))
        tables.append("items_current")
        if options.enable_history:
            versions = advance(warehouse.open_versions(touched), batch, run_id, started_at)
            warehouse.write_bucketed("items_history", run_id, versions, "is_current")
            tables.append("items_history")
        if options.enable_scores:
            warehouse.write_children("quality_scores", run_id, score_items(batch, run_id, started_at))
            tables.append("quality_scores")
        if options.enable_health:
            probes = probe_items(batch, options.fetch, options.probe_partitions)
            warehouse.write_children("health_checks", run_id, classify_probes(probes, run_id, started_at))
            tables.append("health_checks")
    warehouse.publish(run_id, started_at, finished_at() if callable(finished_at) else finished_at, tables, touched)
    return True
