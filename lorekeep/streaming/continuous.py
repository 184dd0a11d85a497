"""Snapshot runs from a stream: every micro-batch of raw items is one run."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.snapshot import SnapshotOptions, run_snapshot
from ..sources.warehouse import Warehouse

RAW_SCHEMA = "raw STRING, seq BIGINT"


def raw_stream(warehouse: Warehouse, path: str, file_format: str = "parquet", files_per_run: int | None = None) -> DataFrame:
    """Raw item files as they arrive in a directory."""
    reader = warehouse.spark.readStream.schema(RAW_SCHEMA).format(file_format)
    if files_per_run is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.load(path)


def default_checkpoint(warehouse: Warehouse, run_prefix: str) -> str:
    """A folder of this warehouse's stream in the shared one the session names."""
    shared = warehouse.spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
    name = hashlib.sha256(warehouse.root.encode()).hexdigest()[:16]
    return f"{shared.rstrip('/')}/lorekeep/{run_prefix}{name}"


def continuous_snapshot(
    warehouse: Warehouse,
    raw: DataFrame,
    clock: Callable[[], datetime],
    checkpoint: str | None = None,
    run_prefix: str = "batch_",
    options: SnapshotOptions = SnapshotOptions(),
) -> StreamingQuery:
    """Apply all data available now and stop; start again for what has come since.

    The run id is made from the batch id. A replayed batch finds its run published, or opened with
    a start time that it keeps, so nothing is applied twice. The checkpoint lies in the shared
    folder the session names unless another is given.
    """
    checkpoint = checkpoint or default_checkpoint(warehouse, run_prefix)

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_snapshot(warehouse, batch, f"{run_prefix}{batch_id:09d}", clock(), clock, options)

    writer = raw.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
