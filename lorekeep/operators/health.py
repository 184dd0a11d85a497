"""URL health: probing, classification and the list of broken services."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from time import monotonic
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import broken, has_url, in_run
from ..functions.values import ntz
from ..schemas import HEALTH_CHECKS

# Probe limits.
TIMEOUT_SECONDS = 5
THREADS_PER_TASK = 10
METHOD_NOT_ALLOWED = 405

# A fetch takes (method, url, timeout) and returns (status code, elapsed seconds), or raises.
Fetch = Callable[[str, str, float], tuple[int, float]]

_PROBE_COLUMNS = "status_code INT, elapsed_seconds DOUBLE, transport_error STRING"


def http_fetch(method: str, url: str, timeout: float) -> tuple[int, float]:
    """One HTTP request over the network, redirects followed."""
    if urlsplit(url).scheme.lower() not in ("http", "https"):
        raise ValueError("only http and https are probed")
    begin = monotonic()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=timeout) as reply:
            return reply.status, monotonic() - begin
    except urllib.error.HTTPError as reply:
        with reply:
            return reply.code, monotonic() - begin


def probe_url(url: str, fetch: Fetch, timeout: float = TIMEOUT_SECONDS) -> tuple:
    """HEAD, or GET where HEAD is not allowed; an error of any kind becomes the third value."""
    try:
        status, elapsed = fetch("HEAD", url, timeout)
        if status == METHOD_NOT_ALLOWED:
            status, elapsed = fetch("GET", url, timeout)
        return status, elapsed, None
    except Exception as problem:  # noqa: BLE001 - one bad URL must not fail the batch
        return None, None, str(problem)


def probe_items(
    items: DataFrame,
    fetch: Fetch = http_fetch,
    partitions: int | None = None,
    timeout: float = TIMEOUT_SECONDS,
    threads: int = THREADS_PER_TASK,
) -> DataFrame:
    """Probe every item that has a URL: item_id, checked_url and the raw outcome.

    Item ids spread the requests evenly, however many items share a host. Waiting for replies is
    the work here, not data, so the number of ``partitions`` is fixed beforehand (two per core when
    not given) and not fitted to the small size of the rows. Write the result before using it twice.
    """
    todo = items.filter(has_url()).select("item_id", F.col("url").alias("checked_url"))
    todo = todo.repartition(partitions or 2 * items.sparkSession.sparkContext.defaultParallelism, "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                outcomes = list(pool.map(lambda u: probe_url(u, fetch, timeout), batch["checked_url"]))
                status, elapsed, error = zip(*outcomes) if outcomes else ((), (), ())
                yield batch.assign(
                    status_code=pd.array(status, dtype="Int32"),
                    elapsed_seconds=pd.array(elapsed, dtype="Float64"),
                    transport_error=pd.array(error, dtype="string"),
                )

    return todo.mapInPandas(run, f"item_id STRING, checked_url STRING, {_PROBE_COLUMNS}")


def classify_probes(probes: DataFrame, run_id: str | None, checked_at: datetime | str | None) -> DataFrame:
    """Health rows from raw outcomes: healthy below status 400, latency in whole milliseconds.

    ``run_id`` or ``checked_at`` of None keeps the probes' own column.
    """
    status = F.col("status_code")
    stamps = {}
    if run_id is not None:
        stamps["run_id"] = F.lit(run_id)
    if checked_at is not None:
        stamps["checked_at"] = ntz(checked_at)
    return (
        probes.withColumns(
            {
                "ok": F.coalesce(status < 400, F.lit(False)),
                "latency_ms": F.when(
                    status.isNotNull(), F.floor(F.col("elapsed_seconds") * 1000).cast("int")
                ),
                "error_message": F.when(status.isNull(), F.col("transport_error")).when(
                    status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))
                ),
                **stamps,
            }
        )
        .select(*HEALTH_CHECKS.names)
    )


def broken_services(items: DataFrame, health: DataFrame, run_id: str) -> DataFrame:
    """Failed checks of the run with the item they belong to, one row per check."""
    failed = health.filter(in_run(run_id) & broken()).select(
        "item_id", "checked_url", "status_code", "error_message"
    )
    return failed.join(items.select("item_id", "title", "owner"), "item_id").select(
        "item_id", "title", "owner", "checked_url", "status_code", "error_message"
    )
