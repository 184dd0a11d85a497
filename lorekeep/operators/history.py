"""Versioned item history: half-open validity intervals, one current version per item."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import ntz
from ..schemas import HISTORY_ATTRIBUTES
from .rows import latest_by


def apply_batch(
    history: DataFrame,
    batch: DataFrame,
    run_id: str,
    started_at: datetime | str,
    attributes: Sequence[str] = HISTORY_ATTRIBUTES,
) -> DataFrame:
    """History after one run saw ``batch``: :func:`advance` of the open versions, closed ones go round it.

    For one call on a stored history. Runs that follow each other keep open and closed versions apart.
    """
    versions = advance(history.filter("is_current"), batch, run_id, started_at, attributes)
    return versions.unionByName(history.filter("NOT is_current").select(*versions.columns))


def advance(
    open_versions: DataFrame,
    batch: DataFrame,
    run_id: str,
    started_at: datetime | str,
    attributes: Sequence[str] = HISTORY_ATTRIBUTES,
) -> DataFrame:
    """The open versions after one run saw ``batch`` (one row per item), and those it closed.

    A changed item's version is closed at the run's start and a new one opened; an unchanged one
    is marked as seen; an unseen one stays open. One full outer join decides all four cases, and each
    pair of old and new row turns into its result rows in place. If the open versions are read in buckets,
    only the batch is shuffled.
    """
    columns = ["item_id", "content_hash", "valid_from", "valid_to", "is_current", *attributes,
               "first_seen_run_id", "last_seen_run_id"]
    # A batch row may be nullable where a history row is not; one schema serves both.
    types = {f.name: f.dataType.simpleString() for f in open_versions.select(*columns).schema.fields}

    def version(source: str, **changed: str) -> str:
        """SQL of a history row made from a version (old) or a batch row (new) and some changes."""
        fields = [f"'{c}', CAST({changed.get(c, f'{source}.`{c}`')} AS {types[c]})" for c in columns]
        return f"named_struct({', '.join(fields)})"

    old = open_versions.select("item_id", F.struct(*columns).alias("old"))
    seen = batch.select(
        "item_id",
        F.struct("item_id", "content_hash", *attributes).alias("new"),
        F.lit(run_id).alias("run"),
        ntz(started_at).alias("start"),
    )
    opened = version(
        "new",
        valid_from="start",
        valid_to="NULL",
        is_current="true",
        first_seen_run_id="run",
        last_seen_run_id="run",
    )
    closed = version("old", valid_to="start", is_current="false")
    rows = F.expr(
        f"""CASE WHEN new IS NULL THEN array({version("old")})
                 WHEN old IS NULL THEN array({opened})
                 WHEN old.content_hash <> new.content_hash THEN array({closed}, {opened})
                 ELSE array({version("old", last_seen_run_id="run")}) END"""
    )
    return old.join(seen, "item_id", "full_outer").select(F.explode(rows).alias("version")).select("version.*")


def feed(written: DataFrame, run_column: str = "as_of_run") -> DataFrame:
    """What runs changed, from the versions each of them wrote (:func:`advance`), with the run in ``run_column``.

    ``change`` is "opened", "closed", or "touched" for an open version that was seen again; versions that merely lie in a bucket
    the run wrote are left out. Rows are as the run left them.
    """
    run = F.col(run_column)
    change = F.when(~F.col("is_current"), "closed").when(F.col("first_seen_run_id") == run, "opened")
    change = change.when(F.col("last_seen_run_id") == run, "touched")
    columns = [c for c in written.columns if c != run_column]
    return written.select(run.alias("run_id"), change.alias("change"), *columns).filter(F.col("change").isNotNull())


def rebuild(
    observations: DataFrame, runs: DataFrame, attributes: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """History from all observations (item_id, run_id, content_hash, attributes) at once.

    Equals applying the runs one by one. Repeated sightings within a run are reduced first, the
    greatest ``order`` winning, so an item brings at most one row per run into its window.
    """
    seen = observations.select("item_id", "run_id", "content_hash", *attributes, *order)
    if order:
        seen = latest_by(seen, ["item_id", "run_id"], *order).drop(*set(order).difference(attributes))
    timed = seen.join(runs.select("run_id", "started_at"), "run_id")
    timeline = W.partitionBy("item_id").orderBy("started_at", "run_id")
    whole = timeline.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    previous_hash = F.lag("content_hash").over(timeline)
    versions = (
        timed.withColumns(
            {
                "opens": previous_hash.isNull() | (previous_hash != F.col("content_hash")),
                "previous_run": F.lag("run_id").over(timeline),
                "last_run": F.last("run_id").over(whole),
            }
        )
        .filter("opens")
        .withColumns(
            {
                "valid_to": F.lead("started_at").over(timeline),
                "last_before_next": F.lead("previous_run").over(timeline),
            }
        )
    )
    return versions.select(
        "item_id",
        "content_hash",
        F.col("started_at").alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
        *attributes,
        F.col("run_id").alias("first_seen_run_id"),
        F.coalesce("last_before_next", "last_run").alias("last_seen_run_id"),
    )


def changes_of_run(
    history: DataFrame, run_id: str, limit: int | None = None, earlier: DataFrame | None = None
) -> DataFrame:
    """Versions the run opened, with ``change_type`` "Modified" or "New".

    An item is modified when any other run opened a version of it, later runs included. Give
    ``earlier`` (run_id of the runs before) to look back only. With a ``limit`` the rows are cut
    first, and the history is then searched for those few items only.
    """
    opened = history.filter(F.col("first_seen_run_id") == run_id)
    others = history.filter(F.col("first_seen_run_id") != run_id).select("item_id", "first_seen_run_id")
    if earlier is not None:
        runs = earlier.select(F.col("run_id").alias("first_seen_run_id"))
        others = others.join(runs, "first_seen_run_id", "left_semi")
    if limit is not None:
        opened = opened.orderBy("item_id").limit(limit)
        others = others.join(opened.select("item_id").distinct(), "item_id", "left_semi")
    known = others.select("item_id").distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known"), F.lit("Modified")).otherwise(F.lit("New"))
    return opened.join(known, "item_id", "left").withColumn("change_type", kind).drop("known")


def latest_run(runs: DataFrame) -> DataFrame:
    """The run started last, finished or not."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(1)


def previous_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run started last before ``run_id``; no row when there is none."""
    start = runs.filter(F.col("run_id") == run_id).agg(F.max("started_at")).scalar()
    return latest_run(runs.filter(F.col("started_at") < start))
