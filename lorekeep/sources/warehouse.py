"""The catalog tables on a shared file system, written by runs that become visible at their end.

A run writes below directories of its own and is published last, by one small entry of the log. Readers follow the log, so they
never see an unpublished run, and a run that failed half-way is simply written again::

    log/…                                                       opened and published runs (:mod:`run_log`)
    staged, batches, rejects/as_of_run=…                        what the run received
    items_current/as_of_run=…/bucket=…                          current items of the buckets the run touched
    items_history/as_of_run=…/is_current=true/bucket=…          open versions of these buckets
    items_history/as_of_run=…/is_current=false/bucket=…         the versions this run closed
    quality_scores, health_checks/run_id=…/bucket=…             children of the run, in the buckets of their items

A run writes the buckets that hold an item of its batch; all others stay where an earlier run wrote them. Of each bucket the
log names the run that wrote it last, so a run of few items reads and writes few buckets, and a reader lists one directory per
bucket, whatever the number of runs. Older directories of a bucket may be deleted once nobody reads them.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.values import ntz
from ..operators.history import feed, latest_run
from .buckets import BUCKETS, read_buckets, touched_buckets, write_buckets
from .footers import row_count
from .run_log import FOLD, RunLog

_BY_RUN = {
    "quality_scores": schemas.QUALITY_SCORES,
    "health_checks": schemas.HEALTH_CHECKS,
}
_VERSION = T.StructField("as_of_run", T.StringType())


def as_datetime(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


class Warehouse:
    """``buckets`` is a property of the stored tables: give the same number whenever a warehouse is opened."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fold: int = FOLD):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.log = RunLog(spark, self.root, fold)

    # --- reading ------------------------------------------------------------------------------

    def _read(self, table: str, schema: T.StructType, folder: str = "") -> DataFrame:
        """The files of a table or of one ``folder`` of it (nothing else is listed), or no rows before the first write."""
        try:
            reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
            return reader.parquet(f"{self.root}/{table}/{folder}" if folder else f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """A row per published run and table."""
        return self.log.entries().filter(F.col("table_name").isNotNull())

    def runs(self) -> DataFrame:
        """Opened runs; ``finished_at`` is set once a run is published."""
        entries = self.log.entries()
        opened = entries.filter(F.col("table_name").isNull()).dropDuplicates(["run_id"]).drop("finished_at")
        done = entries.filter(F.col("table_name") == "runs").select("run_id", "finished_at")
        return opened.join(done, "run_id", "left").select(*schemas.RUNS.names)

    def run_state(self, run_id: str) -> tuple[datetime | None, bool]:
        """When the run was opened, if it was, and whether it is published: one look at the log."""
        rows = self.log.entries().filter(F.col("run_id") == run_id).select("table_name", "started_at").collect()
        opened = [r.started_at for r in rows if r.table_name is None]
        return (opened[0] if opened else None), any(r.table_name is not None for r in rows)

    def opened_at(self, run_id: str) -> datetime | None:
        return self.run_state(run_id)[0]

    def is_published(self, run_id: str) -> bool:
        return self.run_state(run_id)[1]

    def latest_published(self, table: str = "runs") -> tuple[str, datetime] | None:
        """Id and start of the last published run that has the table."""
        row = latest_run(self.manifest().filter(F.col("table_name") == table)).first()
        return row and (row.run_id, row.started_at)

    def live_buckets(self, table: str) -> dict[int, str]:
        """The run that wrote each bucket of a table last; at most as many as there are buckets."""
        written = self.manifest().filter(F.col("table_name") == table).select("run_id", "started_at", F.explode("buckets").alias("bucket"))
        last = written.groupBy("bucket").agg(F.max_by("run_id", "started_at").alias("run_id"))
        return {r["bucket"]: r["run_id"] for r in last.collect()}

    def _bucketed(self, table: str, schema: T.StructType, folder: str, only: Collection[int] | None) -> DataFrame:
        live = {b: f"as_of_run={run}{folder}" for b, run in self.live_buckets(table).items() if only is None or b in only}
        return read_buckets(self.spark, f"{self.root}/{table}", live, schema, buckets=self.buckets)

    def items_current(self, only: Collection[int] | None = None) -> DataFrame:
        """Current items, of some buckets if given."""
        return self._bucketed("items_current", schemas.ITEMS_CURRENT, "", only)

    def open_versions(self, only: Collection[int] | None = None) -> DataFrame:
        """The current version of every item, of some buckets if given; no closed version is read."""
        return self._bucketed("items_history", schemas.ITEMS_HISTORY, "/is_current=true", only).withColumn("is_current", F.lit(True))

    def closed_versions(self) -> DataFrame:
        """What each published run closed."""
        published = self.manifest().filter(F.col("table_name") == "items_history")
        published = published.select(F.col("run_id").alias("as_of_run"))
        files = self._read("items_history", T.StructType([*schemas.ITEMS_HISTORY.fields, _VERSION]))
        closed = files.filter(~F.col("is_current")).join(published, "as_of_run", "left_semi")
        return closed.select(*schemas.ITEMS_HISTORY.names)

    def items_history(self) -> DataFrame:
        """All versions: the open ones, and what each published run closed."""
        return self.open_versions().unionByName(self.closed_versions())

    def change_feed(self, after: str | None = None, upto: str | None = None) -> DataFrame:
        """Versions that the published runs behind ``after`` up to ``upto`` opened, closed or saw again (:func:`history.feed`).
        Only what these runs wrote is listed and read."""
        runs = self.manifest().filter(F.col("table_name") == "items_history").select("run_id", "started_at").collect()
        start = {r.run_id: r.started_at for r in runs}
        low, high = (start[run] if run is not None else None for run in (after, upto))
        chosen = [run for run, at in start.items() if (low is None or at > low) and (high is None or at <= high)]
        root, schema = f"{self.root}/items_history", T.StructType([*schemas.ITEMS_HISTORY.fields, _VERSION])
        if not chosen:
            return feed(self.spark.createDataFrame([], schema))
        reader = self.spark.read.schema(schema).option("basePath", root)
        return feed(reader.parquet(*[f"{root}/as_of_run={run}" for run in sorted(chosen)]).select(*schema.names))

    def row_count(self, table: str, run_id: str | None = None, name: str = "n") -> DataFrame:
        """How many rows the current items have, or the children of a run: one row, from the footers of the files alone."""
        if table == "items_current":
            folders = [f"as_of_run={run}/bucket={b}" for b, run in self.live_buckets(table).items()]
        else:
            entries = self.manifest().filter((F.col("table_name") == table) & (F.col("run_id") == run_id)).count()
            folders = [f"run_id={run_id}"] * entries
        return row_count(self.spark, *[f"{self.root}/{table}/{folder}" for folder in folders], name=name)

    def children(self, table: str, run_id: str | None = None) -> DataFrame:
        """Scores or health checks of the published runs, or of one run (reads its directory only, in buckets)."""
        schema, published = _BY_RUN[table], self.manifest().filter(F.col("table_name") == table)
        if run_id is None:
            rows = self._read(table, schema).join(published, "run_id", "left_semi")
            return rows.select(*schema.names)
        entry = published.filter(F.col("run_id") == run_id).first()
        live = {b: f"run_id={run_id}" for b in ((entry.buckets or ()) if entry else ())}
        stored = T.StructType([f for f in schema if f.name != "run_id"])
        rows = read_buckets(self.spark, f"{self.root}/{table}", live, stored, buckets=self.buckets, complete=False)
        return rows.withColumn("run_id", F.lit(run_id)).select(*schema.names)

    def quality_scores(self, run_id: str | None = None) -> DataFrame:
        return self.children("quality_scores", run_id)

    def health_checks(self, run_id: str | None = None) -> DataFrame:
        return self.children("health_checks", run_id)

    # --- writing ------------------------------------------------------------------------------

    def open_run(self, run_id: str, started_at: datetime | str, **details: str) -> None:
        if not re.fullmatch(r"[\w.-]+", run_id):  # it names directories
            raise ValueError(f"run id {run_id!r} has characters other than letters, digits, '_', '.', '-'")
        columns = {"run_id": F.lit(run_id), "started_at": ntz(started_at)}
        columns |= {name: F.lit(value) for name, value in details.items()}
        self.log.add(f"opened-{run_id}", self.spark.range(1).select(*[c.alias(name) for name, c in columns.items()]))

    def write_version(self, table: str, run_id: str, rows: DataFrame) -> DataFrame:
        """Write what an unpublished run received and read it back from there."""
        path = f"{self.root}/{table}/as_of_run={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def touched(self, rows: DataFrame) -> list[int]:
        return touched_buckets(rows, buckets=self.buckets)

    def write_bucketed(self, table: str, run_id: str, rows: DataFrame, *partition_by: str) -> None:
        """Write the buckets of a table that an unpublished run touched."""
        write_buckets(rows, f"{self.root}/{table}/as_of_run={run_id}", *partition_by, buckets=self.buckets)

    def write_children(self, table: str, run_id: str, rows: DataFrame) -> None:
        write_buckets(rows.drop("run_id"), f"{self.root}/{table}/run_id={run_id}", buckets=self.buckets)

    def publish(
        self,
        run_id: str,
        started_at: datetime | str,
        finished_at: datetime | str,
        tables: list[str],
        buckets: Collection[int] | None = None,
    ) -> None:
        """Make the run's tables visible, all at once: a single file of a few rows. ``buckets`` are those it wrote of
        the tables of items."""
        names = F.explode(F.array(*[F.lit(t) for t in ("runs", *tables)])).alias("table_name")
        written = F.lit(None) if buckets is None else F.array(*[F.lit(b) for b in sorted(buckets)])
        rows = self.spark.range(1).select(
            names, F.lit(run_id).alias("run_id"), ntz(started_at).alias("started_at"), ntz(finished_at).alias("finished_at"), written.alias("buckets")
        )
        self.log.add(f"published-{run_id}", rows)
        self.log.fold()
