"""Tables of items in one directory per bucket, where a bucket's newest directory replaces its older ones.

The bucket is Spark's own for bucketed tables, ``pmod(hash(item_id), n)``. A writer gives only the buckets it touched; readers
get the directories that are live. They are read as a bucketed table, so a join by item_id shuffles the other side only.

Spark knows buckets of catalog tables only, so a table is declared for the moment of reading or writing and dropped again (its
files stay). Its location names all live directories; that is for Spark's own session catalog, as an external metastore may
limit the length of a location.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET_BYTES = 32 << 20


def bucket_of(key: str = "item_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")


def buckets_for(rows: DataFrame, size: Column, least: int = BUCKETS) -> int:
    """How many buckets a table of these rows needs so that one holds about BUCKET_BYTES of their ``size``."""
    return max(least, math.ceil((rows.agg(F.sum(size)).first()[0] or 0) / BUCKET_BYTES))


def touched_buckets(rows: DataFrame, key: str = "item_id", buckets: int = BUCKETS) -> list[int]:
    """The buckets of some rows, at most ``buckets`` numbers."""
    return sorted(r["bucket"] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def _dropped(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files of a table with a path stay


def write_buckets(rows: DataFrame, path: str, *partition_by: str, key: str = "item_id", buckets: int = BUCKETS) -> None:
    """Write ``path``/…/bucket=…; a file per bucket and task, so one where ``rows`` come from a join of bucketed tables."""
    name = f"lorekeep_{uuid.uuid4().hex}"
    writer = rows.withColumn("bucket", bucket_of(key, buckets)).write.mode("overwrite").option("path", path)
    try:
        writer.partitionBy(*partition_by, "bucket").bucketBy(buckets, key).format("parquet").saveAsTable(name)
    finally:
        _dropped(rows.sparkSession, name)


def read_buckets(
    spark: SparkSession,
    root: str,
    live: Mapping[int, str],
    schema: StructType,
    key: str = "item_id",
    buckets: int = BUCKETS,
    complete: bool = True,
) -> DataFrame:
    """The rows below ``root`` of the live directory of every bucket: ``live`` has their paths relative to ``root``. Unless the
    table is ``complete``, buckets without a directory have no rows."""
    if not live:
        return spark.createDataFrame([], schema)
    folders = [f"{live[b]}/bucket={b}".lstrip("/") for b in sorted(live)]
    location = f"{root}/{{{','.join(folders)}}}" if len(folders) > 1 else f"{root}/{folders[0]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"lorekeep_{uuid.uuid4().hex}"
    location = location.replace("'", "\\'")
    try:
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'")
        rows = spark.table(name)
        depth = folders[0].count("/") + 1
        found = {"/".join(path.split("/")[-1 - depth : -1]) for path in rows.inputFiles()}
    finally:
        _dropped(spark, name)
    gone = set(folders) - found
    if gone and complete:  # a live directory that is gone is an error, not an empty bucket
        raise FileNotFoundError(f"{root} lacks {sorted(gone)[:3]}")
    return rows
