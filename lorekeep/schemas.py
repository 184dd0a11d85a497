"""Declared schemas of the warehouse tables (all times zone-less UTC)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
}


def _schema(columns: str) -> T.StructType:
    """Flat schema from ``name TYPE`` pairs; unlike Spark's DDL parser it needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_EXTENT = "extent_xmin DOUBLE, extent_ymin DOUBLE, extent_xmax DOUBLE, extent_ymax DOUBLE"

RUNS = _schema(
    "run_id STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, source STRING, "
    "portal_url STRING, org_id STRING, triggered_by STRING, pipeline_version STRING"
)

ITEMS_CURRENT = _schema(
    "item_id STRING, title STRING, item_type STRING, owner STRING, url STRING, access STRING, "
    "created_at TIMESTAMP_NTZ, modified_at TIMESTAMP_NTZ, tags_json STRING, tags_count INT, "
    "snippet STRING, snippet_len INT, description STRING, description_len INT, thumbnail STRING, "
    f"has_thumbnail BOOLEAN, {_EXTENT}, has_extent BOOLEAN, has_description BOOLEAN, "
    "num_views BIGINT, content_hash STRING, last_seen_run_id STRING, last_seen_at TIMESTAMP_NTZ"
)

ITEMS_HISTORY = _schema(
    "item_id STRING, content_hash STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, "
    "is_current BOOLEAN, title STRING, item_type STRING, owner STRING, url STRING, access STRING, "
    "modified_at TIMESTAMP_NTZ, tags_json STRING, description_len INT, has_extent BOOLEAN, "
    f"{_EXTENT}, first_seen_run_id STRING, last_seen_run_id STRING"
)

QUALITY_SCORES = _schema(
    "run_id STRING, item_id STRING, score INT, breakdown_json STRING, missing_json STRING, "
    "computed_at TIMESTAMP_NTZ"
)

HEALTH_CHECKS = _schema(
    "run_id STRING, item_id STRING, checked_url STRING, ok BOOLEAN, status_code INT, "
    "latency_ms INT, error_message STRING, checked_at TIMESTAMP_NTZ"
)

# Declared for completeness of the data model; no operator reads or writes graph edges.
RELATIONSHIPS = _schema(
    "run_id STRING, src_item_id STRING, dst_item_id STRING, relationship_type STRING"
)

WATCHLIST_ITEMS = _schema(
    "item_id STRING, item_url STRING, title STRING, item_type STRING, owner STRING, "
    "source_query STRING, added_at TIMESTAMP_NTZ, notes STRING"
)

# Columns that describe a version's life rather than its content.
HISTORY_CONTROL = (
    "item_id", "content_hash", "valid_from", "valid_to", "is_current",
    "first_seen_run_id", "last_seen_run_id",
)
HISTORY_ATTRIBUTES = tuple(c for c in ITEMS_HISTORY.names if c not in HISTORY_CONTROL)
