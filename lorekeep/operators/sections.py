"""All sections of a report that look at items, by one pass over them.

Every item, and every failed check of the run with its item, becomes one row per section it belongs to. One aggregate then
serves lists and totals: rows of a list are groups of their own, owners and the catalog as a whole are sums.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.predicates import in_run
from .issues import ITEM_COLUMNS, capped

LISTS = ("missing_tags", "missing_description", "missing_extent", "stale_items", "broken_services")
CHECK = ("checked_url", "status_code", "error_message")
COUNTS = ("total_items", "missing_tags", "missing_description", "stale")
#: Columns of a list, and of the sums.
COLUMNS = {
    **{name: ITEM_COLUMNS for name in LISTS},
    "stale_items": (*ITEM_COLUMNS, "modified_at"),
    "broken_services": (*ITEM_COLUMNS, *CHECK),
    "owner_summary": ("owner", *COUNTS),
    "totals": COUNTS,
}


def section_rows(items: DataFrame, health: DataFrame, run_id: str, as_of: datetime | str) -> DataFrame:
    """Rows of all sections: ``section``, the columns of lists (null where a section has none) and the counts of sums.

    An item is read once. A check of an item the catalog does not have is left out, repeated checks are rows each.
    """
    failed = health.filter(in_run(run_id) & P.broken()).select(
        "item_id", F.struct(*CHECK, F.monotonically_increasing_id().alias("check_no")).alias("check")
    )
    # An item with failed checks meets these and one row without, which stands for the item itself.
    failed = failed.select("item_id", F.explode(F.array("check", F.lit(None))).alias("check")).distinct()
    rows = items.select(*ITEM_COLUMNS, "modified_at", "tags_count", "has_description", "has_extent").join(failed, "item_id", "left")
    rows = rows.withColumns(
        {"no_tags": P.missing_tags(), "no_description": P.missing_description(), "is_stale": F.coalesce(P.stale(as_of), F.lit(False))}
    )
    is_item = F.col("check").isNull()
    belongs = {
        "missing_tags": is_item & F.col("no_tags"),
        "missing_description": is_item & F.col("no_description"),
        "missing_extent": is_item & P.missing_extent(),
        "stale_items": is_item & F.col("is_stale"),
        "broken_services": ~is_item,
        "owner_summary": is_item,
        "totals": is_item,
    }
    sections = F.array_compact(F.array(*[F.when(found, F.lit(name)) for name, found in belongs.items()]))
    rows = rows.withColumn("section", F.explode(sections))
    listed, of = F.col("section").isin(*LISTS), lambda name: F.col("section") == name

    def key(name: str, shown: Column) -> Column:
        return F.when(shown, F.col(name)).alias(name.rpartition(".")[2])

    keys = [
        "section", key("item_id", listed), key("title", listed), key("owner", ~of("totals")), key("modified_at", of("stale_items")),
        *[key(f"check.{name}", of("broken_services")) for name in (*CHECK, "check_no")],
    ]
    flags = {"missing_tags": "no_tags", "missing_description": "no_description", "stale": "is_stale"}
    narrow = rows.select(*keys, *flags.values())
    grouped = narrow.groupBy("section", *ITEM_COLUMNS, "modified_at", *CHECK, "check_no")
    counted = grouped.agg(F.count("*").alias("total_items"), *[F.count_if(F.col(flag)).alias(name) for name, flag in flags.items()])
    sums = {name: F.when(~F.col("section").isin(*LISTS), F.col(name)) for name in COUNTS}
    return counted.withColumns(sums).drop("check_no")


def section(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """One section of :func:`section_rows`, the first rows only if a limit is given."""
    chosen = rows.filter(F.col("section") == name).select(*COLUMNS[name])
    order = (F.desc("total_items"), F.asc_nulls_last("owner")) if name == "owner_summary" else ("item_id",)
    return capped(chosen, limit, *order)
