"""Saved items. The list is the outcome of save and remove actions in ``seq`` order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import WATCHLIST_ITEMS

# Columns of the list as shown and exported.
EXPORT_NAMES = {
    "item_id": "id", "item_url": "url", "title": "title", "item_type": "type",
    "owner": "owner", "source_query": "source_query", "added_at": "added_at", "notes": "notes",
}
_LATEST = ("item_url", "title", "item_type", "owner", "added_at")


def replay(log: DataFrame) -> DataFrame:
    """Saved items after all actions of ``log`` (seq, action, watchlist columns).

    Saving again overwrites everything but ``source_query`` (first one kept) and ``notes`` (kept
    when not given); removing forgets the item, so only the saves after its last removal count.

    The last removal per item and the outcome of the saves behind it are both aggregates that tasks
    reduce before the shuffle, and the join between them can be split, so an item that has a large
    share of the log is no single task, however its ``seq`` values lie.
    """
    removed = log.filter("action = 'remove'").groupBy("item_id").agg(F.max("seq").alias("removed_seq"))
    saves = log.filter("action = 'save'").join(removed, "item_id", "left")
    live = saves.filter("removed_seq IS NULL OR seq > removed_seq")
    notes_seq = F.when(F.col("notes").isNotNull(), F.col("seq"))
    whole = live.groupBy("item_id").agg(
        F.max_by(F.struct(*_LATEST), "seq").alias("latest"),
        F.min_by("source_query", "seq").alias("source_query"),
        F.max_by("notes", notes_seq).alias("notes"),
    )
    return whole.select("item_id", "latest.*", "source_query", "notes").select(*WATCHLIST_ITEMS.names)


def apply_log(watchlist: DataFrame, log: DataFrame) -> DataFrame:
    """Saved items after further actions: what is saved already counts as saved before them.

    ``seq`` of the log starts at 0.
    """
    before = watchlist.withColumns({"seq": F.lit(-1).cast("bigint"), "action": F.lit("save")})
    columns = ["seq", "action", *WATCHLIST_ITEMS.names]
    return replay(before.select(*columns).unionByName(log.select(*columns)))


def upsert(watchlist: DataFrame, saved: DataFrame) -> DataFrame:
    """Save rows, one per item: keep the first ``source_query``, and the notes when none are given."""
    new = saved.select(*WATCHLIST_ITEMS.names).alias("new")
    old = watchlist.select(*WATCHLIST_ITEMS.names).alias("old")
    given = F.col("new.item_id").isNotNull()
    known = F.col("old.item_id").isNotNull()

    def column(name: str):
        if name == "source_query":
            value = F.when(known, F.col("old.source_query")).otherwise(F.col("new.source_query"))
        elif name in ("item_id", "notes"):
            value = F.coalesce(f"new.{name}", f"old.{name}")
        else:
            value = F.when(given, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        return value.alias(name)

    joined = old.join(new, F.col("old.item_id") == F.col("new.item_id"), "full_outer")
    return joined.select(*[column(n) for n in WATCHLIST_ITEMS.names])


def remove(watchlist: DataFrame, items: DataFrame) -> DataFrame:
    return watchlist.join(items.select("item_id"), "item_id", "left_anti").select(*watchlist.columns)


def listing(watchlist: DataFrame) -> DataFrame:
    """Newest first, under the export names."""
    ordered = watchlist.orderBy(F.desc("added_at"), "item_id")
    return ordered.select(*[F.col(c).alias(n) for c, n in EXPORT_NAMES.items()])
