"""Content search over items and ranking of the hits.

A search for a text looks at every item's content, or first at an index: :func:`postings` lists for each word the items that hold
it. An item that holds a text holds words that begin, are and end as the parts of the text do, so only items with all of these
are read and compared. The index is far smaller than the contents, as a word stands once per item and sorted words compress well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import hit_score

HIT_COLUMNS = ("title", "id", "type", "owner", "modified", "tags", "url", "snippet", "description")


def searched_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", "snippet", "description", F.array_join("tags", " ")))


def search_items(
    items: DataFrame, query: str, item_type: str | None = "Feature Layer", max_items: int | None = 5
) -> DataFrame:
    """Items of a type whose title, snippet, description or tags contain the text, the first ones by ``hit_no``.

    No type searches all, and no limit returns all hits.
    """
    hits = items
    if item_type:
        hits = hits.filter(F.col("type") == item_type)
    if query:
        hits = hits.filter(searched_text().contains(query.lower()))
    hits = hits.select("hit_no", *HIT_COLUMNS)
    return hits if max_items is None else hits.orderBy("hit_no").limit(max_items)


RUN_WORDS = 1_000_000  # postings that are sorted at once
PART = 100_000


def words_held() -> Column:
    return F.array_distinct(F.split(searched_text(), " "))


def postings(items: DataFrame) -> DataFrame:
    """(word, id): every run of characters between blanks in an item's content, once per item."""
    return items.select(F.explode(words_held()).alias("word"), "id")


def sorted_runs(run_words: int, part: int) -> Callable:
    """:func:`postings` of rows (words, id), sorted in runs of about ``run_words`` of them, or of one item."""

    def rank(values: pa.Array) -> np.ndarray:
        place = np.empty(len(values), dtype=np.int64)
        place[pc.array_sort_indices(values).to_numpy()] = np.arange(len(values))
        return place

    def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays([b.column(0) for b in held])
        ids = pa.concat_arrays([b.column(1) for b in held])
        words = lists.flatten().dictionary_encode()
        item = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        code = words.indices.to_numpy()
        order = np.lexsort((rank(ids)[item], rank(words.dictionary)[code]))
        for at in range(0, len(order), part):
            chosen = order[at : at + part]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[chosen])), ids.take(pa.array(item[chosen]))], ["word", "id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + run_words - size, "right")) - 1)
                held.append(batch.slice(at, end - at))
                size += int(ends[end] - ends[at])
                at = end
                if size >= run_words or at < batch.num_rows:
                    yield from run(held)
                    held, size = [], 0
        if held:
            yield from run(held)

    return find


def write_postings(items: DataFrame, path: str) -> DataFrame:
    """The index of ``items``: every task writes the lists of its own items, without a shuffle, in runs in the order of the words.
    A run is sorted in memory whatever a task reads, and the pages of a run know the words they hold."""
    types = dict(postings(items).dtypes)
    listed = items.select(words_held().alias("words"), "id").mapInArrow(sorted_runs(RUN_WORDS, PART), f"word string, id {types['id']}")
    listed.write.mode("overwrite").parquet(path)
    return items.sparkSession.read.schema(listed.schema).parquet(path)


def candidates(index: DataFrame, query: str) -> DataFrame:
    """Ids of the items that may hold the text.

    A text without a blank lies within a word. Of one with blanks the first part ends a word, the last one begins a word, and
    those between are words.
    """
    parts, word = query.lower().split(" "), F.col("word")
    needed = [word.contains(parts[0])]
    if len(parts) > 1:
        needed = [word == p for p in sorted(set(parts[1:-1]))]
        needed += [word.endswith(parts[0])] if parts[0] else []
        needed += [word.startswith(parts[-1])] if parts[-1] else []
    if not needed:
        return index.select("id").distinct()
    some = index.filter(reduce(or_, needed)).groupBy("id").agg(*[F.bool_or(c).alias(f"has_{k}") for k, c in enumerate(needed)])
    return some.filter(reduce(and_, [F.col(f"has_{k}") for k in range(len(needed))])).select("id")


def search_indexed(
    items: DataFrame, index: DataFrame, query: str, item_type: str | None = "Feature Layer", max_items: int | None = 5
) -> DataFrame:
    """:func:`search_items` over the items that the index names for the text."""
    chosen = items.join(candidates(index, query), "id", "left_semi") if query else items
    return search_items(chosen, query, item_type, max_items)


def score_hits(hits: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("title", "snippet", "description", "tags")]
    return hits.withColumn("quality_score", hit_score(*columns))


def rank_hits(hits: DataFrame, by_quality: bool = True) -> DataFrame:
    """Scored hits in display order: best first when asked for, else as found."""
    scored = score_hits(hits)
    return scored.orderBy(F.desc("quality_score"), "hit_no") if by_quality else scored.orderBy("hit_no")


def mark_saved(hits: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Add ``is_saved``: is the hit on the watchlist."""
    saved = watchlist.select(F.col("item_id").alias("id"), F.lit(True).alias("is_saved")).distinct()
    return hits.join(saved, "id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))
