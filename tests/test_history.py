"""Upsert and versioned history against a plain Python replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import current as C
from lorekeep.operators import history as H

HISTORY = (
    "item_id STRING, content_hash STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, "
    "content STRING, first_seen_run_id STRING, last_seen_run_id STRING"
)
START = dt.datetime(2024, 1, 1)


def replay(batches):
    """Reference result: list of versions after applying {item: content} batches in order."""
    versions, open_ = [], {}
    for n, batch in enumerate(batches):
        run, at = f"r{n:02d}", START + dt.timedelta(days=n)
        for item, content in batch.items():
            now = open_.get(item)
            if now and now[1] == content:
                now[7] = run
                continue
            if now:
                now[3], now[4] = at, False
            open_[item] = [item, content, at, None, True, content, run, run]
            versions.append(open_[item])
    return sorted(tuple(v) for v in versions)


def random_batches(seed, runs=6, items=12):
    rng = random.Random(seed)
    return [
        {f"i{k}": rng.choice("ABC") for k in range(items) if rng.random() < 0.6} for _ in range(runs)
    ]


def batch_frame(spark, batch):
    rows = [(i, c, c) for i, c in batch.items()]
    return spark.createDataFrame(rows, "item_id STRING, content_hash STRING, content STRING")


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_apply_and_rebuild_agree_with_replay(spark, seed, tmp_path):
    batches = random_batches(seed)
    expected = key(replay(batches))
    history = spark.createDataFrame([], HISTORY)
    for n, batch in enumerate(batches):
        applied = H.apply_batch(
            history, batch_frame(spark, batch), f"r{n:02d}", START + dt.timedelta(days=n), ["content"]
        )
        path = str(tmp_path / f"v{n}")
        applied.write.parquet(path)
        history = spark.read.parquet(path)
    assert key(history.collect()) == expected

    seen = [(i, f"r{n:02d}", c, c) for n, b in enumerate(batches) for i, c in b.items()]
    observations = spark.createDataFrame(seen, "item_id STRING, run_id STRING, content_hash STRING, content STRING")
    runs = spark.createDataFrame(
        [(f"r{n:02d}", START + dt.timedelta(days=n)) for n in range(len(batches))], "run_id STRING, started_at TIMESTAMP_NTZ"
    )
    rebuilt = H.rebuild(observations, runs, ["content"])
    assert key(rebuilt.collect()) == expected

    # Invariants: one open version per item, intervals meet without overlap.
    last = {}
    for v in expected:
        if v[0] in last:
            assert last[v[0]][3] == v[2] and not last[v[0]][4]
        last[v[0]] = v
    assert all(v[4] and v[3] is None for v in last.values())


def test_same_batch_again_adds_no_version(spark):
    first = H.apply_batch(spark.createDataFrame([], HISTORY), batch_frame(spark, {"a": "A", "b": "B"}), "r1", START, ["content"])
    again = H.apply_batch(first, batch_frame(spark, {"a": "A"}), "r2", "2024-01-02 00:00:00", ["content"])
    assert {r.item_id: r.last_seen_run_id for r in again.collect()} == {"a": "r2", "b": "r1"}


def test_returning_content_opens_a_third_version(spark):
    batches = [{"a": "A"}, {"a": "B"}, {"a": "A"}]
    history = spark.createDataFrame([], HISTORY)
    for n, b in enumerate(batches):
        history = H.apply_batch(history, batch_frame(spark, b), f"r{n:02d}", START + dt.timedelta(days=n), ["content"])
    assert key(history.collect()) == key(replay(batches))
    assert history.count() == 3


def test_rebuild_reduces_repeated_sightings(spark):
    rows = [("a", "r1", "A", "A", 1), ("a", "r1", "B", "B", 2), ("a", "r2", "B", "B", 3)]
    seen = spark.createDataFrame(rows, "item_id STRING, run_id STRING, content_hash STRING, content STRING, seq INT")
    runs = spark.createDataFrame([("r1", START), ("r2", START + dt.timedelta(1))], "run_id STRING, started_at TIMESTAMP_NTZ")
    (row,) = H.rebuild(seen, runs, ["content"], ["seq"]).collect()
    assert (row.content, row.first_seen_run_id, row.last_seen_run_id) == ("B", "r1", "r2")


def test_changes_of_run(spark):
    batches = [{"a": "A", "b": "B"}, {"a": "X", "c": "C"}, {"c": "D"}]
    history = spark.createDataFrame(replay(batches), HISTORY)
    get = lambda *a, **k: {r.item_id: r.change_type for r in H.changes_of_run(history, *a, **k).collect()}
    assert get("r00") == {"a": "Modified", "b": "New"}  # a later run changed "a"
    assert get("r01") == {"a": "Modified", "c": "Modified"}
    assert get("r01", limit=1) == {"a": "Modified"}
    earlier = spark.createDataFrame([("r00",)], "run_id STRING")
    assert get("r01", earlier=earlier) == {"a": "Modified", "c": "New"}


def test_latest_and_previous_run(spark):
    runs = spark.createDataFrame(
        [("r1", START, START), ("r2", START + dt.timedelta(1), None), ("r3", START - dt.timedelta(1), START)],
        "run_id STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ",
    )
    assert H.latest_run(runs).first().run_id == "r2"  # unfinished ones count
    assert H.previous_run(runs, "r1").first().run_id == "r3"
    assert H.previous_run(runs, "r3").isEmpty()


def test_upsert_replaces_whole_rows_and_last_one_wins(spark):
    current = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "item_id STRING, title STRING, n INT")
    batch = spark.createDataFrame(
        [("a", "x", 5, 0), ("a", None, 6, 2), ("a", "y", 7, 1), ("c", "c", 8, 3)], "item_id STRING, title STRING, n INT, seq INT"
    )
    last = C.last_in_batch(batch, "seq").drop("seq")
    rows = {r.item_id: (r.title, r.n) for r in C.upsert_current(current, last).collect()}
    assert rows == {"a": (None, 6), "b": ("old", 1), "c": ("c", 8)}


def test_hot_item_in_batch_is_reduced_before_the_shuffle(spark):
    df = spark.range(0, 30000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("item_id"), F.col("id").alias("seq")
    )
    last = C.last_in_batch(df, "seq")
    assert last.filter("item_id = 'hot'").first().seq == 29997
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
