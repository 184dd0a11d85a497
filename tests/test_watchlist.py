"""Watchlist replay, upsert and removal against a plain Python list."""

import datetime as dt
import random

from lorekeep.operators import watchlist as W
from lorekeep.schemas import WATCHLIST_ITEMS

LOG = (
    "seq BIGINT, action STRING, item_id STRING, item_url STRING, title STRING, item_type STRING, owner STRING, "
    "source_query STRING, added_at TIMESTAMP_NTZ, notes STRING"
)
T0 = dt.datetime(2024, 1, 1)


def random_log(seed, n=300, items=7):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        item = "hot" if rng.random() < 0.4 else f"i{rng.randrange(items)}"
        action = "remove" if rng.random() < 0.15 else "save"
        notes = f"n{seq}" if rng.random() < 0.3 else None
        source = f"q{seq}" if rng.random() < 0.8 else None
        rows.append((seq, action, item, f"u{seq}", f"t{seq}", "x", None, source, T0 + dt.timedelta(minutes=seq), notes))
    rng.shuffle(rows)
    return rows


def expected(rows, start=None):
    items = dict(start or {})
    for r in sorted(rows):
        seq, action, item, url, title, kind, owner, source, added, notes = r
        if action == "remove":
            items.pop(item, None)
            continue
        old = items.get(item)
        items[item] = (item, url, title, kind, owner, old[5] if old else source, added, notes or (old and old[7]))
    return items


def by_id(df):
    return {r.item_id: tuple(r) for r in df.select(*WATCHLIST_ITEMS.names).collect()}


def test_replay_equals_one_by_one(spark):
    for seed in (1, 2):
        rows = random_log(seed)
        log = spark.createDataFrame(rows, LOG)
        assert by_id(W.replay(log)) == expected(rows)
        spread = log.selectExpr("seq * 1000000000 AS seq", *[c for c in log.columns if c != "seq"])
        assert by_id(W.replay(spread)) == expected(rows)


def test_apply_log_continues_a_list(spark):
    first, second = random_log(3, 100), random_log(4, 80)
    start = expected(first)
    saved = spark.createDataFrame(list(start.values()), WATCHLIST_ITEMS)
    assert by_id(W.apply_log(saved, spark.createDataFrame(second, LOG))) == expected(second, start)


def test_upsert_list_remove_round_trip(spark):
    empty = spark.createDataFrame([], WATCHLIST_ITEMS)
    one = spark.createDataFrame([("a", "u1", "t1", "k", "o", "q1", T0, "note")], WATCHLIST_ITEMS)
    again = spark.createDataFrame([("a", None, "t2", "k", "o", "q2", T0 + dt.timedelta(1), None), ("b", "u", "t", "k", "o", None, T0, None)], WATCHLIST_ITEMS)
    saved = W.upsert(W.upsert(empty, one), again)
    assert by_id(saved)["a"] == ("a", None, "t2", "k", "o", "q1", T0 + dt.timedelta(1), "note")
    listed = W.listing(saved)
    assert listed.columns == ["id", "url", "title", "type", "owner", "source_query", "added_at", "notes"]
    assert [r.id for r in listed.collect()] == ["a", "b"]
    left = W.remove(saved, one.select("item_id"))
    assert set(by_id(left)) == {"b"}
    assert W.listing(empty).isEmpty()
