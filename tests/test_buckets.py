"""Tables in buckets and the folded log: what a run writes, reads and shuffles."""

import datetime as dt
import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import history as HI
from lorekeep.operators.current import replace_rows
from lorekeep.plans.snapshot import SnapshotOptions, run_snapshot
from lorekeep.registry import queries
from lorekeep.sources import buckets as layout
from lorekeep.sources.buckets import read_buckets, touched_buckets, write_buckets
from lorekeep.sources.run_log import RunLog
from lorekeep.sources.warehouse import Warehouse

T0 = dt.datetime(2026, 1, 1, 12)
OPTIONS = SnapshotOptions(enable_health=False)


def raw(spark, n, **changes):
    rows = [(json.dumps({"access": "public", "id": f"i{k}", "title": f"Item {k}", **changes}), k) for k in n]
    return spark.createDataFrame(rows, "raw STRING, seq BIGINT")


def files(root):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def bucket_dirs(root, run):
    return {re.search(r"bucket=(\d+)", p)[1] for p in glob.glob(f"{root}/as_of_run={run}/**/*.parquet", recursive=True)}


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("buckets")), buckets=16)
    run_snapshot(w, raw(spark, range(300)), "r0", T0, T0, OPTIONS)
    return w


def test_a_run_of_one_item_writes_one_bucket(spark, warehouse):
    assert len(bucket_dirs(f"{warehouse.root}/items_current", "r0")) == 16
    before = {t: files(f"{warehouse.root}/{t}") for t in ("items_current", "items_history")}
    later = T0 + dt.timedelta(days=1)
    run_snapshot(warehouse, raw(spark, [7], owner="new"), "r1", later, later, OPTIONS)
    for table in before:
        after = files(f"{warehouse.root}/{table}")
        assert before[table].items() <= after.items()  # nothing old is touched
        assert len(bucket_dirs(f"{warehouse.root}/{table}", "r1")) == 1
    items = {r.item_id: (r.owner, r.last_seen_run_id) for r in warehouse.items_current().collect()}
    assert len(items) == 300 and items["i7"] == ("new", "r1") and items["i8"] == ("Unknown", "r0")
    versions = warehouse.items_history().collect()
    assert len(versions) == 301 and [(r.item_id, r.valid_to) for r in versions if not r.is_current] == [("i7", later)]
    assert {r.first_seen_run_id for r in versions if r.item_id == "i7"} == {"r0", "r1"}


def test_old_rows_are_not_shuffled(spark, warehouse):
    batch = warehouse.items_current().filter("item_id < 'i2'").withColumn("content_hash", F.lit("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for old, joined in (
            (warehouse.items_current(), replace_rows(warehouse.items_current(), batch.repartition(3))),
            (warehouse.open_versions(), HI.advance(warehouse.open_versions(), batch.repartition(3), "rX", T0)),
        ):
            text = joined._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(item_id", text)) == 1  # that of the batch
            above_scan = text[: text.index("FileScan")].splitlines()
            assert not any("Exchange" in line for line in above_scan), text
            assert "Bucketed: true" in text and "SelectedBucketsCount: 16 out of 16" in text
            assert joined.count() >= old.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lost_bucket_is_an_error(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("item_id"))
    write_buckets(rows, f"{tmp_path}/as_of_run=a", buckets=4)
    live = {b: "as_of_run=a" for b in touched_buckets(rows, buckets=4)}
    assert read_buckets(spark, str(tmp_path), live, rows.schema, buckets=4).count() == 100
    assert read_buckets(spark, str(tmp_path), {0: "as_of_run=a"}, rows.schema, buckets=4).count() < 100
    assert read_buckets(spark, str(tmp_path), {}, rows.schema, buckets=4).isEmpty()
    write_buckets(rows, f"{tmp_path}/a/as_of_run=a", buckets=4)  # a folder and a run of one name
    assert read_buckets(spark, f"{tmp_path}/a", live, rows.schema, buckets=4).count() == 100
    with pytest.raises(FileNotFoundError, match="as_of_run=b"):
        read_buckets(spark, str(tmp_path), live | {1: "as_of_run=b"}, rows.schema, buckets=4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lorekeep_")]


def test_replaced_rows_equal_an_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", None), (None, 5)], "item_id STRING, n INT")
    new = spark.createDataFrame([(7, "b"), (8, "c")], "n INT, item_id STRING")
    assert sorted(replace_rows(old, new).collect(), key=str) == sorted([("a", 1), ("b", 7), (None, 5), ("c", 8)], key=str)


def test_log_is_read_in_constant_time(spark, tmp_path):
    """After 500 runs one epoch is listed, and its directories stay few."""
    log = RunLog(spark, str(tmp_path), fold=20)
    for n in range(500):
        log.add(f"published-r{n}", spark.sql(f"SELECT 'runs' AS table_name, 'r{n}' AS run_id, array({n % 3}) AS buckets"))
        if n % 20 == 19:
            log.fold()
    assert log.entries().select("run_id").distinct().count() == 500
    fresh = RunLog(spark, str(tmp_path), fold=20)
    assert fresh.epoch() == 25 == log.epoch()
    assert len(os.listdir(fresh.folder(25))) <= 2 * 20 + 2
    read = {re.search(r"epoch=\d+", p)[0] for p in fresh.entries().inputFiles()}
    assert read == {"epoch=000025"}


def test_a_fold_that_failed_is_written_again(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), buckets=4, fold=2)
    for n in range(2):
        at = T0 + dt.timedelta(days=n)
        run_snapshot(w, raw(spark, [n]), f"r{n}", at, at, OPTIONS)
    assert w.log.epoch() == 1
    # An unfinished next epoch is not looked at.
    spark.range(1).selectExpr("'lost' as run_id").write.parquet(f"{w.log.folder(2)}/before")
    assert Warehouse(spark, str(tmp_path), buckets=4, fold=2).log.epoch() == 1
    for n in range(2, 5):
        at = T0 + dt.timedelta(days=n)
        run_snapshot(w, raw(spark, [n]), f"r{n}", at, at, OPTIONS)
    assert w.log.epoch() == 2
    assert {r.run_id for r in w.runs().collect()} == {f"r{n}" for n in range(5)}
    assert w.items_current().count() == 5 and w.items_history().count() == 5


def test_change_feed(spark, warehouse):
    """The feed between two runs is the difference of the full histories."""
    rows = {(r.run_id, r.change, r.item_id, r.valid_to) for r in warehouse.change_feed("r0").collect()}
    later = T0 + dt.timedelta(days=1)
    assert rows == {("r1", "closed", "i7", later), ("r1", "opened", "i7", None)}
    again = T0 + dt.timedelta(days=2)
    run_snapshot(warehouse, raw(spark, [7, 8], owner="new"), "r2", again, again, OPTIONS)
    rows = {(r.change, r.item_id, r.first_seen_run_id, r.last_seen_run_id) for r in warehouse.change_feed("r1").collect()}
    assert rows == {("touched", "i7", "r1", "r2"), ("opened", "i8", "r2", "r2"), ("closed", "i8", "r0", "r0")}
    first = warehouse.change_feed(None, "r0")
    assert first.count() == 300 and {r.change for r in first.select("change").distinct().collect()} == {"opened"}
    assert warehouse.change_feed("r2").isEmpty()
    folders = {re.search(r"as_of_run=(\w+)", p)[1] for p in warehouse.change_feed("r1", "r2").inputFiles()}
    assert folders == {"r2"}


def test_buckets_number_with_the_bytes(spark, monkeypatch):
    """A bucket is read by one task, so it may not grow with the table."""
    rows = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("raw"))
    size = F.octet_length("raw")
    assert layout.buckets_for(rows, size, 8) == 8
    monkeypatch.setattr(layout, "BUCKET_BYTES", 2000)
    assert layout.buckets_for(rows, size, 8) == 50 and layout.buckets_for(rows.limit(0), size, 8) == 8


def test_queries_on_larger_tables_have_more_buckets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_BYTES", 10_000)
    given = []
    monkeypatch.setattr(queries.layout, "buckets_for", lambda *a, made=layout.buckets_for: given.append(made(*a)) or given[-1])
    assert queries.QUERIES["upsert_current"](spark, sf_dir).count() > 0
    assert queries.item_buckets(spark, sf_dir) > queries.BUCKETS and all(n > queries.BUCKETS for n in given)
