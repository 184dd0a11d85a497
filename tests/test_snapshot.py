"""Whole runs on a warehouse: publication, failure, repetition, reports, remediation, streaming."""

import csv
import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import history as HI
from lorekeep.plans import remediation_pack, report, status
from lorekeep.plans.snapshot import SnapshotOptions, run_snapshot
from lorekeep.sources import exports
from lorekeep.sources.warehouse import Warehouse
from lorekeep.streaming.continuous import continuous_snapshot, default_checkpoint, raw_stream

T0 = dt.datetime(2026, 1, 1, 12)


def offline():
    """A fetch without network; a local function, as workers cannot import the test module."""

    def fetch(method, url, timeout):
        if "bad" in url:
            raise OSError(f"no route to {url}")
        return (404 if "lost" in url else 200), 0.25

    return fetch


OPTIONS = SnapshotOptions(fetch=offline(), probe_partitions=2)


def raw(spark, *items):
    rows = [(json.dumps({"access": "public", **i}), n) for n, i in enumerate(items)]
    return spark.createDataFrame(rows, "raw STRING, seq BIGINT")


A = {"id": "a", "title": "Alpha", "owner": "x", "url": "http://ok", "tags": ["t"], "description": "d", "modified": 1}
B = {"id": "b", "title": "Beta", "owner": "x", "url": "http://bad", "tags": [], "modified": 1767000000000}
C = {"id": "c", "title": "Gamma", "owner": "y", "url": "http://lost"}
BATCHES = [
    [A, B, {"id": None}, {**A, "title": "Alpha 2"}],
    [{**A, "title": "Alpha 2"}, C, {"id": "p", "access": "private"}],
    [],
    [{**A, "title": "Alpha 3"}],
]


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    for n, batch in enumerate(BATCHES):
        at = T0 + dt.timedelta(days=n)
        assert run_snapshot(w, raw(spark, *batch), f"r{n}", at, at + dt.timedelta(minutes=1), OPTIONS)
    return w


def test_current_items(warehouse):
    rows = {r.item_id: (r.title, r.last_seen_run_id) for r in warehouse.items_current().collect()}
    assert rows == {"a": ("Alpha 3", "r3"), "b": ("Beta", "r0"), "c": ("Gamma", "r1")}


def test_history(warehouse):
    rows = {
        (r.item_id, r.first_seen_run_id): (r.title, r.valid_from, r.valid_to, r.is_current, r.last_seen_run_id)
        for r in warehouse.items_history().collect()
    }
    day = lambda n: T0 + dt.timedelta(days=n)
    assert rows == {
        ("a", "r0"): ("Alpha 2", day(0), day(3), False, "r1"),
        ("a", "r3"): ("Alpha 3", day(3), None, True, "r3"),
        ("b", "r0"): ("Beta", day(0), None, True, "r0"),
        ("c", "r1"): ("Gamma", day(1), None, True, "r1"),
    }


def test_runs_scores_and_checks(warehouse):
    runs = {r.run_id: r.finished_at for r in warehouse.runs().collect()}
    assert runs == {f"r{n}": T0 + dt.timedelta(days=n, minutes=1) for n in range(4)}
    assert {(r.run_id, r.item_id) for r in warehouse.quality_scores().collect()} == {
        ("r0", "a"), ("r0", "b"), ("r1", "a"), ("r1", "c"), ("r3", "a"),
    }
    checks = {r.item_id: (r.ok, r.status_code, r.error_message) for r in warehouse.health_checks("r0").collect()}
    assert checks == {"a": (True, 200, None), "b": (False, None, "no route to http://bad")}
    assert warehouse.health_checks("r1").filter("item_id = 'c'").first().error_message == "HTTP 404"


def test_rejects_are_kept(spark, warehouse):
    rejects = spark.read.parquet(f"{warehouse.root}/rejects/as_of_run=r0").collect()
    assert [(r.seq, r.reason) for r in rejects] == [(2, "no item id")]


def test_published_run_is_not_repeated(spark, warehouse):
    before = warehouse.items_current().count()
    assert not run_snapshot(warehouse, raw(spark, C), "r3", T0, T0, OPTIONS)
    assert warehouse.items_current().count() == before


def test_runs_move_forward_in_time(spark, warehouse):
    with pytest.raises(ValueError, match="not after run"):
        run_snapshot(warehouse, raw(spark, C), "late", T0, T0, OPTIONS)
    with pytest.raises(ValueError, match="characters"):
        run_snapshot(warehouse, raw(spark, C), "a/b", T0 + dt.timedelta(9), T0, OPTIONS)


def test_failed_run_leaves_tables_alone_and_can_be_repeated(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    run_snapshot(w, raw(spark, A), "r0", T0, T0, OPTIONS)
    later = T0 + dt.timedelta(days=1)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    real, w.write_children = w.write_children, broken
    with pytest.raises(RuntimeError):
        run_snapshot(w, raw(spark, {**A, "title": "New"}), "r1", later, later, OPTIONS)
    w.write_children = real
    assert w.items_current().first().title == "Alpha"
    assert [r.is_current for r in w.items_history().collect()] == [True]
    assert {r.run_id: r.finished_at is None for r in w.runs().collect()} == {"r0": False, "r1": True}
    assert run_snapshot(w, raw(spark, {**A, "title": "New"}), "r1", later + dt.timedelta(5), later, OPTIONS)
    closed = w.items_history().filter("NOT is_current").first()
    assert closed.valid_to == later  # the start the run was opened with
    assert w.items_history().count() == 2


def test_switches(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    options = SnapshotOptions(query="true", item_types=["Map"], enable_history=False, enable_scores=False, enable_health=False)
    run_snapshot(w, raw(spark, {**A, "type": "Map"}, B), "r0", T0, T0, options)
    assert [r.item_id for r in w.items_current().collect()] == ["a"]
    assert w.items_history().isEmpty() and w.quality_scores().isEmpty() and w.health_checks().isEmpty()


def rows_of(path):
    out = []
    for name in sorted(glob.glob(os.path.join(path, "part-*.csv"))):
        with open(name, newline="", encoding="utf-8") as f:
            out.append(list(csv.reader(f)))
    return out


def test_report(spark, warehouse, tmp_path):
    as_of = T0 + dt.timedelta(days=4)
    result = report.generate_report(warehouse, str(tmp_path), as_of, "r1")
    assert result["ok"] and len(result["csv_paths"]) == 6
    assert os.path.basename(result["csv_paths"][0]) == "catalog_health_2026-01-02_r1_missing_tags"
    frames = result["frames"]
    assert list(frames["snapshot_summary"].first()) == [3, 2, 2]  # all items, those of the run
    changes = {r.item_id: r.change_type for r in frames["changes"].collect()}
    assert changes == {"c": "New"}
    stale = rows_of(f"{tmp_path}/catalog_health_2026-01-02_r1_stale_items")
    assert [r for part in stale for r in part[1:]] == [["a", "Alpha 3", "x", "1970-01-01 00:00:00.001"]]
    for path in result["csv_paths"]:  # a header in any case
        assert all(part[0][0] in ("item_id", "title", "owner") for part in rows_of(path))
        assert rows_of(path)


def test_first_run_reports_no_changes_and_missing_run_is_an_error(warehouse, tmp_path):
    as_of = T0 + dt.timedelta(days=4)
    first = report.generate_report(warehouse, str(tmp_path), as_of, "r0")
    assert first["frames"]["changes"].isEmpty()
    assert report.generate_report(warehouse, str(tmp_path), as_of, "nope") == {"ok": False, "error": "Run ID nope not found."}
    verified = report.generate_report(warehouse, str(tmp_path / "none"), as_of, verify_only=True)
    assert verified == {"ok": True, "verified": True, "run_id": "r3"} and not (tmp_path / "none").exists()


def test_empty_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    assert not report.generate_report(w, str(tmp_path), T0)["ok"]
    assert not remediation_pack.generate_pack(w, str(tmp_path), T0)["ok"]
    assert status.status(w).isEmpty()


def test_remediation_pack(spark, warehouse, tmp_path):
    result = remediation_pack.generate_pack(warehouse, str(tmp_path), T0 + dt.timedelta(days=4), "r1")
    tags = rows_of(f"{result['paths']['actions']}/category=missing_tags")
    assert tags[0][0] == [
        "item_id", "title", "item_type", "owner", "priority", "recommended_action", "url", "quality_score", "modified_at",
    ]
    assert [(r[0], r[4]) for part in tags for r in part[1:]] == [("c", "100"), ("b", "60")]
    broken = rows_of(result["paths"]["broken_services"])
    assert broken[0][0][-3:] == ["status_code", "error_message", "checked_url"]
    assert [r[0] for part in broken for r in part[1:]] == ["c"]


def test_status_and_dashboard(warehouse):
    row = status.status(warehouse).first()
    assert (row.run_id, row["items"], row.scores, row.health_checks, row.broken_services) == ("r3", 3, 1, 1, 0)
    frames = status.admin_frames(warehouse, "r1", T0 + dt.timedelta(days=4))
    assert len(frames) == 6
    assert frames["missing_tags"].columns == ["item_id", "title", "owner", "tags_json"]
    assert frames["broken_services"].first().title == "Gamma"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', "two\nlines", ""), (None, "é", "x")], "a STRING, b STRING, c STRING").coalesce(1)
    path = exports.write_csv(df, str(tmp_path / "x"))
    (part,) = rows_of(path)
    assert part == [["a", "b", "c"], ['say "hi", ok', "two\nlines", ""], ["", "é", "x"]]
    back = exports.read_csv(spark, path, df.schema).collect()
    assert [r.b for r in back] == ["two\nlines", "é"]
    (empty,) = rows_of(exports.write_csv(df.filter("false"), str(tmp_path / "y")))
    assert empty == [["a", "b", "c"]]


def test_stream_runs_each_file_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    source = str(tmp_path / "in")
    ticks = iter(range(1000))
    clock = lambda: T0 + dt.timedelta(minutes=next(ticks))

    def arrive(*items):
        raw(spark, *items).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = raw_stream(w, source, files_per_run=1)
        continuous_snapshot(w, stream, clock, str(tmp_path / "cp"), options=OPTIONS).awaitTermination()

    arrive(A, B)
    drain()
    arrive({**A, "title": "Changed"})
    drain()
    drain()
    assert [r.run_id for r in w.runs().orderBy("run_id").collect()] == ["batch_000000000", "batch_000000001"]
    titles = {(r.item_id, r.title, r.is_current) for r in w.items_history().collect()}
    assert titles == {("a", "Alpha", False), ("a", "Changed", True), ("b", "Beta", True)}

    # The same data through a new checkpoint: its batches find their runs published.
    again = raw_stream(w, source, files_per_run=1)
    continuous_snapshot(w, again, clock, str(tmp_path / "cp2"), options=OPTIONS).awaitTermination()
    assert w.items_history().count() == 3

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            default_checkpoint(w, "p_")
    else:
        assert default_checkpoint(w, "p_").startswith(shared)
        assert default_checkpoint(w, "p_") != default_checkpoint(Warehouse(spark, "/elsewhere"), "p_")


def test_changes_match_between_applied_and_rebuilt_history(spark, warehouse):
    history = warehouse.items_history()
    assert {r.change_type for r in HI.changes_of_run(history, "r3").collect()} == {"Modified"}
    assert HI.changes_of_run(history.withColumn("x", F.lit(1)), "r2").isEmpty()
