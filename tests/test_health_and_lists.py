"""Probing, broken services, remediation and owner lists, also with repeated checks."""

import datetime as dt

from lorekeep.operators import health as H
from lorekeep.operators import issues as I
from lorekeep.operators import remediation as R
from lorekeep.operators import scores as S
from lorekeep.operators import search as X
from lorekeep.schemas import HEALTH_CHECKS, ITEMS_CURRENT, QUALITY_SCORES

AS_OF = dt.datetime(2024, 6, 30)
OLD = dt.datetime(2020, 1, 1)


def items(spark, *rows):
    defaults = dict.fromkeys(ITEMS_CURRENT.names)
    return spark.createDataFrame([tuple({**defaults, **r}.values()) for r in rows], ITEMS_CURRENT)


def checks(spark, *rows):
    full = [("r1", i, f"http://{i}", ok, 200 if ok else 500, 1, None if ok else "HTTP 500", AS_OF) for i, ok in rows]
    full.append(("r0", "a", "http://a", False, 500, 1, "HTTP 500", AS_OF))
    return spark.createDataFrame(full, HEALTH_CHECKS)


def test_classification(spark):
    status = [200, 302, 399, 400, 404, 500, None]
    rows = [(f"i{n}", "u", s, None if s is None else 0.0129, None if s else "refused") for n, s in enumerate(status)]
    probes = spark.createDataFrame(
        rows, "item_id STRING, checked_url STRING, status_code INT, elapsed_seconds DOUBLE, transport_error STRING"
    )
    got = H.classify_probes(probes, "r", AS_OF).orderBy("item_id").collect()
    assert [r.ok for r in got] == [True, True, True, False, False, False, False]
    assert [r.error_message for r in got] == [None, None, None, "HTTP 400", "HTTP 404", "HTTP 500", "refused"]
    assert [r.latency_ms for r in got] == [12] * 6 + [None]


def test_probe_falls_back_to_get_and_isolates_errors(spark):
    def fetch(method, url, timeout):
        if url.endswith("405"):
            return (405, 0.1) if method == "HEAD" else (200, 0.2)
        if url.endswith("bad"):
            raise OSError("no route")
        return 204, 0.3

    data = items(spark, *[{"item_id": u, "url": u or None} for u in ("x405", "xbad", "xok", "")])
    got = {r.item_id: (r.status_code, r.elapsed_seconds, r.transport_error) for r in H.probe_items(data, fetch, 2).collect()}
    assert got == {"x405": (200, 0.2, None), "xbad": (None, None, "no route"), "xok": (204, 0.3, None)}


def test_probing_nothing(spark):
    assert H.probe_items(items(spark, {"item_id": "a"}), lambda *a: (200, 0.1)).isEmpty()


def test_broken_services_are_run_scoped_and_repeat_with_the_checks(spark):
    data = items(spark, {"item_id": "a", "title": "A"}, {"item_id": "b", "title": "B"})
    health = checks(spark, ("a", False), ("a", False), ("b", True), ("gone", False))
    assert [r.title for r in H.broken_services(data, health, "r1").collect()] == ["A", "A"]


def brute_base(item_rows, score_rows, check_rows):
    out = []
    for i in item_rows:
        for s in [s for k, s in score_rows if k == i] or [None]:
            for ok in [ok for k, ok in check_rows if k == i] or [None]:
                out.append((i, s, ok))
    return sorted(out, key=str)


def test_remediation_base_repeats_items_like_two_left_joins(spark):
    ids = ["a", "b", "c", "d"]
    score_rows = [("a", 10), ("a", 20), ("b", 30)]
    check_rows = [("a", True), ("a", False), ("c", False)]
    scores = spark.createDataFrame([("r1", i, s, "{}", "[]", AS_OF) for i, s in score_rows], QUALITY_SCORES)
    data, health = items(spark, *[{"item_id": i} for i in ids]), checks(spark, *check_rows)
    for unique in (False, True):
        base = R.remediation_base(data, scores, health, "r1", one_per_item=unique)
        got = sorted(((r.item_id, r.quality_score, r.health_ok) for r in base.collect()), key=str)
        assert got == brute_base(ids, score_rows, check_rows)


def test_remediation_lists(spark):
    data = items(
        spark,
        {"item_id": "a", "tags_count": None, "has_description": None, "modified_at": OLD},
        {"item_id": "b", "tags_count": 0, "has_description": False, "modified_at": AS_OF},
        {"item_id": "c", "tags_count": 4, "has_description": True, "modified_at": None},
    )
    scores = spark.createDataFrame([("r1", "a", 25, "{}", "[]", AS_OF), ("r1", "c", 85, "{}", "[]", AS_OF)], QUALITY_SCORES)
    base = R.remediation_base(data, scores, checks(spark, ("c", False)), "r1")
    get = lambda c: [(r.item_id, r.priority, r.recommended_action) for r in R.remediation_list(base, c, AS_OF).collect()]
    assert get("missing_tags") == [("a", 85, "ADD_TAGS"), ("b", 60, "ADD_TAGS")]
    assert get("missing_description") == [("b", 65, "ADD_DESCRIPTION")]  # an unknown one is left out
    assert get("stale_items") == [("a", 85, "REVIEW_STALE")]
    assert get("broken_services") == [("c", 45, "FIX_SERVICE_URL")]
    assert R.remediation_list(base, "broken_services", AS_OF).columns == list(R.BROKEN_COLUMNS)
    together = {(r.category, r.item_id, r.priority) for r in R.remediation_actions(base, AS_OF).collect()}
    assert together == {(c, i, p) for c in R.ACTIONS for i, p, _ in get(c)}
    empty = R.remediation_list(base.filter("false"), "missing_tags", AS_OF)
    assert empty.isEmpty() and empty.columns == list(R.LIST_COLUMNS)


def test_owner_remediation_counts_an_item_once_per_check(spark):
    data = items(
        spark,
        {"item_id": "a", "owner": "x", "tags_count": 0, "has_description": False, "modified_at": OLD},
        {"item_id": "b", "owner": "x", "tags_count": 1},
        {"item_id": "c", "owner": "y", "tags_count": None, "has_description": True},
    )
    health = checks(spark, ("a", False), ("a", True), ("a", False), ("b", True))
    got = [tuple(r) for r in I.owner_remediation(data, health, "r1", AS_OF).collect()]
    assert got == [("x", 4, 3, 3, 3, 2), ("y", 1, 1, 0, 0, 0)]


def test_owner_summary_breaks_ties_by_name(spark):
    data = items(spark, *[{"item_id": str(n), "owner": f"o{n:02d}"} for n in range(25)], {"item_id": "z", "owner": "big"}, {"item_id": "y", "owner": "big"})
    owners = [r.owner for r in I.owner_summary(data, AS_OF).collect()]
    assert owners == ["big"] + [f"o{n:02d}" for n in range(19)]


def test_summaries_of_an_empty_run(spark):
    data, scores = items(spark, {"item_id": "a"}), spark.createDataFrame([], QUALITY_SCORES)
    health = spark.createDataFrame([], HEALTH_CHECKS)
    assert list(I.snapshot_summary(data, scores, health, "r1").first()) == [1, 0, 0]
    assert list(S.quality_stats(scores, "r1").first()) == [None, None, None, 0, 0]
    runs = spark.createDataFrame([], "run_id STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ")
    assert I.status_metrics(data, scores, health, runs).isEmpty()


def test_search_and_rank(spark):
    schema = (
        "hit_no INT, title STRING, id STRING, type STRING, owner STRING, modified BIGINT, tags ARRAY<STRING>, url STRING, "
        "snippet STRING, description STRING"
    )
    row = lambda n, kind="Feature Layer", title="Rivers", **k: (n, title, f"i{n}", kind, "o", 0, k.get("tags"), "u", k.get("snippet"), None)
    data = spark.createDataFrame(
        [row(0), row(1, snippet="s"), row(2, "Web Map"), row(3, title="x", tags=["RIVER", "b", "c"]), row(4, title="none"), row(5)], schema
    )
    hits = X.search_items(data, "river", max_items=4)
    assert [r.hit_no for r in hits.collect()] == [0, 1, 3, 5]
    assert [r.hit_no for r in X.rank_hits(hits).collect()] == [1, 3, 0, 5]
    assert [r.hit_no for r in X.rank_hits(hits, by_quality=False).collect()] == [0, 1, 3, 5]
    saved = spark.createDataFrame([("i1",), ("i1",)], "item_id STRING")
    assert {r.id: r.is_saved for r in X.mark_saved(hits, saved).collect()} == {"i0": False, "i1": True, "i3": False, "i5": False}
