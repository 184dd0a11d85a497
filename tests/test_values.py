"""Value, predicate and score expressions at their boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import predicates as P
from lorekeep.functions import scoring as S
from lorekeep.functions import values as V

AS_OF = dt.datetime(2024, 6, 30, 12, 0, 0)


def column(spark, kind, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_epoch_ms(spark):
    got = column(
        spark, "BIGINT", [None, 0, -1500, 1700000000123, 10**17], lambda v: V.epoch_ms_to_ntz(v.cast("double"))
    )
    assert got == [
        None,
        None,
        dt.datetime(1969, 12, 31, 23, 59, 58, 500000),
        dt.datetime(2023, 11, 14, 22, 13, 20, 123000),
        None,
    ]


def test_epoch_ms_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, "BIGINT", [1700000000123], lambda v: V.epoch_ms_to_ntz(v.cast("double")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2023, 11, 14, 22, 13, 20, 123000)]


def test_tags(spark):
    tags = column(spark, "STRING", ["", "a, b ,c", "a,,b", "  x\t"], V.split_tags)
    assert tags == [[""], ["a", "b", "c"], ["a", "", "b"], ["x"]]


def test_digest_keeps_fields_and_nulls_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "bc"), ("", "bc"), ("~", "bc")], "x STRING, y STRING")
    hashes = {r[0] for r in df.select(V.canonical_digest(F.col("x"), F.col("y"))).collect()}
    assert len(hashes) == 5


def test_colours(spark):
    arrays = [None, [], [1, 2], [255, 0, 16], [255, 0, 16, 51]]
    assert column(spark, "ARRAY<INT>", arrays, V.colour_hex) == ["#3388ff"] * 3 + ["#ff0010"] * 2
    assert column(spark, "ARRAY<INT>", arrays, V.colour_opacity) == [0.4, 0.4, 0.4, 1.0, 0.2]


def test_names(spark):
    df = spark.createDataFrame([("79d0e419-aa", dt.datetime(2026, 1, 1, 3), 2)], "r STRING, t TIMESTAMP_NTZ, n INT")
    row = df.select(V.report_base_name(F.col("t"), F.col("r")), V.layer_key(F.col("r"), F.col("n"))).first()
    assert list(row) == ["catalog_health_2026-01-01_79d0e419", "79d0e419-aa:2"]


def ids(df):
    return sorted(r.i for r in df.select("i").collect())


def test_null_means_missing_switch(spark):
    df = spark.createDataFrame([(0, None, None), (1, 0, False), (2, 3, True)], "i INT, tags_count INT, has_description BOOLEAN")
    assert ids(df.filter(P.missing_tags())) == [0, 1]
    assert ids(df.filter(P.missing_tags(False))) == [1]
    assert ids(df.filter(P.missing_description())) == [0, 1]
    assert ids(df.filter(P.missing_description(False))) == [1]


def test_stale_boundary(spark):
    tick = dt.timedelta(microseconds=1)
    edge = dt.datetime(2022, 6, 30, 12)
    df = spark.createDataFrame(list(enumerate([edge - tick, edge, edge + tick, None])), "i INT, modified_at TIMESTAMP_NTZ")
    assert ids(df.filter(P.stale(AS_OF))) == [0]
    leap = spark.createDataFrame([(0, dt.datetime(2022, 2, 27)), (1, dt.datetime(2022, 2, 28))], "i INT, modified_at TIMESTAMP_NTZ")
    assert ids(leap.filter(P.stale("2024-02-29 00:00:00"))) == [0]


def test_type_checks(spark):
    df = spark.createDataFrame([(0, "Feature Service"), (1, "Map Service"), (2, "Web Map"), (3, None)], "i INT, item_type STRING")
    assert ids(df.filter(P.previewable())) == [0, 1]
    assert ids(df.filter(P.countable())) == [0]


ITEM = {
    "has_description": False, "tags_count": 1, "has_extent": False, "has_thumbnail": False,
    "snippet_len": 0, "title": "short", "modified_at": None, "url": None,
}
SCHEMA = (
    "has_description BOOLEAN, tags_count INT, has_extent BOOLEAN, has_thumbnail BOOLEAN, "
    "snippet_len INT, title STRING, modified_at TIMESTAMP_NTZ, url STRING"
)


@pytest.mark.parametrize(
    "field, values, points",
    [
        ("has_description", [None, False, True], [0, 0, 20]),
        ("tags_count", [None, 0, 1, 2, 3], [0, 0, 0, 0, 15]),
        ("has_extent", [False, True], [0, 15]),
        ("has_thumbnail", [False, True], [0, 5]),
        ("snippet_len", [19, 20, 200, 201], [0, 5, 5, 0]),
        ("title", ["t" * 9, "t" * 10, "t" * 120, "t" * 121], [0, 5, 5, 0]),
        (
            "modified_at",
            [
                AS_OF - dt.timedelta(days=181),
                AS_OF - dt.timedelta(days=180, hours=23, minutes=59),
                AS_OF + dt.timedelta(days=9),
            ],
            [0, 20, 20],
        ),
        ("url", [None, "", "http://x"], [0, 0, 10]),
    ],
)
def test_catalog_rules(spark, field, values, points):
    rows = [tuple({**ITEM, field: v}.values()) for v in values]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert [r[0] for r in df.select(S.catalog_score(AS_OF)).collect()] == points


def test_best_item_scores_95_and_worst_lists_what_is_missing(spark):
    best = (True, 3, True, True, 50, "a good title", AS_OF, "u")
    worst = (None, 0, False, False, 0, "", None, None)
    df = spark.createDataFrame([best, worst], SCHEMA).coalesce(1)
    rows = df.select(S.catalog_score(AS_OF), S.score_breakdown(AS_OF), S.missing_fields()).collect()
    assert rows[0][0] == 95 and rows[0][2] == "[]"
    assert rows[0][1].startswith('{"has_description":20,"tags_count":15')
    assert list(rows[1]) == [0, "{}", '["description","tags","thumbnail"]']


def test_hit_score(spark):
    rows = [("t", "s", "d", ["a", "b", "c"]), ("t", "", None, ["a"]), (None, "s", "d", []), ("", "", "", None)]
    df = spark.createDataFrame(rows, "t STRING, s STRING, d STRING, g ARRAY<STRING>").coalesce(1)
    score = S.hit_score(*[F.col(c) for c in "tsdg"])
    assert [r[0] for r in df.select(score).collect()] == [100, 30, 60, 0]


@pytest.mark.parametrize(
    "score, issue, expected",
    [
        (25, "missing_tags", 85),
        (25, "missing_description", 90),
        (25, "stale_items", 85),
        (None, "stale_items", 60),
        (70, "stale_items", 40),
        (85, "broken_services", 45),
        (0, "broken_services", 100),
        (100, "missing_tags", 10),
    ],
)
def test_priority(spark, score, issue, expected):
    df = spark.createDataFrame([(score,)], "score INT")
    assert df.select(S.priority(F.col("score"), issue)).first()[0] == expected
