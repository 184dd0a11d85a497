"""Raw item JSON in all its irregular shapes."""

import datetime as dt
import json

from lorekeep.operators import normalize as N
from lorekeep.schemas import ITEMS_CURRENT

AS_OF = dt.datetime(2024, 1, 1)


def normalized(spark, *raws):
    rows = [(r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "raw STRING, seq BIGINT")
    out = N.normalize_items(df, "run_1", AS_OF, carry=("seq",)).orderBy("seq").collect()
    return df, out


def test_schema_and_full_item(spark):
    item = {
        "id": "a", "title": "T", "type": "Web Map", "owner": "o", "url": "http://u", "access": "public",
        "created": 1700000000123, "modified": 1700000000456.0, "tags": ["x", "y"], "snippet": "né",
        "description": "d", "thumbnail": "t.png", "extent": [[-1, -2.5], ["3", 4]], "numViews": 7,
    }
    df, (row,) = normalized(spark, item)
    assert N.normalize_items(df, "run_1", AS_OF).schema.simpleString() == ITEMS_CURRENT.simpleString()
    assert row.modified_at == dt.datetime(2023, 11, 14, 22, 13, 20, 456000)
    assert (row.tags_json, row.tags_count, row.snippet_len, row.num_views) == ('["x","y"]', 2, 2, 7)
    assert (row.extent_xmin, row.extent_ymin, row.extent_xmax, row.extent_ymax) == (-1.0, -2.5, 3.0, 4.0)
    assert row.has_extent and row.has_description and row.has_thumbnail
    assert (row.last_seen_run_id, row.last_seen_at) == ("run_1", AS_OF)


def test_falsy_fields_take_defaults(spark):
    _, rows = normalized(spark, {"id": "a"}, {"id": "b", "title": "", "type": None, "owner": "", "snippet": None})
    for row in rows:
        assert (row.title, row.item_type, row.owner) == ("Untitled", "Unknown", "Unknown")
        assert (row.snippet, row.description, row.description_len) == ("", "", 0)
        assert not row.has_description and not row.has_thumbnail and row.url is None


def test_tags(spark):
    shapes = [..., None, [], "", "a, b ,c", ["a", "b"], 5, [1, "b"]]
    _, rows = normalized(spark, *[{"id": "a"} if t is ... else {"id": "a", "tags": t} for t in shapes])
    assert [r.tags_count for r in rows] == [0, 0, 0, 1, 3, 2, 0, 2]
    assert [r.tags_json for r in rows][3:6] == ['[""]', '["a","b","c"]', '["a","b"]']


def test_extents(spark):
    bad = [None, [], [[0, 0]], [["x", 0], [1, 1]], [[0, 0], [1]], "[[0,0],[1,1]]", {"a": 1}, [[0, 0], [1, None]], 3]
    _, rows = normalized(spark, *[{"id": "a", "extent": e} for e in bad])
    for row in rows:
        assert not row.has_extent
        assert row.extent_xmin is row.extent_ymin is row.extent_xmax is row.extent_ymax is None


def test_times_and_views(spark):
    times = [None, 0, "1700000000123", "soon", 10**17, -1000, 1.5e12]
    _, rows = normalized(spark, *[{"id": "a", "created": t} for t in times])
    assert [r.created_at for r in rows] == [
        None, None, None, None, None, dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2017, 7, 14, 2, 40),
    ]
    _, rows = normalized(spark, {"id": "a"}, {"id": "a", "numViews": None}, {"id": "a", "numViews": 3})
    assert [r.num_views for r in rows] == [0, None, 3]


def test_content_hash(spark):
    base = {"id": "a", "title": "t", "tags": ["a"]}
    _, rows = normalized(
        spark,
        base,
        {**base, "numViews": 9, "created": 5},  # not part of the content
        {**base, "url": None},  # null is the same as absent
        dict(reversed(base.items())),
        {**base, "tags": "a"},
        {**base, "title": "u"},
        {**base, "modified": 1},
        {**base, "extent": [[0, 0], [1, 1]]},
    )
    hashes = [r.content_hash for r in rows]
    assert len(set(hashes[:4])) == 1
    assert len(set(hashes)) == 5


def test_rejects(spark):
    df, rows = normalized(spark, {"id": None, "title": "x"}, {"title": "y"}, "{broken", {"id": "ok"}, {"id": ""})
    assert [r.item_id for r in rows] == ["ok", ""]
    rejects = {r.seq: r.reason for r in N.rejected_items(df).collect()}
    assert rejects == {0: "no item id", 1: "no item id", 2: "not JSON"}


def test_scan(spark):
    df = spark.createDataFrame(
        [("b", "public", "X"), ("a", "public", "Y"), ("c", "org", "X"), ("d", None, "X")], "item_id STRING, access STRING, item_type STRING"
    )
    get = lambda *a: [r.item_id for r in N.scan_items(df, *a).collect()]
    assert sorted(get()) == ["a", "b"]
    assert get(None, ["X"]) == ["b"]
    assert sorted(get("access = 'org' OR access IS NULL")) == ["c", "d"]
    assert get(None, None, 1) == ["a"]
