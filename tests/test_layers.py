"""Layer counts, extents, checks, previews and styles on small hand-made features."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import layers as L
from lorekeep.operators import symbology as S

FEATURES = "item_id STRING, layer_kind STRING, layer_index INT, feature_id BIGINT, kind STRING, n INT, geometry STRING"
LAYERS = (
    "item_id STRING, item_type STRING, layer_kind STRING, layer_index INT, layer_name STRING, geometry_type STRING, error STRING"
)


def geometry(kind, coordinates):
    return json.dumps({"type": kind, "coordinates": coordinates})


def features(spark, *geometries, item="s", index=0):
    rows = [(item, "layer", index, i, f"k{i % 2}", i, g) for i, g in enumerate(geometries)]
    return spark.createDataFrame(rows, FEATURES)


def box(spark, *geometries):
    return list(L.extents(features(spark, *geometries)).select("xmin", "ymin", "xmax", "ymax").first())


@pytest.mark.parametrize(
    "shape, expected",
    [
        (geometry("Point", [1, 2]), [1, 2, 1, 2]),
        (geometry("Point", [1, 2, 99]), [1, 2, 1, 2]),
        (geometry("LineString", [[0, 5], [-3, 7]]), [-3, 5, 0, 7]),
        (geometry("MultiPoint", [[0, 5], [1, 1]]), [0, 1, 1, 5]),
        (geometry("Polygon", [[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 2], [1, 1]]]), [0, 0, 9, 9]),
        (geometry("MultiLineString", [[[0, 0], [1, 1]], [[-5, 2], [3, 3]]]), [-5, 0, 3, 3]),
        (geometry("MultiPolygon", [[[[0, 0], [1, 1]]], [[[7, -8], [2, 2]]]]), [0, -8, 7, 2]),
        (None, [None] * 4),
        (geometry("Polygon", []), [None] * 4),
        ('{"type":"GeometryCollection","geometries":[]}', [None] * 4),
        ("{broken", [None] * 4),
    ],
)
def test_extent_by_geometry_type(spark, shape, expected):
    assert box(spark, shape) == expected


def test_extent_skips_features_without_geometry(spark):
    assert box(spark, None, geometry("Point", [3, 4]), geometry("LineString", [[-1, 9], [0, 0]])) == [-1, 0, 3, 9]


def test_bounds_check_looks_at_the_first_position_of_the_first_five(spark):
    good, bad = geometry("Point", [10, 20]), geometry("Point", [20000, 20])
    late = geometry("LineString", [[10, 20], [20000, 20]])
    check = lambda *g: L.bounds_check(features(spark, *g)).first().bounds_bad
    assert check(good, bad)
    assert not check(good, good, good, good, good, bad)
    assert not check(late, None)
    assert not check(geometry("Point", [185, -95]))
    assert check(geometry("Polygon", [[[0, 96], [0, 0]]]))


def test_diagnose_tests_the_minima_only(spark):
    row = L.diagnose(features(spark, geometry("Point", [0, 0]), geometry("Point", [50000, 50000]))).first()
    assert row.is_lat_lon and row.xmax == 50000
    assert not L.diagnose(features(spark, geometry("Point", [-181, 0]))).first().is_lat_lon
    assert not L.diagnose(features(spark, None)).first().is_lat_lon


def catalog(spark):
    rows = [
        ("s", "Feature Service", "layer", 0, "Roads", "Point", None),
        ("s", "Feature Service", "layer", 1, "Empty", "Point", None),
        ("s", "Feature Service", "table", 0, "Rows", "None", None),
        ("t", "Map Service", "layer", 0, "Down", "Point", "timeout"),
        ("w", "Web Map", "layer", 0, "Map", "Point", None),
    ]
    return spark.createDataFrame(rows, LAYERS)


def test_counts(spark):
    counts = L.row_counts(features(spark, *[None] * 6), catalog(spark), "n >= 2")
    got = {(r.item_id, r.layer_kind, r.layer_index): (r.row_count, r.error) for r in counts.collect()}
    assert got[("s", "layer", 0)] == (4, None) and got[("s", "layer", 1)] == (0, None)
    assert got[("t", "layer", 0)] == (None, "timeout")
    totals = {r.item_id: (r.total_count, r.total_layers, r.total_tables, r.failed) for r in L.total_count(counts).collect()}
    assert totals["s"] == (4, 2, 1, 0) and totals["t"] == (0, 1, 0, 1)
    assert {r.row_count for r in L.displayed_counts(counts).filter("item_id = 't'").collect()} == {"Error"}


def targets(spark, *references):
    items = spark.createDataFrame(
        [("s", "https://h/s/FeatureServer"), ("t", "https://h/t/MapServer/"), ("w", None)], "item_id STRING, url STRING"
    )
    return L.resolve_targets(spark.createDataFrame([(r,) for r in references], "reference STRING"), items)


def test_requested_counts(spark):
    counts = L.row_counts(features(spark, *[None] * 6), catalog(spark))
    references = ["s", "https://h/s/FeatureServer", "https://h/s/FeatureServer/1", "https://h/s/FeatureServer/7", "gone"]
    got = {r.reference: r for r in L.requested_counts(counts, targets(spark, *references)).collect()}
    assert (got["s"].ok, got["s"].layers_counted, got["s"].total_count) == (True, 3, 6)
    assert (got[references[1]].layers_counted, got[references[1]].total_count) == (1, 6)  # layer 0 only
    assert (got[references[2]].layer_index, got[references[2]].total_count) == (1, 0)
    assert got[references[3]].error == "no layer 7"
    assert not got["gone"].ok


def test_preview_status(spark):
    data = features(spark, *[geometry("Point", [i, -i]) for i in range(10)])
    references = ["s", "https://h/s/FeatureServer/1", "https://h/s/FeatureServer/5", "t", "w", "gone"]
    got = {r.reference: r for r in L.preview_status(data, catalog(spark), targets(spark, *references), limit=4).collect()}
    assert (got["s"].ok, got["s"].n_features, got["s"].xmax, got["s"].ymin, got["s"].layer_key) == (True, 4, 3, -3, "s:0")
    assert (got[references[1]].ok, got[references[1]].n_features, got[references[1]].xmin) == (True, 0, None)
    assert got[references[2]].error == "no layer 5 among 2"
    assert got["t"].error == "layer cannot be read: timeout"
    assert got["w"].error == "no preview of item type Web Map"
    assert got["gone"].error == L.UNKNOWN
    far = features(spark, geometry("Point", [1e6, 2e6]))
    row = L.preview_status(far, catalog(spark), targets(spark, "s")).first()
    assert (row.ok, row.error, row.xmin) == (False, L.PROJECTED, None)


def test_feature_collection_document(spark):
    data = features(spark, geometry("Point", [1.5, 2]), None, geometry("Point", [3, 4]))
    shown = L.preview_features(data, "n >= 0", limit=2)
    row = L.feature_collections(L.as_geojson(shown, ["kind", "n"])).first()
    document = json.loads(row.geojson)
    assert row.n_features == 2 and document["type"] == "FeatureCollection"
    assert document["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.5, 2]}
    assert document["features"][1] == {"type": "Feature", "geometry": None, "properties": {"kind": "k1", "n": 1}}
    many = spark.range(1000).selectExpr("'s' AS item_id", "'layer' AS layer_kind", "0 AS layer_index", "id AS feature_id", "'{}' AS feature")
    assert L.feature_collections(many).first().n_features == 1000


def test_refresh_keeps_what_could_not_be_fetched(spark):
    schema = (
        "item_id STRING, layer_index INT, layer_name STRING, geometry_type STRING, geojson STRING, "
        "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
    )
    old = spark.createDataFrame([(i, 0, "Old", "Point", "{}", 0.0, 0.0, 1.0, 1.0) for i in "abcd"], schema)
    new = spark.createDataFrame(
        [
            ("a", 0, "New", "Line", "{1}", -9.0, -9.0, 9.0, 9.0, True),
            ("b", 0, "New", "Line", "{1}", -9.0, -9.0, 9.0, 9.0, False),
            ("c", 0, "New", None, "{1}", None, None, None, None, True),
        ],
        schema + ", ok BOOLEAN",
    )
    got = {r.item_id: (r.layer_name, r.geometry_type, r.geojson, r.xmin) for r in L.refresh_previews(old, new).collect()}
    assert got == {
        "a": ("New", "Line", "{1}", -9.0),
        "b": ("Old", "Point", "{}", 0.0),
        "c": ("New", "Point", "{1}", 0.0),
        "d": ("Old", "Point", "{}", 0.0),
    }


def symbol(*rgba, width=None, line=(0, 0, 0, 255)):
    outline = {"color": list(line)} | ({} if width is None else {"width": width})
    return {"color": list(rgba), "outline": outline}


def styles(spark, renderer, rows, schema="item_id STRING, layer_index INT, a STRING, b DOUBLE, c BOOLEAN", default=None):
    data = spark.createDataFrame([("s", 0, *r) for r in rows], schema).coalesce(1)
    table = spark.createDataFrame([("s", 0, json.dumps(renderer))] if renderer else [], "item_id STRING, layer_index INT, renderer STRING")
    styled = S.style_features(data, table, default or {"color": "black"})
    assert styled.columns == [*data.columns, *S.STYLE]
    return {tuple(r[2:5]): r for r in styled.collect()}


def test_simple_renderer_gives_one_style(spark):
    got = styles(spark, {"type": "simple", "symbol": symbol(1, 2, 3, width=4)}, [("x", 1.0, True), ("y", 2.0, None)])
    assert {(r.fill_color, r.color, r.weight, r.fill_opacity) for r in got.values()} == {("#010203", "#000000", 4.0, 1.0)}


def test_no_renderer_gives_the_default(spark):
    (row,) = styles(spark, None, [("x", 1.0, True)]).values()
    assert (row.color, row.fill_color, row.weight) == ("black", None, None)


def test_unique_values_last_one_wins_then_default_symbol(spark):
    infos = [
        {"value": "x", "symbol": symbol(1, 1, 1)},
        {"value": "x", "symbol": symbol(2, 2, 2, 51, width=3)},
        {"value": "None", "symbol": symbol(9, 9)},
    ]
    renderer = {"type": "uniqueValue", "field1": "a", "uniqueValueInfos": infos, "defaultSymbol": symbol(5, 5, 5, width=7)}
    got = styles(spark, renderer, [("x", 1.0, True), ("z", 1.0, True), (None, 1.0, True)])
    x, z, null = got[("x", 1.0, True)], got[("z", 1.0, True)], got[(None, 1.0, True)]
    assert (x.fill_color, x.fill_opacity, x.weight) == ("#020202", 0.2, 3.0)
    assert (z.fill_color, z.weight) == ("#050505", 1.0)  # the default symbol's width is not used
    assert (null.fill_color, null.fill_opacity) == ("#3388ff", 0.4)  # a null reads "None"
    del renderer["defaultSymbol"]
    assert styles(spark, renderer, [("z", 1.0, True)])[("z", 1.0, True)].color == "black"


def test_keys_of_several_fields(spark):
    infos = [{"value": "x|1.5|True", "symbol": symbol(1, 1, 1)}, {"value": "x|", "symbol": symbol(2, 2, 2)}]
    renderer = {
        "type": "uniqueValue", "field1": "a", "field2": "b", "field3": "c", "fieldDelimiter": "|", "uniqueValueInfos": infos,
    }
    assert styles(spark, renderer, [("x", 1.5, True)])[("x", 1.5, True)].fill_color == "#010101"
    renderer |= {"field2": "missing", "field3": ""}
    assert styles(spark, renderer, [("x", 1.5, True)])[("x", 1.5, True)].fill_color == "#020202"


def test_style_diversity(spark):
    df = spark.createDataFrame(
        [("s", 0, "#b"), ("s", 0, "#a"), ("s", 0, "#a"), ("s", 1, None)], "item_id STRING, layer_index INT, fill_color STRING"
    )
    got = {r.layer_index: (r.n_colors, r.colors) for r in S.style_diversity(df).collect()}
    assert got == {0: (2, "#a,#b"), 1: (0, "")}
