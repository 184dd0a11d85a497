"""HTML to text, layer references and message parsing."""

import html

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as X


def apply(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


ENTITIES = [
    "a &amp; b", "&amp;lt;x", "&#65;&#x41;&#128;&#x1F600; z", "&notit; &notin; &copy2024",
    "&unknown; & x &", "&#0;&#xD800;&#99999999999999999999999;&#xFFFFFFFFFFFFFFFFFFF;&#1;x", "plain", "",
    "&nbsp;x&nbsp;&eacute;", "&#xFDD0;a&#xFFFE;b&#x1FFFF;&#x10ffff;", "&#x0000041;&#000065",
    "&CounterClockwiseContourIntegral;&ampfoo", "&&amp;&", "&#;&#x;&#xg", "&lt;b&gt;&quot;&apos;",
]


def test_entities_decode_like_the_html_standard(spark):
    assert apply(spark, X.unescape_html, ENTITIES) == [html.unescape(e) for e in ENTITIES]


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("<p>Hello<br>world</p>", "Hello world"),
        ("a<b>b</b>c", "a b c"),
        ("<script>var a = '<p>';</script><style>p{}</style>x<!-- <p>no</p> -->y", "x y"),
        ('<a title="1 > 0">link</a>', "link"),
        ("<a title='it\"s'>q</a>", "q"),
        ('<p title="open>text', "text"),
        ("5 &lt; 6 &amp;amp; more", "5 < 6 & more"),
        ("   many \n\t spaces here ", "many spaces here"),
        ("1 < 2", "1 < 2"),
        ("<!DOCTYPE html><p>" + "x" * 50000 + "</p>", "x" * 50000),
        ("<p " + "a='b' " * 20000 + ">deep</p>", "deep"),
    ],
)
def test_html_to_text(spark, source, text):
    assert apply(spark, X.html_to_text, [source]) == [text]


VIEWER = "https://m.org/apps/mapviewer/index.html?"
REFERENCES = {
    VIEWER + "url=https%3A%2F%2Fa.org%2FFeatureServer%2F2&x=1": ("service_url", "https://a.org/FeatureServer/2", None, 0, "layer"),
    VIEWER + "z=1&url=https://a.org/FeatureServer#top": ("service_url", "https://a.org/FeatureServer", None, 0, "collection"),
    VIEWER + "url=": ("item_id", None, VIEWER + "url=", None, "item"),
    VIEWER + "url=a%zzb": ("service_url", "a%zzb", None, 0, "collection"),
    "https://a.org/FeatureServer": ("service_url", "https://a.org/FeatureServer", None, 0, "collection"),
    "https://a.org/FeatureServer/": ("service_url", "https://a.org/FeatureServer/", None, 0, "collection"),
    " https://a.org/FeatureServer/5\n": ("service_url", "https://a.org/FeatureServer/5", None, None, "layer"),
    "https://a.org/MapServer/2/": ("service_url", "https://a.org/MapServer/2", None, None, "layer"),
    "abc": ("item_id", None, "abc", None, "item"),
}


def test_layer_references(spark):
    df = spark.createDataFrame(list(enumerate(REFERENCES)), "i INT, v STRING")
    parsed = df.select("i", X.parse_layer_ref(F.col("v")).alias("r"))
    rows = parsed.select("i", "r", X.target_class(F.col("r")).alias("c")).orderBy("i").collect()
    assert [(r.r.kind, r.r.url, r.r.item_id, r.r.layer_index, r.c) for r in rows] == list(REFERENCES.values())


def test_lookup_id(spark):
    assert apply(spark, X.lookup_id, ["x", "http://a?id=77&y=1", "id=", None]) == ["x", "77", "", None]


def test_reference_in_text(spark):
    item = "0123456789abcdef" * 2
    cases = {
        f"count {item} please": item,
        f"see http://a.org/item.html?id={item}ff": item,
        f"not a word: {item}0": None,
        "go to https://a.org/x/FeatureServer/3 now": "https://a.org/x/FeatureServer/3",
        "go to https://a.org/x/MapServer now": "https://a.org/x/MapServer",
        " the /FeatureServer thing ": "the /FeatureServer thing",
        f" {VIEWER}url=x ": f"{VIEWER}url=x",
        "nothing": None,
        "see (https://a.org/x/FeatureServer/12/MapServer/7x) and http://b.org/MapServer": "https://a.org/x/FeatureServer/12/MapServer/7",
        "first/FeatureServer then\u00a0http://b.org/y/MapServer/": "http://b.org/y/MapServer",
        "xhttps://a.org/FeatureServer/0?f=json": "https://a.org/FeatureServer/0",
        f"id=short&id={item} x": item,
        f"{item.upper()} id={item[:31]}": None,
        None: None,
    }
    assert apply(spark, X.reference_in_text, list(cases)) == list(cases.values())


def test_intent(spark):
    texts = ["Please VISUALIZE it", "map this", "Count Rows", "how many records?", "hello", None]
    assert apply(spark, X.wants_preview, texts) == [True, True, False, False, False, None]
    assert apply(spark, X.wants_count, texts) == [False, False, True, True, False, None]


def test_markup_that_hides_or_never_ends(spark):
    pages = {
        "<p>one</p><script>s='<!--'</script> seen <!-- x --> end": "one seen end",
        "a<script>var x=1;": "a",
        "a <!-- hidden b": "a",
        'a <i title="x > y">b</i> <': "a b <",
        "a <style": "a",
    }
    rows = spark.createDataFrame([(k,) for k in pages], "html STRING")
    got = {r.html: r.text for r in rows.select("html", X.html_to_text(F.col("html")).alias("text")).collect()}
    assert got == pages


def test_hostile_pages_take_linear_time(spark):
    import time

    marks = [(m * (1_000_000 // len(m)),) for m in ("<!--", "<script>", "<a", "<a '", '<a "> ', "<style ")]
    rows = spark.createDataFrame(marks, "html STRING")
    begin = time.monotonic()
    rows.select(F.sum(F.length(X.html_to_text(F.col("html"))))).collect()
    assert time.monotonic() - begin < 60
