"""Catalog-shaped views derived from the driver tables, so operators run at any scale factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point_geometry
from ..operators.rows import latest_by
from .driver_tables import table

AS_OF = "2001-08-01 00:00:00"
RUN = "run_200108"
EARLIER_RUN = "run_200107"


def _text(col: Column) -> Column:
    return col.cast("string")


def _service_url(key: str) -> str:
    return f"concat('https://svc', {key} % 5, '.example.org/', {key})"


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog item per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS item_id",
        """CASE WHEN o_orderkey % 13 = 0 THEN 'Untitled'
                ELSE concat(o_orderpriority, ' ', o_orderstatus, ' #', o_orderkey) END AS title""",
        "o_orderpriority AS item_type",
        "concat('owner_', o_custkey % 97) AS owner",
        f"CASE WHEN o_orderkey % 11 <> 0 THEN {_service_url('o_orderkey')} END AS url",
        "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS modified_at",
        "CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 6 AS INT) END AS tags_count",
        """CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN '[]'
                ELSE '["land"]' END AS tags_json""",
        "CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 4 <> 0 END AS has_description",
        "o_orderkey % 3 <> 0 AS has_extent",
        "o_orderkey % 2 = 0 AS has_thumbnail",
        "CAST(o_orderkey % 260 AS INT) AS snippet_len",
    )


def probe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probing an item's URL gave, unclassified: one row per item with a URL and a line."""
    seen = (
        table(spark, sf_dir, "lineitem")
        .filter("l_orderkey % 11 <> 0")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.expr("max(l_quantity) AS q"), F.expr("max(l_extendedprice) AS p"), F.expr("max(l_shipdate) AS checked_at"))
    )
    return seen.selectExpr(
        f"CASE WHEN k % 9 = 0 THEN '{EARLIER_RUN}' ELSE '{RUN}' END AS run_id",
        "CAST(k AS STRING) AS item_id",
        f"{_service_url('k')} AS checked_url",
        """CASE WHEN q >= 49 THEN CAST(NULL AS INT) WHEN q >= 45 THEN 503 WHEN q >= 40 THEN 404
                ELSE 200 END AS status_code""",
        "CASE WHEN q < 49 THEN p / 100000 END AS elapsed_seconds",
        "CASE WHEN q >= 49 THEN 'connection failed' END AS transport_error",
        "checked_at",
    )


def _month_run(day: Column) -> Column:
    return F.concat(F.lit("run_"), _text(F.year(day) * 100 + F.month(day)))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per calendar month."""
    day = F.col("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(_month_run(day).alias("run_id"))
        .agg(F.min(day).alias("started_at"), F.max(day).alias("finished_at"))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run saw of each item: its last state in the month."""
    cust, day = F.col("o_custkey"), F.col("o_orderdate")
    seen = table(spark, sf_dir, "orders").select(
        _text(cust).alias("item_id"),
        _month_run(day).alias("run_id"),
        F.concat("o_orderstatus", F.lit("/"), _text(cust % 3)).alias("content"),
        day.alias("observed_at"),
        F.col("o_orderkey").alias("seq"),
    )
    return latest_by(seen, ["item_id", "run_id"], "observed_at", "seq").drop("seq")


def layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features (and table rows without a place) in the layers of a service."""
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            "concat('svc_', c_nationkey) AS item_id",
            "CAST(c_custkey % 3 AS INT) AS layer_index",
            "CASE WHEN c_custkey % 3 = 2 THEN 'table' ELSE 'layer' END AS layer_kind",
            "c_custkey AS feature_id",
            "c_mktsegment AS class_value",
            "c_acctbal AS measure",
            "CASE WHEN c_custkey % 29 <> 0 THEN CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) END AS x",
            "CASE WHEN c_custkey % 29 <> 0 THEN CAST((c_custkey * 53) % 180 - 90 AS DOUBLE) END AS y",
        )
        .withColumn("geometry", point_geometry(F.col("x"), F.col("y")))
    )


def service_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers or tables per service; some services cannot be reached."""
    indexed = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "explode(array(0, 1, 2)) AS layer_index")
    return indexed.selectExpr(
        "concat('svc_', n_nationkey) AS item_id",
        """CASE WHEN n_nationkey % 5 = 4 THEN 'Web Map' WHEN n_nationkey % 2 = 0 THEN 'Feature Service'
                ELSE 'Map Service' END AS item_type""",
        "CASE WHEN layer_index = 2 THEN 'table' ELSE 'layer' END AS layer_kind",
        "layer_index",
        "concat(n_name, ' / ', layer_index) AS layer_name",
        "CASE WHEN layer_index = 2 THEN 'None' ELSE 'Point' END AS geometry_type",
        "CASE WHEN n_nationkey % 7 = 3 AND layer_index = 1 THEN 'timeout' END AS error",
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def layer_renderers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderer JSON per layer: a simple one, a unique-value one or none, by service.

    The unique-value renderer leaves one segment out and repeats another with a new colour.
    """

    def symbol(red: str, alpha: str = "") -> str:
        text = (
            f'{{"color":[%d,20,40{alpha}],"outline":{{"color":[0,%d,9,51],"width":2}}}}'
        )
        return f"format_string('{text}', {red}, {red})"

    def info(segment: str, red: str) -> str:
        return f"""'{{"value":"{segment}","symbol":', {symbol(red)}, '}}'"""

    infos = [info(segment, f"n_nationkey * 7 + {10 * i}") for i, segment in enumerate(SEGMENTS[:4])]
    infos.append(info(SEGMENTS[0], "n_nationkey * 7 + 5"))
    fallback = f"""CASE WHEN n_nationkey % 2 = 0 THEN concat(',"defaultSymbol":', {symbol("250", ",102")}) ELSE '' END"""
    simple = f"""concat('{{"type":"simple","symbol":', {symbol("n_nationkey * 3", ",204")}, '}}')"""
    head = '{"type":"uniqueValue","field1":"class_value","uniqueValueInfos":['
    unique = f"""concat('{head}', {", ',', ".join(infos)}, ']', {fallback}, '}}')"""
    return table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 1").selectExpr(
        "concat('svc_', n_nationkey) AS item_id",
        "explode(array(0, 1)) AS layer_index",
        f"CASE WHEN n_nationkey % 5 = 0 THEN {simple} ELSE {unique} END AS renderer",
    )


def composite_renderers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderers whose classes are named by two attributes with a delimiter of their own (layer 0), or by three (layer 1)."""
    two = '"field2":"layer_index","fieldDelimiter":" / "'
    three = '"field2":"layer_index","field3":"layer_kind"'

    def info(k: int, segment: str) -> str:
        value = f"CASE WHEN layer_index = 0 THEN '{segment} / 0' ELSE '{segment},1,layer' END"
        symbol = f"""concat('{{"color":[', n_nationkey + {10 * k}, ',20,40],"outline":{{"color":[0,0,9],"width":3}}}}')"""
        return f"""concat('{{"value":"', {value}, '","symbol":', {symbol}, '}}')"""

    infos = ", ".join(info(k, segment) for k, segment in enumerate(SEGMENTS[:3]))
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "explode(array(0, 1)) AS layer_index")
    return rows.selectExpr(
        "concat('svc_', n_nationkey) AS item_id",
        "layer_index",
        f"""concat('{{"type":"uniqueValue","field1":"class_value",', CASE WHEN layer_index = 0 THEN '{two}' ELSE '{three}' END,
            ',"uniqueValueInfos":[', concat_ws(',', {infos}), ']}}') AS renderer""",
    )


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save and remove actions, ordered by ``seq``."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "ts AS added_at",
        "CAST(user_id AS STRING) AS item_id",
        "CASE WHEN event_type = 'error' THEN 'remove' ELSE 'save' END AS action",
        "concat('https://svc.example.org/', user_id) AS item_url",
        "concat('Item ', user_id, ' ', event_type) AS title",
        "event_type AS item_type",
        "concat('owner_', event_id % 11) AS owner",
        "CASE WHEN event_type = 'purchase' THEN props END AS notes",
        "event_type AS source_query",
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as catalog search hits."""
    d, body = F.col("doc_id"), F.col("text")
    n_tags = (d % 5).cast("int")
    tags = F.slice(F.array(F.col("lang"), F.col("source"), F.lit("map"), F.lit("open")), F.lit(1), n_tags)
    return table(spark, sf_dir, "documents").select(
        F.md5(_text(d)).alias("id"),
        d.alias("hit_no"),
        F.when(d % 3 == 0, F.lit("Feature Layer")).otherwise(F.lit("Web Map")).alias("type"),
        F.when(d % 7 == 0, F.lit("")).otherwise(F.substring(body, 1, 40)).alias("title"),
        F.col("source").alias("owner"),
        F.concat(F.lit("https://docs.example.org/"), _text(d)).alias("url"),
        F.when(d % 4 == 0, F.lit(None)).otherwise(F.substring(body, 41, 120)).alias("snippet"),
        F.when(d % 6 == 0, F.lit(None)).otherwise(body).alias("description"),
        F.when(d % 10 == 9, F.lit(None)).otherwise(tags).alias("tags"),
        F.col("n_chars").alias("modified"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw item JSON as a portal returns it, with every irregular shape in rotation."""
    d, body = F.col("doc_id"), F.col("text")
    texts = F.to_json(
        F.struct(
            F.when(d % 97 != 0, F.md5(_text(d))).alias("id"),
            F.when(d % 13 == 0, F.lit("")).when(d % 13 != 1, F.substring(body, F.lit(1), (5 + d % 130).cast("int"))).alias("title"),
            F.when(d % 9 != 0, F.lit("Feature Service")).alias("type"),
            F.when(d % 8 != 0, F.col("source")).alias("owner"),
            F.when(d % 11 != 0, F.expr(_service_url("doc_id"))).alias("url"),
            F.lit("public").alias("access"),
            F.when(d % 7 != 0, F.substring(body, F.lit(1), (d % 260).cast("int"))).alias("snippet"),
            F.when(d % 6 != 0, body).alias("description"),
            F.when(d % 2 == 0, F.lit("thumb.png")).alias("thumbnail"),
        )
    )
    millis = F.lit(990000000000) + d * 86400000
    created = F.when(d % 10 == 0, F.lit("null")).when(d % 10 == 1, F.lit("0")).when(
        d % 10 == 2, F.lit('"soon"')).otherwise(_text(millis - 1000))
    tags = (
        F.when(d % 5 == 0, F.concat(F.lit('["'), F.col("lang"), F.lit('","'), F.col("source"), F.lit('","x"]')))
        .when(d % 5 == 1, F.concat(F.lit('"'), F.col("lang"), F.lit(" , "), F.col("source"), F.lit('"')))
        .when(d % 5 == 2, F.lit('""'))
        .when(d % 5 == 3, F.lit("[]"))
    )
    extent = (
        F.when(d % 7 == 0, F.lit("null"))
        .when(d % 7 == 1, F.lit("[[0,0]]"))
        .when(d % 7 == 2, F.lit('[["x",0],[1,1]]'))
        .when(d % 7 == 3, F.lit("[[0,0],[1]]"))
        .otherwise(F.concat(F.lit("[[-"), _text(d % 180 + 1), F.lit(",-2],["), _text(d % 180), F.lit(".5,4]]")))
    )
    views = F.when(d % 3 == 0, F.lit("null")).when(d % 3 == 1, _text(d * 3))
    members = F.concat_ws(
        ",",
        F.concat(F.lit('"created":'), created),
        F.concat(F.lit('"modified":'), _text(millis)),
        F.concat(F.lit('"tags":'), tags),
        F.concat(F.lit('"extent":'), extent),
        F.concat(F.lit('"numViews":'), views),
    )
    raw = F.concat(F.substring(texts, F.lit(1), F.length(texts) - 1), F.lit(","), members, F.lit("}"))
    return table(spark, sf_dir, "documents").select(raw.alias("raw"), d.alias("seq"))


def layer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user may paste to name a layer, in every accepted form."""
    k = F.col("o_orderkey")
    host = F.concat(F.lit("https://svc"), _text(k % 5), F.lit(".example.org/rest/"), _text(k))
    viewer = F.lit("https://maps.example.org/apps/mapviewer/index.html?")
    encoded = F.concat(F.lit("https%3A%2F%2Fsvc.example.org%2Frest%2F"), _text(k), F.lit("%2FFeatureServer"))
    forms = [
        F.concat(viewer, F.lit("panel=x&url="), encoded, F.lit("&zoom=3")),
        F.concat(viewer, F.lit("url=")),
        F.concat(host, F.lit("/FeatureServer")),
        F.concat(host, F.lit("/FeatureServer/")),
        F.concat(host, F.lit("/FeatureServer/"), _text(k % 12)),
        F.concat(F.lit("  "), host, F.lit("/MapServer/2/ ")),
        F.md5(_text(k)),
        F.concat(F.lit("https://maps.example.org/home/item.html?id="), F.md5(_text(k)), F.lit("&view=list")),
    ]
    reference = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(forms))):
        reference = F.when(k % len(forms) == i, form).otherwise(reference)
    return table(spark, sf_dir, "orders").select(k.alias("ref_no"), reference.alias("reference"))


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, most of them followed by a request about some item."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c * 3 + t
    item = F.md5(_text(c))
    suffix = (
        F.when(n % 7 == 0, F.concat(F.lit(" Count Rows for "), item))
        .when(n % 7 == 1, F.concat(F.lit(" please PREVIEW https://a.example.org/x/FeatureServer/3 now")))
        .when(n % 7 == 2, F.concat(F.lit(" how many records in https://a.example.org/item.html?id="), item, F.lit("0")))
        .when(n % 7 == 3, F.lit(" map this /MapServer thing"))
        .when(n % 7 == 4, F.lit(" https://m.example.org/apps/mapviewer/index.html?url=https://a/FeatureServer "))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("text", suffix).alias("text")
    )


