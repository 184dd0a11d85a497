"""Counts, extents, checks and previews of the features in service layers.

``features`` has item_id, layer_kind, layer_index, an ordering column ``feature_id``, attributes,
and for the geometric operators ``geometry`` (GeoJSON text). ``layers`` lists what exists:
item_id, item_type, layer_kind, layer_index, layer_name, geometry_type and ``error``, the reason a
layer cannot be read (null when it can).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.predicates import previewable
from ..functions.text import lookup_id, parse_layer_ref, target_class
from ..functions.values import layer_key
from ..functions.where import checked, refusal
from .rows import first_rows

LAYER = ["item_id", "layer_kind", "layer_index"]

# How many features a check looks at, and how many a preview shows.
BOUNDS_SAMPLE = 5
DIAGNOSE_SAMPLE = 100
PREVIEW_LIMIT = 300
# Errors of requests.
PROJECTED = "coordinates are not longitude and latitude"
UNKNOWN = "reference is not known"


def with_positions(features: DataFrame) -> DataFrame:
    """Add ``positions``: every coordinate of the geometry, null without a usable one."""
    return features.withColumn("positions", G.points(F.try_parse_json("geometry")))


def row_counts(features: DataFrame, layers: DataFrame, where: str = "1=1") -> DataFrame:
    """Rows per layer and table that satisfy ``where``; an unreadable layer has a null count.

    ``where`` is a user's text here and below, so it is checked (:mod:`..functions.where`) before it is evaluated."""
    counted = features.filter(checked(features, where)).groupBy(*LAYER).agg(F.count("*").alias("n"))
    readable = F.col("error").isNull()
    return layers.join(counted, LAYER, "left").select(
        *LAYER,
        "layer_name",
        F.when(readable, F.coalesce("n", F.lit(0))).cast("bigint").alias("row_count"),
        "error",
    )


def predicate_counts(features: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """How many features of each item satisfy each predicate, in one pass; a refused one is a row with the reason."""
    reasons = [refusal(features, where) for where in predicates]
    named = lambda k: (F.lit(k).alias("where_no"), F.lit(predicates[k]).alias("predicate"))
    accepted = [k for k, reason in enumerate(reasons) if reason is None]
    refused = [F.struct(*named(k), F.lit(reason).alias("reason")) for k, reason in enumerate(reasons) if reason]
    parts = []
    if accepted:
        sums = features.groupBy("item_id").agg(*[F.count_if(F.expr(predicates[k])).alias(f"n{k}") for k in accepted])
        found = F.explode(F.array(*[F.struct(*named(k), F.col(f"n{k}").alias("matching")) for k in accepted])).alias("found")
        parts.append(sums.select("item_id", found).select("item_id", "found.*", F.lit(None).cast("string").alias("reason")))
    if refused:
        listed = features.sparkSession.range(1).select(F.explode(F.array(*refused)).alias("found")).select("found.*")
        parts.append(listed.withColumns({"item_id": F.lit(None).cast("string"), "matching": F.lit(None).cast("bigint")}))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select("where_no", "predicate", F.col("reason").isNull().alias("accepted"), "reason", "item_id", "matching")


def total_count(counts: DataFrame) -> DataFrame:
    """Per item: rows over its readable layers and tables, and how many of those there are."""
    return counts.groupBy("item_id").agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_count"),
        F.count_if(F.col("layer_kind") == "layer").alias("total_layers"),
        F.count_if(F.col("layer_kind") == "table").alias("total_tables"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def displayed_counts(counts: DataFrame) -> DataFrame:
    """The older listing of counts, as text with "Error" for an unreadable layer."""
    shown = F.coalesce(F.col("row_count").cast("string"), F.lit("Error"))
    return counts.select(*LAYER, "layer_name", shown.alias("row_count"))


def resolve_targets(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Resolve user references to items of the catalog.

    ``requests`` has ``reference`` and an optional wished ``layer_index``; ``items`` has item_id
    and url. Adds kind, target_class, resolved_id (null when unknown) and the effective
    layer_index: the wish, else the one in the URL, else what the kind of reference implies.
    A service that is not in the catalog keeps its service_url, under which its layers are found.
    """
    parsed = requests.withColumn("ref", parse_layer_ref(F.col("reference")))
    if "layer_index" not in requests.columns:
        parsed = parsed.withColumn("layer_index", F.lit(None).cast("int"))
    url = F.regexp_replace("ref.url", "/+$", "")
    in_url = F.regexp_extract(url, "/([0-9]+)$", 1)
    parsed = parsed.select(
        *[c for c in requests.columns if c != "layer_index"],
        F.col("ref.kind").alias("kind"),
        target_class(F.col("ref")).alias("target_class"),
        lookup_id(F.col("ref.item_id")).alias("wanted_id"),
        F.regexp_replace(url, "/[0-9]+$", "").alias("service_url"),
        F.coalesce("layer_index", F.nullif(in_url, F.lit("")).try_cast("int"), "ref.layer_index").alias("layer_index"),
    )
    keyed = parsed.withColumn("key", F.when(F.col("kind") == "item_id", F.col("wanted_id")).otherwise(F.col("service_url")))
    # Items answer to their id and to their URL: one lookup serves both kinds of reference.
    names = F.array(
        F.struct(F.lit("item_id").alias("kind"), F.col("item_id").alias("key")),
        F.struct(F.lit("service_url").alias("kind"), F.regexp_replace("url", "/+$", "").alias("key")),
    )
    known = items.select("item_id", F.inline(names)).filter(F.col("key").isNotNull())
    # Items may share a URL: the smallest id answers, so a request stays one row.
    known = known.groupBy("kind", "key").agg(F.min("item_id").alias("resolved_id"))
    return keyed.join(known, ["kind", "key"], "left").select(
        *[c for c in requests.columns if c != "layer_index"],
        "kind", "target_class", "service_url", "layer_index", "resolved_id",
    )


def target_key() -> Column:
    """What a target's layers are found under: the item, or the URL of a service that is no item."""
    return F.coalesce("resolved_id", F.when(F.col("kind") == "service_url", F.col("service_url")))


def requested_counts(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per request: ok, error, total_count and the number of layers counted.

    With a layer index only that layer is counted, else all layers and tables of the item. The
    counts are summed before they are looked up, so repeated requests stay apart. ``item_id`` of
    ``counts`` is the URL for a service that is no item.
    """
    sums = (F.count("*").alias("layers"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("rows"))
    whole = counts.groupBy(F.col("item_id").alias("target")).agg(*sums)
    single = counts.filter(F.col("layer_kind") == "layer").groupBy(
        F.col("item_id").alias("target"), F.col("layer_index").alias("wanted_index")
    ).agg(*sums)
    summed = whole.withColumn("wanted_index", F.lit(None).cast("int")).unionByName(single)
    wanted = targets.select("reference", "resolved_id", target_key().alias("target"), F.col("layer_index").alias("wanted_index"))
    found = wanted.alias("w").join(
        summed.alias("s"),
        (F.col("w.target") == F.col("s.target")) & F.col("w.wanted_index").eqNullSafe(F.col("s.wanted_index")),
        "left",
    ).select("reference", "resolved_id", "w.target", "w.wanted_index", "layers", "rows")
    counted = F.coalesce("layers", F.lit(0))
    missing = F.concat_ws(" ", F.lit("no layer"), F.col("wanted_index").cast("string"))
    error = F.when(F.col("target").isNull(), F.lit(UNKNOWN)).when(counted == 0, missing)
    return found.select(
        "reference", "resolved_id", F.col("wanted_index").alias("layer_index"),
        error.isNull().alias("ok"), error.alias("error"),
        counted.alias("layers_counted"), F.coalesce("rows", F.lit(0)).alias("total_count"),
    )


def requested_details(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The layers and tables behind each distinct request: index, name, rows and error of each."""
    wanted = targets.select(
        "reference", target_key().alias("item_id"), F.col("layer_index").alias("wanted_index")
    ).filter(F.col("item_id").isNotNull()).distinct()
    this_layer = (F.col("layer_kind") == "layer") & (F.col("layer_index") == F.col("wanted_index"))
    return wanted.join(counts, "item_id").filter(F.col("wanted_index").isNull() | this_layer).select(
        "reference", "item_id", "layer_kind", "layer_index", "layer_name", "row_count", "error"
    )


def extents(features: DataFrame) -> DataFrame:
    """Smallest box around each layer's features; null for a layer without positions."""
    boxed = with_positions(features).select(*LAYER, G.bounds(F.col("positions")).alias("box"))
    return boxed.groupBy(*LAYER).agg(
        F.min("box.xmin").alias("xmin"),
        F.min("box.ymin").alias("ymin"),
        F.max("box.xmax").alias("xmax"),
        F.max("box.ymax").alias("ymax"),
    )


def bounds_check(features: DataFrame, sample: int = BOUNDS_SAMPLE) -> DataFrame:
    """Per layer: does one of its first features start outside longitude and latitude."""
    head = first_rows(features.select(*LAYER, "feature_id", "geometry"), LAYER, sample, ["feature_id"])
    return (
        with_positions(head)
        .groupBy(*LAYER)
        .agg(F.bool_or(G.not_lon_lat(F.col("positions"))).alias("bounds_bad"))
    )


def diagnose(features: DataFrame, sample: int = DIAGNOSE_SAMPLE) -> DataFrame:
    """Coordinate range of each layer's first features; the verdict looks at the minima only."""
    head = first_rows(features.select(*LAYER, "feature_id", "geometry"), LAYER, sample, ["feature_id"])
    verdict = F.col("xmin").between(-180, 180) & F.col("ymin").between(-90, 90)
    return extents(head).withColumn("is_lat_lon", F.coalesce(verdict, F.lit(False)))


def preview_features(
    features: DataFrame, where: str = "1=1", limit: int = PREVIEW_LIMIT, layer: tuple[str, int] | None = None
) -> DataFrame:
    """The first features of every layer (not table), or of one ``(item_id, layer_index)``."""
    chosen = features.filter(checked(features, where)).filter(F.col("layer_kind") == "layer")
    if layer is None:
        return first_rows(chosen, LAYER, limit, ["feature_id"])
    one = chosen.filter((F.col("item_id") == layer[0]) & (F.col("layer_index") == layer[1]))
    return one.orderBy("feature_id").limit(limit)


def as_geojson(features: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature text per row, under the columns that name it."""
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.try_parse_json("geometry").alias("geometry"),
            F.struct(*properties).alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )
    return features.select(*LAYER, "feature_id", feature.alias("feature"))


def feature_collections(geojson: DataFrame) -> DataFrame:
    """One FeatureCollection document per layer, of all its rows.

    For previews, whose limit bounds a layer's rows; whole layers are written as feature rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("feature_id", "feature")))
    body = F.array_join(F.transform("listed", lambda f: f["feature"]), ",")
    return (
        geojson.groupBy(*LAYER)
        .agg(listed.alias("listed"))
        .select(
            *LAYER,
            F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"),
            F.size("listed").alias("n_features"),
        )
    )


def preview_status(
    features: DataFrame,
    layers: DataFrame,
    targets: DataFrame,
    where: str = "1=1",
    limit: int = PREVIEW_LIMIT,
) -> DataFrame:
    """One row per resolved request: ok, error, layer name, geometry type, extent and row count.

    A failed request is a row with ``ok`` false and a reason, never an exception.
    """
    named = layers.filter(F.col("layer_kind") == "layer")
    totals = layers.groupBy("item_id").agg(
        F.first("item_type").alias("item_type"),
        F.count_if(F.col("layer_kind") == "layer").alias("n_layers"),
    )
    wanted = targets.select(
        "reference", target_key().alias("item_id"), F.coalesce("layer_index", F.lit(0)).alias("layer_index")
    )
    asked = wanted.select("item_id", "layer_index").distinct()
    chosen = features.filter(checked(features, where)).filter(F.col("layer_kind") == "layer")
    shown = first_rows(
        chosen.join(asked, ["item_id", "layer_index"], "left_semi").select(*LAYER, "feature_id", "geometry"),
        LAYER,
        limit,
        ["feature_id"],
        rank_column="place",
    )
    off = (F.col("place") <= BOUNDS_SAMPLE) & G.not_lon_lat(F.col("positions"))
    described = (
        with_positions(shown)
        .withColumn("box", G.bounds(F.col("positions")))
        .groupBy(*LAYER)
        .agg(
            F.count("*").alias("n"),
            F.min("box.xmin").alias("xmin"),
            F.min("box.ymin").alias("ymin"),
            F.max("box.xmax").alias("xmax"),
            F.max("box.ymax").alias("ymax"),
            F.bool_or(off).alias("bounds_bad"),
        )
        .drop("layer_kind")
    )
    joined = (
        wanted.join(totals, "item_id", "left")
        .join(
            named.select("item_id", "layer_index", "layer_name", "geometry_type", F.col("error").alias("layer_error")),
            ["item_id", "layer_index"],
            "left",
        )
        .join(described, ["item_id", "layer_index"], "left")
    )
    index = F.col("layer_index").cast("string")
    error = (
        F.when(F.col("item_type").isNull(), F.lit(UNKNOWN))
        .when(~previewable(), F.concat(F.lit("no preview of item type "), F.col("item_type")))
        .when(
            F.col("layer_name").isNull(),
            F.concat(F.lit("no layer "), index, F.lit(" among "), F.col("n_layers").cast("string")),
        )
        .when(F.col("layer_error").isNotNull(), F.concat(F.lit("layer cannot be read: "), F.col("layer_error")))
        .when(F.col("bounds_bad"), F.lit(PROJECTED))
    )
    box = {c: F.when(F.col("ok"), F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")}
    return (
        joined.withColumn("error", error)
        .withColumn("ok", F.col("error").isNull())
        .select(
            "reference", "item_id", "layer_index",
            layer_key(F.col("item_id"), F.col("layer_index")).alias("layer_key"),
            "ok", "error", "layer_name", "geometry_type",
            *[c.alias(n) for n, c in box.items()],
            F.when(F.col("ok"), F.coalesce("n", F.lit(0))).alias("n_features"),
        )
    )


_BOX = ("xmin", "ymin", "xmax", "ymax")


def refresh_previews(shown: DataFrame, fetched: DataFrame) -> DataFrame:
    """Replace shown preview layers by newly fetched ones, keeping the old where that failed.

    Both are keyed by (item_id, layer_index) and carry layer_name, geometry_type, geojson and the
    box; ``fetched`` also has ``ok``. A fetched layer without a box keeps the old box.
    """
    key = ["item_id", "layer_index"]
    new = fetched.select(*key, F.struct("ok", "layer_name", "geometry_type", "geojson", *_BOX).alias("new"))
    fresh = F.coalesce(F.col("new.ok"), F.lit(False))
    boxed = fresh & F.col("new.xmin").isNotNull()
    columns = {
        "layer_name": F.when(fresh, F.col("new.layer_name")).otherwise(F.col("layer_name")),
        "geometry_type": F.when(fresh, F.coalesce("new.geometry_type", "geometry_type")).otherwise(
            F.col("geometry_type")
        ),
        "geojson": F.when(fresh, F.col("new.geojson")).otherwise(F.col("geojson")),
        **{c: F.when(boxed, F.col(f"new.{c}")).otherwise(F.col(c)) for c in _BOX},
    }
    return shown.join(new, key, "left").withColumns(columns).drop("new")
