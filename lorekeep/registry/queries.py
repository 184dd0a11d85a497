"""Named queries: each runs one operator over whole driver tables of a scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import predicates
from ..functions import text as X
from ..functions import values as V
from ..operators import current, health, history, issues, layers, normalize, remediation, scores, search
from ..operators import sections, symbology, watchlist
from ..plans.dashboard import dashboard_frames
from ..plans.snapshot import SnapshotOptions, run_snapshot
from ..sources import fixtures as fx
from ..sources import exports
from ..sources import buckets as layout
from ..sources.driver_tables import table
from ..sources.fixtures import AS_OF, RUN
from ..sources.footers import row_count
from ..sources.scratch import scratch_folder
from ..sources.warehouse import Warehouse

# The least; a catalog of billions of items has thousands of buckets.
BUCKETS = 8
ITEM_BYTES = 64  # of an item without texts


def item_buckets(spark: SparkSession, d: str) -> int:
    """Buckets for items made of orders, by the number of these: no rows are read."""
    return layout.buckets_for(row_count(spark, f"{d}/orders.parquet"), F.col("n") * ITEM_BYTES, BUCKETS)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- frames several queries start from ---------------------------------------------------------


def _scores(spark: SparkSession, d: str) -> DataFrame:
    run = F.when(F.col("item_id").cast("bigint") % 7 == 0, F.lit(fx.EARLIER_RUN)).otherwise(F.lit(RUN))
    return scores.score_items(fx.catalog_items(spark, d), run, AS_OF)


def _health(spark: SparkSession, d: str) -> DataFrame:
    return health.classify_probes(fx.probe_results(spark, d), None, None)


def _base(spark: SparkSession, d: str) -> DataFrame:
    # Orders and the grouped probe results have one row per item each.
    return remediation.remediation_base(
        fx.catalog_items(spark, d), _scores(spark, d), _health(spark, d), RUN, one_per_item=True
    )


def _versions_input(spark: SparkSession, d: str) -> DataFrame:
    return fx.observations(spark, d).withColumn("content_hash", V.canonical_digest(F.col("content")))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.rebuild(_versions_input(spark, d), fx.run_log(spark, d), ["content"])


# --- issue lists -------------------------------------------------------------------------------


@query
def missing_tags(spark, d):
    return issues.missing_tags(fx.catalog_items(spark, d))


@query
def missing_tags_strict(spark, d):
    return issues.missing_tags(fx.catalog_items(spark, d), null_means_missing=False)


@query
def missing_description(spark, d):
    return issues.missing_description(fx.catalog_items(spark, d))


@query
def missing_description_strict(spark, d):
    return issues.missing_description(fx.catalog_items(spark, d), null_means_missing=False)


@query
def missing_extent(spark, d):
    return issues.missing_extent(fx.catalog_items(spark, d))


@query
def stale_items(spark, d):
    return issues.stale_items(fx.catalog_items(spark, d), AS_OF)


@query
def broken_services(spark, d):
    return health.broken_services(fx.catalog_items(spark, d), _health(spark, d), RUN)


@query
def health_classification(spark, d):
    return _health(spark, d)


@query
def owner_summary(spark, d):
    return issues.owner_summary(fx.catalog_items(spark, d), AS_OF)


@query
def owner_summary_full(spark, d):
    return issues.owner_summary(fx.catalog_items(spark, d), AS_OF, limit=None)


@query
def owner_summary_admin(spark, d):
    return issues.owner_summary(fx.catalog_items(spark, d), AS_OF, description_column="missing_desc")


def _dashboard(name: str) -> None:
    def run(spark, d):
        return dashboard_frames(fx.catalog_items(spark, d), _health(spark, d), RUN, AS_OF)[name]

    QUERIES[f"dashboard_{name}"] = run


for _name in ("missing_tags", "missing_description", "missing_extent", "stale_items", "broken_services"):
    _dashboard(_name)


@query
def report_one_pass(spark, d):
    """The rows of all sections of a report that look at items."""
    return sections.section_rows(fx.catalog_items(spark, d), _health(spark, d), RUN, AS_OF)


@query
def item_scan(spark, d):
    return normalize.scan_items(
        fx.catalog_items(spark, d), "has_extent", ["1-URGENT", "2-HIGH"]
    ).select("item_id", "title", "item_type", "owner")


# --- scores ------------------------------------------------------------------------------------


@query
def quality_scores(spark, d):
    return _scores(spark, d).select("run_id", "item_id", "score", "breakdown_json", "missing_json")


@query
def quality_stats(spark, d):
    return scores.quality_stats(_scores(spark, d), RUN)


@query
def snapshot_summary(spark, d):
    """All items are counted from the footers of their files."""
    totals = row_count(spark, f"{d}/orders.parquet", name="total_items")
    return issues.run_summary(totals, _scores(spark, d), _health(spark, d), RUN)


# --- remediation -------------------------------------------------------------------------------


@query
def remediation_base(spark, d):
    """Items, scores and checks in the same buckets of the item: the joins shuffle nothing."""
    frames = {"items": fx.catalog_items(spark, d), "scores": _scores(spark, d), "health": _health(spark, d)}
    root, stored, buckets = scratch_folder(spark, "by_item"), {}, item_buckets(spark, d)
    for name, rows in frames.items():
        layout.write_buckets(rows, f"{root}/{name}", buckets=buckets)
        live = {b: "" for b in range(buckets)}
        stored[name] = layout.read_buckets(spark, f"{root}/{name}", live, rows.schema, buckets=buckets, complete=False)
    return remediation.remediation_base(*stored.values(), RUN, one_per_item=True)


@query
def remediation_tags(spark, d):
    return remediation.remediation_list(_base(spark, d), "missing_tags", AS_OF)


@query
def remediation_description(spark, d):
    return remediation.remediation_list(_base(spark, d), "missing_description", AS_OF)


@query
def remediation_stale(spark, d):
    return remediation.remediation_list(_base(spark, d), "stale_items", AS_OF)


@query
def remediation_broken(spark, d):
    return remediation.remediation_list(_base(spark, d), "broken_services", AS_OF)


@query
def remediation_base_fanout(spark, d):
    """Checks repeated per line of an order: the item is repeated for each."""
    k = F.col("l_orderkey")
    repeated = table(spark, d, "lineitem").select(
        F.lit(RUN).alias("run_id"),
        k.cast("string").alias("item_id"),
        (F.col("l_quantity") < 40).alias("ok"),
        F.col("l_quantity").cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("l_partkey").cast("string").alias("checked_url"),
    )
    base = remediation.remediation_base(fx.catalog_items(spark, d), _scores(spark, d), repeated, RUN)
    return base.select("item_id", "owner", "quality_score", "health_ok", "status_code", "checked_url")


@query
def owner_remediation(spark, d):
    return issues.owner_remediation(fx.catalog_items(spark, d), _health(spark, d), RUN, AS_OF)


@query
def remediation_pack(spark, d):
    return remediation.remediation_actions(_base(spark, d), AS_OF)


# --- runs and status ---------------------------------------------------------------------------


@query
def latest_run(spark, d):
    return history.latest_run(fx.run_log(spark, d))


@query
def previous_run(spark, d):
    return history.previous_run(fx.run_log(spark, d), RUN)


@query
def run_lookup(spark, d):
    runs = normalize.run_by_id(fx.run_log(spark, d), fx.EARLIER_RUN)
    return runs.select(
        "run_id",
        V.short_id(F.col("run_id")).alias("short_id"),
        V.report_base_name(F.col("started_at"), F.col("run_id")).alias("report_name"),
        "started_at",
        "finished_at",
    )


@query
def warehouse_status(spark, d):
    latest = history.latest_run(fx.run_log(spark, d))
    return issues.status_metrics(fx.catalog_items(spark, d), _scores(spark, d), _health(spark, d), latest)


# --- items and history -------------------------------------------------------------------------


@query
def content_hash(spark, d):
    fields = ("item_id", "title", "item_type", "owner", "url", "tags_json", "modified_at")
    items = fx.catalog_items(spark, d).withColumn(
        "modified_at", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")
    )
    return items.select("item_id", V.canonical_digest(*[F.col(f) for f in fields]).alias("content_hash"))


@query
def normalize_items(spark, d):
    return normalize.normalize_items(fx.raw_items(spark, d), RUN, AS_OF)


@query
def rejected_items(spark, d):
    return normalize.rejected_items(fx.raw_items(spark, d)).select("seq", "reason")


@query
def normalized_scan(spark, d):
    items = normalize.normalize_items(fx.raw_items(spark, d), RUN, AS_OF)
    chosen = normalize.scan_items(items, None, ["Feature Service"])
    return chosen.select("item_id", "title", "owner", "num_views")


@query
def normalized_scores(spark, d):
    items = normalize.normalize_items(fx.raw_items(spark, d), RUN, AS_OF)
    return scores.score_items(items, RUN, AS_OF).select("item_id", "score", "missing_json")


@query
def item_type_flags(spark, d):
    items = fx.document_items(spark, d).withColumnRenamed("type", "item_type")
    return items.groupBy("item_type").agg(
        F.count_if(predicates.previewable()).alias("previewable"),
        F.count_if(predicates.countable()).alias("countable"),
        F.count_if(predicates.has_url()).alias("with_url"),
    )


@query
def batch_last_wins(spark, d):
    """A batch of order lines in which one item has a third of the rows."""
    k = F.col("l_orderkey")
    batch = table(spark, d, "lineitem").select(
        F.when(k % 3 == 0, F.lit("hot")).otherwise((k % 1000).cast("string")).alias("item_id"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
    )
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return current.last_in_batch(batch, *order)


@query
def scan_capped(spark, d):
    """The first 200 parts sold, each by its last sale."""
    batch = table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"), F.col("l_linestatus").alias("item_type"),
        "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber",
    )
    order = ("l_shipdate", "l_orderkey", "l_linenumber")
    chosen = normalize.scan_items(batch, "l_returnflag <> 'A'", ["F", "O"], 200, last_wins=order)
    return chosen.select("item_id", *order)


@query
def snapshot_chain(spark, d):
    """Two runs over all raw items, the second with edits of every third one behind the unedited rows."""
    raw = fx.raw_items(spark, d)
    edit = F.regexp_replace("raw", '"access":"public"', '"access":"org"')
    edits = raw.filter("seq % 3 = 0").select(edit.alias("raw"), (F.col("seq") + 1_000_000_000).alias("seq"))
    buckets = layout.buckets_for(raw, F.octet_length("raw"), BUCKETS)
    warehouse = Warehouse(spark, scratch_folder(spark, "warehouse"), buckets=buckets)
    options = SnapshotOptions(query="true", enable_scores=False, enable_health=False)
    for run, start, rows in (("first", "2024-05-01 00:00:00", raw), ("second", "2024-06-01 00:00:00", raw.unionByName(edits))):
        run_snapshot(warehouse, rows, run, start, start, options)
    scored = scores.score_items(warehouse.items_current(), "second", AS_OF).select("item_id", "score")
    names = ("item_id", "content_hash", "title", "valid_from", "valid_to", "is_current", "first_seen_run_id", "last_seen_run_id")
    return warehouse.items_history().select(*names).join(scored, "item_id")


@query
def upsert_current(spark, d):
    """One batch over a table in buckets: those the batch touches are read, joined and written anew."""
    seen = fx.observations(spark, d)
    even = F.substring("run_id", -1, 1).cast("int") % 2 == 0
    older = current.last_in_batch(seen.filter(~even), "observed_at")
    batch = current.last_in_batch(seen.filter(even), "observed_at")
    root, buckets = scratch_folder(spark, "items_current"), item_buckets(spark, d)
    live = {}
    for run, rows in (("older", older), ("batch", batch)):
        touched = layout.touched_buckets(rows, buckets=buckets)
        old = layout.read_buckets(spark, root, {b: live[b] for b in touched if b in live}, rows.schema, buckets=buckets)
        layout.write_buckets(current.replace_rows(old, rows), f"{root}/as_of_run={run}", buckets=buckets)
        live |= {b: f"as_of_run={run}" for b in touched}
    return layout.read_buckets(spark, root, live, batch.schema, buckets=buckets)


@query
def scd2_rebuild(spark, d):
    return _history(spark, d)


LAST_RUNS = ("run_200106", "run_200107", "run_200108")


def _applied(spark, d):
    """The last three runs applied one by one to the history before them, in buckets: the folder of all that was written, the
    schema, and the run that holds each bucket's open versions."""
    seen, runs = _versions_input(spark, d), fx.run_log(spark, d)
    starts = {
        r.run_id: r.started_at
        for r in runs.filter(F.col("run_id").isin(*LAST_RUNS)).limit(len(LAST_RUNS)).collect()
    }
    before = history.rebuild(seen.filter(~F.col("run_id").isin(*LAST_RUNS)), runs, ["content"])
    root, buckets = scratch_folder(spark, "items_history"), item_buckets(spark, d)
    layout.write_buckets(before, f"{root}/as_of_run=before", "is_current", buckets=buckets)
    live = {b: "before" for b in layout.touched_buckets(before, buckets=buckets)}
    for run in LAST_RUNS:
        batch = seen.filter(F.col("run_id") == run)
        touched = layout.touched_buckets(batch, buckets=buckets)
        opened = _open(spark, root, {b: live[b] for b in touched if b in live}, before.schema, buckets)
        versions = history.advance(opened, batch, run, starts[run], ["content"])
        layout.write_buckets(versions, f"{root}/as_of_run={run}", "is_current", buckets=buckets)
        live |= {b: run for b in touched}
    return root, before.schema, live, buckets


def _open(spark, root, live, schema, buckets):
    folders = {b: f"as_of_run={run}/is_current=true" for b, run in live.items()}
    return layout.read_buckets(spark, root, folders, schema, buckets=buckets).withColumn("is_current", F.lit(True))


@query
def scd2_apply(spark, d):
    root, schema, live, buckets = _applied(spark, d)
    closed = spark.read.schema(schema).parquet(root).filter("NOT is_current").select(*schema.names)
    return _open(spark, root, live, schema, buckets).unionByName(closed)


@query
def change_feed(spark, d):
    """What the last two runs opened, closed and saw again, from what they wrote."""
    root, schema, _, _ = _applied(spark, d)
    reader = spark.read.schema(StructType([*schema, StructField("as_of_run", StringType())])).option("basePath", root)
    written = reader.parquet(*[f"{root}/as_of_run={run}" for run in LAST_RUNS[1:]])
    return history.feed(written.select("as_of_run", *schema.names))


@query
def change_report(spark, d):
    return history.changes_of_run(_history(spark, d), "run_199806", limit=20).select(
        "item_id", "content", "change_type"
    )


@query
def change_report_full(spark, d):
    return history.changes_of_run(_history(spark, d), "run_199806").select(
        "item_id", "content", "change_type"
    )


@query
def change_report_looking_back(spark, d):
    runs = fx.run_log(spark, d)
    return history.changes_of_run(
        _history(spark, d), "run_199502", earlier=runs.filter(F.col("started_at") < V.ntz("1995-02-01 00:00:00"))
    ).select("item_id", "content", "change_type")


# --- watchlist ---------------------------------------------------------------------------------


@query
def watchlist_replay(spark, d):
    return watchlist.replay(fx.watch_log(spark, d))


@query
def watchlist_export(spark, d):
    return watchlist.listing(watchlist.replay(fx.watch_log(spark, d)))


@query
def watchlist_apply_log(spark, d):
    """Replaying the log in two parts gives the same list as at once."""
    log = fx.watch_log(spark, d)
    half = V.ntz("2024-01-15 00:00:00")
    saved = watchlist.replay(log.filter(F.col("added_at") < half))
    return watchlist.apply_log(saved, log.filter(F.col("added_at") >= half))


@query
def watchlist_upsert(spark, d):
    """The list after half of the log, then every later buyer saved again."""
    log = fx.watch_log(spark, d)
    half = V.ntz("2024-01-15 00:00:00")
    before = watchlist.replay(log.filter(F.col("added_at") < half))
    later = log.filter((F.col("added_at") >= half) & (F.col("source_query") == "purchase"))
    return watchlist.upsert(before, current.last_in_batch(later, "seq"))


@query
def watchlist_remove(spark, d):
    saved = watchlist.replay(fx.watch_log(spark, d))
    gone = table(spark, d, "customer").filter(F.col("c_nationkey") == 3)
    return watchlist.remove(saved, gone.select(F.col("c_custkey").cast("string").alias("item_id")))


# --- search ------------------------------------------------------------------------------------

SEARCH_TERM = "the"


@query
def search_rank(spark, d):
    hits = search.search_items(fx.document_items(spark, d), SEARCH_TERM, "Feature Layer", max_items=50)
    saved = table(spark, d, "labels").filter(F.col("quality") == 1)
    saved = saved.select(F.md5(F.col("doc_id").cast("string")).alias("item_id"))
    ranked = search.rank_hits(search.mark_saved(hits, saved))
    return ranked.select("hit_no", "id", "title", "type", "owner", "url", "quality_score", "is_saved")


@query
def search_unranked(spark, d):
    hits = search.search_items(fx.document_items(spark, d), SEARCH_TERM)
    return search.rank_hits(hits, by_quality=False).select("hit_no", "title", "quality_score")


@query
def search_scores(spark, d):
    hits = search.search_items(fx.document_items(spark, d), SEARCH_TERM, None, max_items=None)
    return search.score_hits(hits).select("id", "title", "quality_score")


@query
def search_indexed(spark, d):
    """The same hits by way of an index, which is written first."""
    items = fx.document_items(spark, d)
    index = search.write_postings(items, scratch_folder(spark, "postings"))
    hits = search.search_indexed(items, index, SEARCH_TERM, None, max_items=None)
    return search.score_hits(hits).select("id", "title", "quality_score")


# --- layers ------------------------------------------------------------------------------------

WHERE = "measure > 0"


def _layer_counts(spark, d):
    return layers.row_counts(fx.layer_features(spark, d), fx.service_layers(spark, d), WHERE)


@query
def layer_row_counts(spark, d):
    return _layer_counts(spark, d)


@query
def layer_row_total(spark, d):
    return layers.total_count(_layer_counts(spark, d))


@query
def layer_counts_displayed(spark, d):
    return layers.displayed_counts(_layer_counts(spark, d))


PREDICATES = (
    "measure > 0",
    "class_value IN ('BUILDING', 'MACHINERY') AND NOT layer_index = 1",
    "lower(class_value) LIKE 'h%' OR feature_id BETWEEN 10 AND 20",
    "x IS NOT NULL AND abs(x) + abs(y) < 90",
    "coalesce(y, 0) >= 45 AND length(class_value) > 8",
    "substring(class_value, 1, 2) = 'AU' AND measure / 2 - 1 < 100 % 7",
    "reflect('java.lang.System', 'getProperty', 'user.home') = '/root'",
    "java_method('java.util.UUID', 'randomUUID') IS NOT NULL",
    "from_json('1', schema_of_json(reflect('java.lang.System', 'getProperty', 'user.home'))) IS NULL",
    "measure > (SELECT avg(c_acctbal) FROM customer)",
    "EXISTS (SELECT 1)",
    "secret = 1",
    "exists(array(measure), v -> v > 0)",
    "rand() < 0.5",
    "count(*) > 1",
    "measure + 1",
    "measure >",
)


@query
def layer_where_checked(spark, d):
    """Users' predicates over all features: counts of the accepted ones, reasons of the refused ones."""
    return layers.predicate_counts(fx.layer_features(spark, d), PREDICATES)


def _service_url(n):
    return F.concat(F.lit("https://svc.example.org/"), n, F.lit("/FeatureServer"))


def _services(spark, d):
    n = F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select(F.concat(F.lit("svc_"), n).alias("item_id"), _service_url(n).alias("url"))


def _requests(spark, d, services=None):
    """Suppliers ask for the service of their nation: by id, by link or by service URL."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    service = _service_url(n)
    reference = (
        F.when(k % 5 == 0, F.concat(F.lit("svc_"), n))
        .when(k % 5 == 1, F.concat(F.lit("https://x.example.org/item.html?id=svc_"), n, F.lit("&v=1")))
        .when(k % 5 == 2, service)
        .when(k % 5 == 3, F.concat(service, F.lit("/"), (k % 4).cast("string")))
        .otherwise(F.concat(F.lit("lost_"), n))
    )
    requests = table(spark, d, "supplier").select(reference.alias("reference"))
    return layers.resolve_targets(requests, _services(spark, d) if services is None else services)


@query
def layer_resolve(spark, d):
    return _requests(spark, d)


@query
def layer_count_requests(spark, d):
    return layers.requested_counts(_layer_counts(spark, d), _requests(spark, d))


@query
def layer_count_unlisted(spark, d):
    """Some services are no items, so their layers are known by URL alone; of others two items have the same URL."""
    key = lambda c: F.substring(c, 5, 9).cast("int")
    services = _services(spark, d)
    listed = services.filter(key("item_id") % 6 != 5)
    twins = listed.filter(key("item_id") % 4 == 0).withColumn("item_id", F.concat(F.lit("twin_"), "item_id"))
    n = F.substring("item_id", 5, 9)
    name = F.when(key("item_id") % 6 == 5, _service_url(n)).otherwise(F.col("item_id"))
    counts = _layer_counts(spark, d).withColumn("item_id", name)
    return layers.requested_counts(counts, _requests(spark, d, listed.unionByName(twins)))


@query
def layer_count_details(spark, d):
    return layers.requested_details(_layer_counts(spark, d), _requests(spark, d))


@query
def layer_extent(spark, d):
    return layers.extents(fx.layer_features(spark, d))


def _shifted(spark, d):
    """Features whose coordinates are projected in some services."""
    far = F.col("item_id").isin("svc_4", "svc_9") & (F.col("feature_id") % 2 == 0)
    x = F.when(far, F.col("x") * 1000).otherwise(F.col("x"))
    return fx.layer_features(spark, d).withColumn("geometry", fx.point_geometry(x, F.col("y")))


@query
def layer_bounds_check(spark, d):
    return layers.bounds_check(_shifted(spark, d))


@query
def layer_diagnose(spark, d):
    return layers.diagnose(_shifted(spark, d))


@query
def layer_preview(spark, d):
    shown = layers.preview_features(fx.layer_features(spark, d), WHERE, limit=50)
    return layers.as_geojson(shown, ["feature_id", "class_value"])


@query
def layer_preview_one(spark, d):
    shown = layers.preview_features(fx.layer_features(spark, d), limit=300, layer=("svc_3", 1))
    return layers.as_geojson(shown, ["feature_id", "class_value"])


@query
def layer_preview_documents(spark, d):
    shown = layers.preview_features(fx.layer_features(spark, d), WHERE, limit=20)
    return layers.feature_collections(layers.as_geojson(shown, ["feature_id"]))


PART_BYTES = 4000


@query
def layer_preview_parts(spark, d):
    """Whole layers as documents of bounded size."""
    features = layers.as_geojson(fx.layer_features(spark, d), ["feature_id", "class_value"])
    return exports.feature_parts(features, scratch_folder(spark, "features"), PART_BYTES)


@query
def layer_preview_status(spark, d):
    return layers.preview_status(
        _shifted(spark, d), fx.service_layers(spark, d), _requests(spark, d), WHERE, limit=50
    )


def _preview_layers(spark, d, limit):
    features = fx.layer_features(spark, d)
    shown = layers.preview_features(features, limit=limit)
    documents = layers.feature_collections(layers.as_geojson(shown, ["feature_id"]))
    boxes = layers.extents(shown)
    return documents.join(boxes, layers.LAYER).select(
        "item_id",
        "layer_index",
        F.concat(F.lit("Layer of "), "item_id", F.lit(f" at {limit}")).alias("layer_name"),
        F.lit("Point").alias("geometry_type"),
        "geojson",
        "xmin",
        "ymin",
        "xmax",
        "ymax",
    )


@query
def preview_refresh(spark, d):
    fetched = _preview_layers(spark, d, 30).withColumn("ok", ~F.col("item_id").endswith("7"))
    for c in ("xmin", "ymin", "xmax", "ymax"):
        fetched = fetched.withColumn(c, F.when(~F.col("item_id").endswith("5"), F.col(c)))
    return layers.refresh_previews(_preview_layers(spark, d, 10), fetched)


@query
def class_style_lookup(spark, d):
    styled = symbology.style_features(
        fx.layer_features(spark, d), fx.layer_renderers(spark, d), {"color": "black"}
    )
    return styled.select("feature_id", "item_id", "layer_index", *symbology.STYLE)


@query
def class_style_composite(spark, d):
    """Classes that two or three attributes name together."""
    styled = symbology.style_features(fx.layer_features(spark, d), fx.composite_renderers(spark, d), {"color": "black"})
    return styled.select("feature_id", "item_id", "layer_index", *symbology.STYLE)


@query
def style_diversity(spark, d):
    styled = symbology.style_features(
        fx.layer_features(spark, d), fx.layer_renderers(spark, d), {"color": "black"}
    )
    return symbology.style_diversity(styled)


# --- text --------------------------------------------------------------------------------------


@query
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query
def html_to_text_hostile(spark, d):
    """Whole pages followed by a script that holds a comment mark, and by markup that never ends."""
    k = F.col("page_id") % 4
    tail = F.when(k == 0, F.lit("<script>var x = 1;")).when(k == 1, F.lit(" tail <!-- hidden"))
    tail = tail.when(k == 2, F.lit(' tail <a href="x')).otherwise(F.lit(" tail <style"))
    middle = F.lit("<script>s = '<!--'</script> seen <!-- <b> --> after <i title=\"a > b\">x</i>")
    page = F.concat("html", middle, tail)
    return table(spark, d, "pages").select("page_id", X.html_to_text(page).alias("text"))


@query
def layer_ref_parse(spark, d):
    parsed = fx.layer_references(spark, d).select(
        "ref_no", X.parse_layer_ref(F.col("reference")).alias("ref")
    )
    return parsed.select(
        "ref_no",
        "ref.kind",
        "ref.url",
        X.lookup_id(F.col("ref.item_id")).alias("item_id"),
        "ref.layer_index",
        X.target_class(F.col("ref")).alias("target_class"),
    )


@query
def text_ref_extract(spark, d):
    return fx.user_messages(spark, d).select(
        "conv_id", "turn", X.reference_in_text(F.col("text")).alias("reference")
    )


@query
def message_intent(spark, d):
    return fx.user_messages(spark, d).select(
        "conv_id",
        "turn",
        X.wants_preview(F.col("text")).alias("wants_preview"),
        X.wants_count(F.col("text")).alias("wants_count"),
    )
