"""Physical plans: what reaches the scan, what is shuffled, and how hot keys are treated."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import history as HI
from lorekeep.operators import layers as L
from lorekeep.operators import normalize as N
from lorekeep.operators import watchlist as W
from lorekeep.operators.rows import first_rows, left_join_fanout
from lorekeep.registry.queries import QUERIES
from lorekeep.schemas import ITEMS_HISTORY
from lorekeep.sources import exports
from lorekeep.sources.footers import row_count
from lorekeep.sources.warehouse import Warehouse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_in_the_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_issue_list_reads_few_columns_and_does_not_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = QUERIES["stale_items"](spark, sf_dir)
        assert exchanges(df) == 0
        (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", plan(df))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert set(re.findall(r"(\w+):", schema)) == {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"}


def test_plain_column_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = [("a", "o", dt.datetime(2020, 1, 1), None), ("b", "o", dt.datetime(2024, 1, 1), 2)]
    spark.createDataFrame(rows, "item_id STRING, owner STRING, modified_at TIMESTAMP_NTZ, tags_count INT").write.parquet(path)
    from lorekeep.functions import predicates as P

    text = plan(spark.read.parquet(path).filter(P.stale("2024-06-01 00:00:00")))
    assert "LessThan(modified_at,2022-06-01" in text


def test_run_scope_reads_one_directory(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    for n in range(3):
        at = dt.datetime(2024, 1, 1 + n)
        rows = spark.range(5).selectExpr(
            "cast(id as string) item_id", "1 score", "'{}' breakdown_json", "'[]' missing_json", "timestamp_ntz'2024-01-01' computed_at", "'x' run_id"
        )
        w.open_run(f"r{n}", at)
        w.write_children("quality_scores", f"r{n}", rows)
        w.publish(f"r{n}", at, at, ["quality_scores"], w.touched(rows))
    one = w.quality_scores("r1")
    assert one.count() == 5 and w.quality_scores().count() == 15
    assert {re.search(r"run_id=(\w+)", f)[1] for f in one.inputFiles()} == {"r1"}
    assert w.quality_scores("r9").isEmpty()


def test_open_versions_skip_closed_files(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path), buckets=4)
    at = dt.datetime(2024, 1, 1)
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("item_id"), (F.col("id") % 2 == 0).alias("is_current"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in ITEMS_HISTORY if f.name not in ("item_id", "is_current")],
    )
    w.open_run("r0", at)
    w.write_bucketed("items_history", "r0", rows, "is_current")
    w.publish("r0", at, at, ["items_history"], w.touched(rows))
    assert {f.split("is_current=")[1].split("/")[0] for f in w.open_versions().inputFiles()} == {"true"}
    assert (w.open_versions().count(), w.closed_versions().count()) == (20, 20)
    assert w.items_history().count() == 40


def test_joins_of_buckets_shuffle_nothing(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["remediation_base"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text


def test_totals_are_counted_from_footers(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).write.parquet(path)
    counted = row_count(spark, path, path)
    assert "PushedAggregation: [COUNT(*)]" in plan(counted) and counted.first().n == 2000
    assert row_count(spark).first().n == 0
    assert "PushedAggregation: [COUNT(*)]" in plan(QUERIES["snapshot_summary"](spark, sf_dir))
    assert "PushedAggregation" not in plan(spark.read.parquet(path).agg(F.count("*")))  # others read as before


@pytest.mark.parametrize("limit", [400, 2000])
def test_feature_parts(spark, tmp_path, limit):
    """Every feature once, in order, no document above the limit unless of one feature; a hot layer in several parts."""
    size = F.when(F.col("id") % 97 == 0, 1500).otherwise(F.col("id") % 50)
    rows = spark.range(600).select(
        F.when(F.col("id") < 500, "hot").otherwise(F.concat(F.lit("x"), F.col("id") % 3)).alias("item_id"), F.lit("layer").alias("layer_kind"),
        F.lit(0).alias("layer_index"), F.col("id").alias("feature_id"), F.concat(F.lit('{"a":"'), F.repeat(F.lit("é"), size.cast("int")), F.lit('"}')).alias("feature"),
    )
    found = exports.feature_parts(rows.repartition(5), str(tmp_path / "sorted"), limit).collect()
    features = [(r.item_id, f) for r in found for f in json.loads(r.geojson)["features"]]
    assert sorted(map(str, features)) == sorted(str((r.item_id, json.loads(r.feature))) for r in rows.collect())
    assert all(len(r.geojson.encode()) <= limit or r.n_features == 1 for r in found)
    assert sum(r.item_id == "hot" for r in found) > 5 and len({(r.item_id, r.first_feature) for r in found}) == len(found)


def test_owner_summary_is_one_partial_aggregate_and_a_top_k(spark, sf_dir):
    df = QUERIES["owner_summary"](spark, sf_dir)
    assert exchanges(df) == 1
    assert "TakeOrderedAndProject" in plan(df) and "partial_count" in plan(df)


def test_remediation_base_shuffles_items_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["remediation_base"](spark, sf_dir)
        # items, scores, health aggregate and health join key: no second shuffle of the items
        assert exchanges(df) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_rows_are_cut_before_the_shuffle(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    df = spark.range(1000).select(key, "id")
    text = plan(first_rows(df, ["k"], 5, ["id"]))
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert "Final" in limits[0] and "Partial" in limits[-1]
    below = text.index(limits[-1])
    assert text.index("Exchange hashpartitioning") < below  # plans read from the top: cut, then shuffle
    hot = first_rows(df, ["k"], 3, ["id"]).filter("k = 'hot'").orderBy("id").collect()
    assert [r.id for r in hot] == [0, 3, 6]
    many = spark.range(9000).select(key, "id")
    kept = first_rows(many, ["k"], 2000, ["id"], rank_column="place").filter("k = 'hot'")
    assert kept.agg(F.count("*"), F.max("id"), F.max("place")).first()[:] == (2000, 5997, 2000)


def test_styles_do_not_shuffle_the_features(spark, sf_dir):
    assert exchanges(QUERIES["class_style_lookup"](spark, sf_dir)) == 1  # of the styles, per class


def test_bounds_check_and_preview_use_the_group_limit(spark):
    features = spark.range(5000).select(
        (F.col("id") % 2).cast("string").alias("item_id"), F.lit("layer").alias("layer_kind"), F.lit(0).alias("layer_index"),
        F.col("id").alias("feature_id"), F.lit(None).cast("string").alias("geometry"),
    )
    assert "WindowGroupLimit" in plan(L.bounds_check(features))
    assert "WindowGroupLimit" in plan(L.preview_features(features))


def test_fanout_join_splits_a_hot_right_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 5000, 1, 4).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
        right = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 4000).cast("string")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"),
        )
        joined = left_join_fanout(left, right, "k")
        rows = joined.agg(F.count("*"), F.count("v"), F.count_if(F.col("v").isNull())).first()
        plain = left.join(right, "k", "left").agg(F.count("*"), F.count("v"), F.count_if(F.col("v").isNull())).first()
        assert tuple(rows) == tuple(plain)
        joined.write.format("noop").mode("overwrite").save()
        executed = left.join(right, "k")
        executed.collect()
        assert "skew=true" in plan(executed)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_hot_watchlist_item_is_reduced_before_the_shuffle(spark):
    log = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("seq"), F.when(F.col("id") == 100, F.lit("remove")).otherwise(F.lit("save")).alias("action"),
        F.when(F.col("id") < 9999, F.lit("hot")).otherwise(F.lit("cold")).alias("item_id"),
        *[F.lit("x").alias(c) for c in ("item_url", "title", "item_type", "owner")],
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("source_query"), F.lit(None).cast("timestamp_ntz").alias("added_at"),
        F.lit(None).cast("string").alias("notes"),
    )
    df = W.replay(log.withColumn("seq", F.col("seq") * 1_000_000_000))
    assert df.first().source_query == "q101"
    text = plan(df)
    assert "Window" not in text and "partial_max" in text and "partial_min_by" in text


def test_change_report_with_limit_does_not_shuffle_the_history(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [(str(n), f"r{n % 3}", "c") for n in range(300)]
    spark.createDataFrame(rows, "item_id STRING, first_seen_run_id STRING, content STRING").write.parquet(path)
    df = HI.changes_of_run(spark.read.parquet(path), "r1", limit=20)
    assert df.count() == 20
    assert "BroadcastHashJoin" in plan(df) and "LeftSemi" in plan(df)


def test_raw_json_is_parsed_once_per_use(spark, sf_dir):
    text = plan(QUERIES["normalize_items"](spark, sf_dir)).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"parseJson|parse_json", text)) == 1


def test_closed_versions_meet_no_join(spark, tmp_path):
    path = str(tmp_path / "h")
    old = spark.createDataFrame(
        [(str(n), "h", dt.datetime(2024, 1, 1), None, n % 2 == 0, "c", "r0", "r0") for n in range(20)],
        "item_id STRING, content_hash STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, "
        "content STRING, first_seen_run_id STRING, last_seen_run_id STRING",
    )
    old.write.parquet(path)
    batch = spark.createDataFrame([("0", "h", "c"), ("1", "h", "c"), ("x", "y", "c")], "item_id STRING, content_hash STRING, content STRING")
    df = HI.apply_batch(spark.read.parquet(path), batch, "r1", "2024-02-01 00:00:00", ["content"])
    text = plan(df)
    assert text.count("FullOuter") == 1 and "Union" in text and "EqualTo(is_current,true)" in text
    assert df.count() == 22 and df.filter("is_current").count() == 12


def test_capped_scan_takes_the_last_version(spark):
    rows = spark.range(40, numPartitions=4).selectExpr("'a' AS item_id", "id AS seq", "'public' AS access", "'t' AS item_type")
    assert N.scan_items(rows, max_items=1, last_wins=("seq",)).first().seq == 39


def test_repeated_requests_and_shared_urls_stay_one_row_each(spark):
    counts = spark.createDataFrame(
        [("a", "layer", 0, "x", 5, None), ("a", "layer", 1, "y", 7, None), ("https://h/z/FeatureServer", "layer", 0, "z", 3, None)],
        "item_id STRING, layer_kind STRING, layer_index INT, layer_name STRING, row_count BIGINT, error STRING",
    )
    items = spark.createDataFrame([("a", "https://h/a/FeatureServer"), ("b", "https://h/a/FeatureServer")], "item_id STRING, url STRING")
    asked = ["a", "a", "https://h/a/FeatureServer/1", "https://h/z/FeatureServer"]
    targets = L.resolve_targets(spark.createDataFrame([(r,) for r in asked], "reference STRING"), items)
    got = sorted((r.reference, r.ok, r.layers_counted, r.total_count) for r in L.requested_counts(counts, targets).collect())
    assert got == [("a", True, 2, 12), ("a", True, 2, 12), ("https://h/a/FeatureServer/1", True, 1, 7), ("https://h/z/FeatureServer", True, 1, 3)]
    assert L.requested_details(counts, targets).count() == 2 + 1 + 1
