"""Files for people: CSV lists and GeoJSON. Written by all tasks, in the order of the frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _plain(df: DataFrame) -> DataFrame:
    """Times as text, so that a fraction shows only when there is one."""
    times = [name for name, kind in df.dtypes if kind.startswith("timestamp")]
    return df.withColumns({name: F.col(name).cast("string") for name in times})


def write_csv(df: DataFrame, path: str, *partition_by: str) -> str:
    """A directory of CSV files, each with a header, also when there are no rows."""
    writer = _plain(df).write.mode("overwrite").partitionBy(*partition_by)
    writer.options(header=True, encoding="UTF-8", escape='"', emptyValue="").csv(path)
    return path


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)


def write_feature_lines(geojson: DataFrame, path: str) -> str:
    """One GeoJSON Feature per line, for feature sets of any size."""
    geojson.select("feature").write.mode("overwrite").text(path)
    return path


def feature_parts(geojson: DataFrame, folder: str, max_bytes: int) -> DataFrame:
    """FeatureCollection documents of layers of any size, none of more than ``max_bytes`` unless a single feature is.

    ``geojson`` has item_id, layer_kind, layer_index, feature_id and feature. Features follow each other by feature_id; a
    document is named by its first one. They are sorted across all tasks into ``folder`` first, so a hot layer lies in many
    ranges; where a range begins within its layer follows from one number per range and layer, so no task sees a whole layer.
    A feature of more than half the limit is a document of its own, all others are cut where the running sum of bytes passes a
    multiple of half the limit.
    """
    layer, frame = ["item_id", "layer_kind", "layer_index"], len('{"type":"FeatureCollection","features":[]}')
    half = (max_bytes - frame) // 2
    ordered = geojson.select(*layer, "feature_id", "feature").repartitionByRange(*layer, "feature_id").sortWithinPartitions(*layer, "feature_id")
    sized = ordered.withColumns({"range": F.spark_partition_id(), "bytes": (F.octet_length("feature") + 1).cast("bigint")})
    sized.write.mode("overwrite").parquet(folder)
    rows = geojson.sparkSession.read.schema(sized.schema).parquet(folder).withColumn("alone", F.col("bytes") > half)
    small = F.when(~F.col("alone"), F.col("bytes")).otherwise(F.lit(0))
    before = Window.partitionBy(*layer).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*layer, "range").agg(F.sum(small).alias("sum"))
    ranges = ranges.select(*layer, "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("begin"))
    upto = Window.partitionBy(*layer, "range").orderBy("feature_id", "feature").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(small).over(upto)).join(ranges, [*layer, "range"])
    cut = ends.withColumns({
        "part": F.when(~F.col("alone"), F.expr(f"(begin + end - 1) div {half}")),
        "single": F.when(F.col("alone"), F.struct("feature_id", "feature")),
    })
    listed = F.array_sort(F.collect_list(F.struct("feature_id", "feature")))
    body = F.array_join(F.transform("listed", lambda f: f["feature"]), ",")
    documents = cut.groupBy(*layer, "part", "single").agg(listed.alias("listed"))
    return documents.select(
        *layer,
        F.col("listed")[0]["feature_id"].alias("first_feature"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"),
        F.size("listed").alias("n_features"),
    )


def write_feature_collections(documents: DataFrame, path: str) -> str:
    """One FeatureCollection per layer, in a directory named after the layer."""
    columns = ["item_id", "layer_index", "geojson"]
    documents.select(*columns).write.mode("overwrite").partitionBy(*columns[:2]).text(path)
    return path
