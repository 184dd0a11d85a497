"""The corpus tables, read with declared schemas through Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 8 << 20  # texts may be long: what goes to a Python worker at once is bounded by bytes

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH_BYTES, str(BATCH)) == str(BATCH):  # not set by the cluster
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
