"""From raw documents to packed token sequences: reject, deduplicate, redact, mix, pack.

Each stage takes all rows its predecessor kept and returns the columns it was given, the last one the pieces of
packed sequences. Between stages the rows are written to the cluster's shared folder and read back.

Null and empty texts are neither toxic nor copies and pass through; a null source is one source; an empty table
passes through all stages; extra columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import mixing, ngram_join, packing, pii, toxicity
from lorekeep.llm.ordering import order_key
from lorekeep.llm.queries import public_tokenizer
from lorekeep.llm.storage import staged
from lorekeep.llm.tables import free_name, table

TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC; labels are learned from the same four fifths as in op3."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    name = free_name(docs.columns, "toxicity")
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < TOXIC).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of the smallest id of each group of near duplicates; of rows with words that are equal in all columns one
    stays. Texts without words are in no group and all stay."""
    key, text_hash = (free_name(docs.columns, c) for c in ("gone_id", "gone_hash"))
    others = ngram_join.near_copies(docs).select(F.col("doc").alias(key), F.col("text_hash").alias(text_hash))
    others = staged(others, "copies")
    gone = (order_key("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(text_hash))
    return without_repeats(docs.join(others, gone, "left_anti"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One of the rows with words that are equal in all columns. They are found by 128 bits of hashes, without the texts; only
    texts of rows that do stand several times are shuffled."""
    h1, h2 = (free_name(docs.columns, c) for c in ("row_hash1", "row_hash2"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.array(*[c.isNull() for c in columns])
    keyed = docs.withColumns({h: F.xxhash64(F.lit(k), nulls, *columns) for k, h in enumerate((h1, h2))})
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeated = keyed.where(worded).groupBy(h1, h2).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(h1, h2)
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return docs
    once = keyed.join(repeated, [h1, h2], "left_anti")
    first = keyed.join(repeated, [h1, h2], "left_semi").dropDuplicates([h1, h2])
    return once.unionByName(first).select(*columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind, and n_chars of the new text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture: files and rows within them follow it."""
    return mixing.in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with the ids (little-endian 32-bit). Ranges of the mixture, as its files and
    rows hold it, are the packer's workers in turn, so sequence_id follows the mixture."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files: the order is made anew
        ordered = mixing.in_mixed_order(docs)
    else:
        place = (F.length("_file"), F.col("_file"), F.col("_row"))
        ordered = placed.repartitionByRange(*place).sortWithinPartitions(*place)
    return packing.pack(ordered.select("doc_id", "text"), public_tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Viterbi decoding and tokenizing are no SQL; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
