"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import collisions, divergence, fingerprint, mixing, ngram_join, packing, phrases, pii, repeats, sharding, token_files, toxicity, vectors
from lorekeep.llm.oracle import ORACLE
from lorekeep.llm.storage import new_folder
from lorekeep.llm.tables import table

__all__ = ["ORACLE", "QUERIES"]

SHARDS = 40


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_successor(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op3_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores; a fifth of the rows, by checksum of the id, is never learned from."""
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by the ring with bounded loads; law: row counts at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard_rows(sized, SHARDS, tie_cols=("text_crc32", "size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


def op5_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(table(spark, sf_dir, "documents"))


def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as fixed-length sequences, and read back from the files."""
    folder = new_folder(spark, "sequences")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizer("word_bpe_49k.json"))
    return token_files.read_documents(spark, folder)


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of its source, weights by the square root of the source's rows."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(of, pii.BASE_KINDS),
        F.sha2(pii.joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json")).drop("ids")


def op11_arrow_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(table(spark, sf_dir, "embeddings"))


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quartile_digest": op1_quartile_digest,
    "op2_prefix_tree_join": op2_prefix_tree_join,
    "op3_noisy_channel": op3_noisy_channel,
    "op4_bounded_ring": op4_bounded_ring,
    "op5_spherical_cells": op5_spherical_cells,
    "op6_interval_tree": op6_interval_tree,
    "op7_arrow_sequences": op7_arrow_sequences,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_pii": op9_pii,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_arrow_divergence": op11_arrow_divergence,
    "op12_collision_counting": op12_collision_counting,
    "op13_setm_phrases": op13_setm_phrases,
}
