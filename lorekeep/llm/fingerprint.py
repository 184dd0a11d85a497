"""Quartile bucket digests of documents.

Every window of five bytes of the UTF-8 text contributes byte triplets, each hashed to one of BUCKETS
counters. The digest states, in hex, the length on a logarithmic scale (2 digits), the ratios of the counters'
quartiles (2 digits) and for every counter the quartile it lies in (2 bits). Two digests are compared by a
difference score that is bounded: quartile steps cost 0, 1, 2 or 6, the header up to LENGTH_COST, and the
likeness is 1 minus the score over its bound BOUND, not below 0.

Equal texts have equal digests and likeness 1. Four zero bytes stand before every text, so short texts have
windows too; the empty text (and null, which counts as empty) has all counters zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.ordering import boundaries, order_key, range_number

BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
#: Places within the window, the newest byte first, and an odd multiplier for each triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
MULTIPLIERS = np.array([2 * k + 1 for k in (0x4F1BBCDC, 0x2545F491, 0x1B873593)], dtype=np.uint32)
STEP_COST = np.array([0, 1, 2, 6])
LENGTH_COST = 24
BOUND = 2 * BUCKETS + LENGTH_COST


def counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(bytes(4) + data, dtype=np.uint8).astype(np.uint32)
    n, total = len(data), np.zeros(BUCKETS, dtype=np.int64)
    at = [b[4 - k : 4 - k + n] for k in range(5)]
    for (i, j, k), m in zip(TRIPLETS, MULTIPLIERS):
        mixed = ((at[i] << np.uint32(16)) | (at[j] << np.uint32(8)) | at[k]) * m
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        total += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    c = counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((c > q1).astype(np.uint8) + (c > q2) + (c > q3)).astype(np.uint8).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, int(np.log2(len(data) + 1) * 8))
    ratios = (int(16 * q1 / max(q3, 1)) % 16) << 4 | int(16 * q2 / max(q3, 1)) % 16
    return bytes([length, ratios]).hex() + body.tobytes().hex()


def parts(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    body = raw[2:]
    codes = np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).ravel()
    return int(raw[0]), int(raw[1]) >> 4, int(raw[1]) & 15, codes.astype(np.int8)


def likeness(one: str, two: str) -> float:
    """1 minus the bounded difference score: 1 for equal digests, 0 for unrelated ones."""
    (n1, a1, b1, c1), (n2, a2, b2, c2) = parts(one), parts(two)
    steps = int(STEP_COST[np.abs(c1 - c2)].sum())
    around = lambda x, y: min((x - y) % 16, (y - x) % 16)
    header = min(LENGTH_COST, abs(n1 - n2) // 2 + around(a1, a2) + around(b1, b2))
    return max(0.0, 1.0 - (steps + header) / BOUND)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row's text."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return docs.select(F.col(id_col), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


SUCCESSIVE = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_successor(docs: DataFrame) -> DataFrame:
    """Each document against its text with the second half taken from the next one, and against the next one.

    ``docs`` has doc_id and text. The order is ascending doc_id, null ids first, rows of equal ids by their
    text; the first row follows the last. Texts are shuffled once, into ranges of ids; the first row of
    each range also goes to the range before. Within a range rows stream by, two at a time.
    """
    cuts = boundaries(docs, "doc_id", per_partition=4)
    rows = docs.select("doc_id", order_key("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", range_number(F.col("key"), cuts))
    firsts = {r["block"]: r["key"] for r in docs.select(order_key("doc_id").alias("key")).groupBy(range_number(F.col("key"), cuts).alias("block")).agg(F.min("key").alias("key")).collect()}
    filled = sorted(firsts)
    if not filled:
        return docs.sparkSession.createDataFrame([], SUCCESSIVE)
    before = {b: filled[k - 1] for k, b in enumerate(filled)}
    width = len(cuts) + 1
    as_array = lambda values, kind: F.lit([values.get(b, None if kind == "long" else -1) for b in range(width)]).cast(f"array<{kind}>")
    first = F.get(as_array(firsts, "long"), F.col("block"))
    homes = F.when(
        F.col("key") == first,
        F.array(F.struct("block", F.lit(0).alias("guest")), F.struct(F.get(as_array(before, "int"), F.col("block")).alias("block"), F.lit(1).alias("guest"))),
    ).otherwise(F.array(F.struct("block", F.lit(0).alias("guest"))))
    dealt = rows.select("doc_id", "key", "text", F.explode(homes).alias("at")).select("doc_id", "key", "text", "at.*")
    streams = dealt.repartition("block").sortWithinPartitions("block", "guest", "key", "text")
    return streams.select("doc_id", "text", "block", "guest").mapInArrow(compare_stream, SUCCESSIVE)


def compare_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (doc_id, text, digest) still without its successor

    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, block, guest in zip(*(c.to_pylist() for c in batch.columns)):
            mark = digest(text) if held is None or held[3] == block else None
            if held is not None and held[3] == block:
                out.append(compared(*held[:3], text, mark))
                held = None
            if not guest:
                held = (doc_id, text, mark or digest(text), block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 7, OUT_TYPES)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


OUT_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compared(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_mark = digest(edited)
    sha = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)
