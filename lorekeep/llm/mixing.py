"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

The rows of a source, in an order shuffled by the hash of their id, form blocks of ``block_rows``. With w a source's
exact share of the weights, its k-th block is released at floor((k-1) / w) and due at ceil(k / w), counted over the
whole run. Each time slot takes, among the released blocks, the one due first; that never misses a due time. So as long
as a source has blocks left, the count it has received never differs from its weighted share by a whole block, however
long the run is and however small the weight.

The driver makes the schedule from the weights and one count per source: a step and a row of three numbers per block,
written to the shared storage SLOTS_AT_ONCE at a time, so its memory doesn't grow. Placing the data is a join with it.
When a source has no blocks left, its slots stay empty or go to blocks that are released already; the others go on in
their own proportions: no row is dropped or repeated.

Defined cases: null sources are one source; null ids sort first; equal rows are interchangeable; an empty
table gives an empty result; a source without a given weight is an error, as is a weight that is not positive.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.storage import new_folder

MIN_PERIOD = 1024
BUCKET_BITS = 12  # rows of a source are ranked in 4096 hash ranges, so a hot source is no single group
SLOTS_AT_ONCE = 250_000
SLOTS = "p_src string, nth bigint, slot bigint"


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers in exactly the same proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def shares(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Whole shares of the period, at least one each, by largest remainders."""
    parts = whole(weights)
    total, spare = sum(parts.values()), period - len(weights)
    exact = {s: Fraction(w, total) * spare for s, w in parts.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is not None, s or ""))
    for s in rest[: period - sum(out.values())]:
        out[s] += 1
    return out


def slots(weights: dict[str | None, float], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int]]:
    """(source, number of the block from 0, slot) of all blocks by slot: earliest deadline among the released."""
    parts = whole(weights)
    total = sum(parts.values())
    order = {s: i for i, s in enumerate(sorted(parts, key=lambda s: (s is not None, s or "")))}
    coming = [(0, order[s], 0, s) for s in parts if blocks.get(s)]  # the next block of each source that is not released
    heapq.heapify(coming)
    ready, t = [], 0
    while coming or ready:
        if not ready:
            t = max(t, coming[0][0])
        while coming and coming[0][0] <= t:
            _, i, k, s = coming[0]
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), i, k, s))
            if k + 1 < blocks[s]:
                heapq.heapreplace(coming, ((k + 1) * total // parts[s], i, k + 1, s))
            else:
                heapq.heappop(coming)
        _, _, k, s = heapq.heappop(ready)
        yield s, k, t
        t += 1


def schedule(quota: dict[str | None, int]) -> list[tuple[str | None, int]]:
    """(source, number of the block) for each slot of one period in which each source has its quota."""
    return [(s, k) for s, k, _ in slots(quota, quota)]


def planned(spark: SparkSession, weights: dict[str | None, float], blocks: dict[str | None, int]) -> DataFrame:
    """The slots as a table on the shared storage."""
    found, folder = slots(weights, blocks), new_folder(spark, "slots")
    kinds = {"p_src": pa.string(), "nth": pa.int64(), "slot": pa.int64()}
    while True:
        rows = list(islice(found, SLOTS_AT_ONCE))
        columns = list(zip(*rows)) or [[]] * 3
        part = pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})
        spark.createDataFrame(part, SLOTS).write.mode("append").parquet(folder, compression="zstd")
        if len(rows) < SLOTS_AT_ONCE:
            return spark.read.schema(SLOTS).parquet(folder)


def source_rows(rows: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    """Rows of each source; one number per source reaches the driver."""
    counts = rows.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return {r["source"]: r["n"] for r in counts.collect()}


def root_weights(counts: dict[str | None, int]) -> dict[str | None, float]:
    """Weights that grow with the square root of a source's rows."""
    return {s: float(n) ** 0.5 for s, n in counts.items()}


def ranked(rows: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(row, src, rank): rank from 0 within the source, in hash order; counts per hash range give the offsets."""
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.col(source_col).alias("src"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("mix")).alias("h"),
    ).withColumn("range", F.shiftright("h", 64 - BUCKET_BITS))
    counts = keyed.groupBy("src", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("src").alias("o_src"), F.col("range").alias("o_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("src", "range").orderBy("h", f"row.`{id_col}`")
    numbered = keyed.withColumn("nth", F.row_number().over(within))
    return numbered.join(offsets, F.expr("src <=> o_src AND range = o_range")).select(
        "row", "src", (F.col("base") + F.col("nth") - 1).alias("rank")
    )


PLACES = ("mix_block", "mix_slot", "mix_offset")


def placed(rows: DataFrame, weights: dict[str | None, float] | None, block_rows: int, id_col: str, source_col: str) -> DataFrame:
    """(row, mix_block, mix_slot, mix_offset)."""
    counts = source_rows(rows, source_col)
    weights = root_weights(counts) if weights is None else weights
    if lost := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for source {'null' if lost[0] is None else lost[0]}")
    plan = planned(rows.sparkSession, weights, {s: -(-n // block_rows) for s, n in counts.items()})
    known = ranked(rows, id_col, source_col).withColumn("mix_block", F.expr(f"rank div {block_rows}"))
    return known.join(plan, F.expr("src <=> p_src AND mix_block = nth")).select(
        "row", "mix_block", F.col("slot").alias("mix_slot"), F.expr(f"rank % {block_rows}").alias("mix_offset")
    )


def mix(
    rows: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``rows`` with mix_block (number within the source), mix_slot (the block's place) and mix_offset (in the block).

    Ordering by mix_slot, mix_offset gives the mixture. ``weights`` default to :func:`root_weights`. Columns of
    these three names are replaced.
    """
    rows = rows.drop(*PLACES)
    return placed(rows, weights, block_rows, id_col, source_col).select("row.*", *PLACES)


def in_mixed_order(
    rows: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``rows`` as they are, in the order of the mixture across and within partitions."""
    spread = placed(rows, weights, block_rows, id_col, source_col).repartitionByRange("mix_slot", "mix_offset")
    return spread.sortWithinPartitions("mix_slot", "mix_offset").select("row.*")
