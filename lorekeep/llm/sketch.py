"""A bit map of hashed ids, of bounded size: it only spares work, what passes it is joined exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_MAX = 1 << 27


def sketch(rows: DataFrame, column: str, n: int) -> tuple[np.ndarray, int]:
    """(the bits, packed into bytes, and their number) of about ``n`` values of ``column``; value v sets bit
    ``pmod(xxhash64(v), bits)``."""
    bits = 1 << min(BITS_MAX.bit_length() - 1, max(16, (16 * n).bit_length()))
    slots = rows.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("slot"))
    masks = F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(masks).toArrow()
    packed = np.zeros(bits // 64, dtype="<i8")
    packed[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return packed.view(np.uint8), bits


def holds(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bits of ``slots`` are set."""
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
