"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces of at most capacity // j ids, and a bin of the
class takes exactly j of them. A document longer than the capacity gives whole bins first. What is left is cut
so that pieces nearly fill their class: it goes to the narrowest class that holds it if at most 1/32 of that
place stays empty, else a piece of the widest class that it fills is cut off and the rest is looked at again.

Workers fill bins on their own: each task closes a class's bin at its j-th piece. Bins that are still open at a
task's end are merged, 64 tasks at a time, by the same rule until one set is left: less than one bin per class,
so bounded by the number of classes. Its ids are joined and cut at the capacity, and the last part at powers of
two. Sequences are padded to the capacity, those whose length is a power of two not at all.

Defined cases: null and empty texts have the end id alone; repeated rows are packed each; an empty table gives
no pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.storage import staged
from lorekeep.llm.token_files import crc
from lorekeep.llm.tokens import encoder
from lorekeep.llm.worker import kept, slices

CAPACITY = 2048
EMPTY_SHARE = 32
FAN_IN = 64
PIECES = "worker bigint, bin bigint, place int, size int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, ids binary"
NAMES = [f.split()[0] for f in PIECES.split(", ")]
TYPES = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in PIECES.split(", ")]


def places(capacity: int) -> tuple[int, ...]:
    """The widths of the classes, ascending."""
    known = kept("places")
    if capacity not in known:
        known[capacity] = tuple(sorted({capacity // j for j in range(1, capacity + 1)}))
    return known[capacity]


def cut(length: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(length, class width) of the pieces of a sequence of at most ``capacity`` ids; a worker remembers them by length."""
    known = kept("cuts")
    if (length, capacity) not in known:
        known[length, capacity] = cut_anew(length, places(capacity))
    return known[length, capacity]


def cut_anew(length: int, widths: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    out = []
    while length:
        holds = next(w for w in widths if w >= length)
        if (holds - length) * EMPTY_SHARE <= holds:
            return (*out, (length, holds))
        fills = max(w for w in widths if w <= length)
        out.append((fills, fills))
        length -= fills
    return tuple(out)


class Bins:
    """The open bins of one worker."""

    def __init__(self, worker: int, capacity: int, with_ids: bool):
        self.worker, self.capacity, self.with_ids = worker, capacity, with_ids
        self.open: dict[int, list] = {}
        self.closed: list[tuple] = []
        self.bins = 0

    def add(self, size: int, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        held = self.open.setdefault(size, [])
        held.append((doc_id, start, ids, doc_tokens))
        if len(held) == self.capacity // size:
            offset = 0
            for doc_id, start, ids, doc_tokens in held:
                kept = ids.astype("<u4").tobytes() if self.with_ids else None
                self.closed.append((self.worker, self.bins, None, size, doc_id, start, len(ids), crc(ids), doc_tokens, offset, kept))
                offset += len(ids)
            self.bins += 1
            held.clear()

    def add_document(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for k in range(0, len(ids), self.capacity):
            for n, size in cut(min(self.capacity, len(ids) - k), self.capacity):
                self.add(size, doc_id, start, ids[start : start + n], len(ids))
                start += n

    def rest(self) -> list[tuple]:
        return [
            (self.worker, None, place, size, doc_id, start, len(ids), crc(ids), doc_tokens, None, ids.astype("<u4").tobytes())
            for size, held in self.open.items()
            for place, (doc_id, start, ids, doc_tokens) in enumerate(held)
        ]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def pack_texts(path: str, end_id: int, capacity: int, with_ids: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = encoder(path), Bins(TaskContext.get().partitionId(), capacity, with_ids)
        end = np.array([end_id], dtype=np.uint32)
        for batch in slices(batches, 1):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                bins.add_document(doc_id, np.concatenate([ids_of.ids(text), end]))
                if len(bins.closed) >= 10_000:
                    yield as_batch(bins.closed)
                    bins.closed.clear()
        yield as_batch(bins.closed)
        yield as_batch(bins.rest())

    return pack


def merge_bins(capacity: int, with_ids: bool) -> Callable:
    """Open bins of FAN_IN workers, rows sorted by the new worker's number: a stream of groups."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = None
        for batch in batches:
            for worker, size, doc_id, start, ids, doc_tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if bins is None or bins.worker != worker:
                    if bins is not None:
                        yield as_batch(bins.closed + bins.rest())
                    bins = Bins(worker, capacity, with_ids)
                bins.add(size, doc_id, start, np.frombuffer(ids, dtype="<u4"), doc_tokens)
                if len(bins.closed) >= 10_000:
                    yield as_batch(bins.closed)
                    bins.closed.clear()
        if bins is not None:
            yield as_batch(bins.closed + bins.rest())

    return merge


def join_last(capacity: int, with_ids: bool) -> Callable:
    """The last open bins, joined and cut: whole sequences, then powers of two."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        left = sum(len(ids) for *_, ids in pieces) // 4
        sizes = [capacity] * (left // capacity)
        left %= capacity
        while left:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        rows, at, offset = [], 0, 0
        for doc_id, start, doc_tokens, ids in pieces:
            ids = np.frombuffer(ids, dtype="<u4")
            while len(ids):
                n = min(len(ids), sizes[at] - offset)
                kept = ids[:n].tobytes() if with_ids else None
                rows.append((0, at, None, sizes[at], doc_id, start, n, crc(ids[:n]), doc_tokens, offset, kept))
                ids, start, offset = ids[n:], start + n, offset + n
                if offset == sizes[at]:
                    at, offset = at + 1, 0
        yield as_batch(rows)

    return join


def numbered(closed: DataFrame, base: int) -> tuple[DataFrame, int]:
    """sequence_id for closed bins: offsets of workers by running sums over a table with a row per worker."""
    per_worker = closed.groupBy("worker").agg((F.max("bin") + 1).alias("bins"))
    before = Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_worker.withColumn("base", F.coalesce(F.sum("bins").over(before), F.lit(0)) + base)
    total = per_worker.agg(F.sum("bins").alias("n")).first()["n"] or 0
    joined = closed.join(offsets.select("worker", "base"), "worker").withColumn("sequence_id", F.col("base") + F.col("bin"))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "size", "ids"), base + total


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, size (width of the piece's class)
    and ``ids`` (little-endian 32-bit, null unless ``with_ids``). ``docs`` has doc_id and text."""
    pieces = staged(docs.select("doc_id", "text").mapInArrow(pack_texts(tokenizer, end_id, capacity, with_ids), PIECES), "packed")
    found, base = numbered(pieces.where("bin IS NOT NULL"), 0)
    results, left = [found], pieces.where("bin IS NULL")
    workers = (left.agg(F.max("worker").alias("w")).first()["w"] or 0) + 1
    while True:
        group = F.expr(f"worker div {FAN_IN}").alias("worker")
        ordered = left.select(group, "size", "doc_id", "start", "ids", "doc_tokens", F.col("worker").alias("was"), "place")
        ordered = ordered.repartition("worker").sortWithinPartitions("worker", "size", "was", "place")
        merged = staged(ordered.select("worker", "size", "doc_id", "start", "ids", "doc_tokens").mapInArrow(merge_bins(capacity, with_ids), PIECES), "merged")
        found, base = numbered(merged.where("bin IS NOT NULL"), base)
        results.append(found)
        left, workers = merged.where("bin IS NULL"), -(-workers // FAN_IN)
        if workers <= 1:
            break
    last = left.select("size", "doc_id", "start", "doc_tokens", "ids", "place").coalesce(1).sortWithinPartitions(F.desc("size"), "place", "doc_id", "start")
    found, _ = numbered(staged(last.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(join_last(capacity, with_ids), PIECES), "last"), base)
    out = results[0]
    for more in [*results[1:], found]:
        out = out.unionByName(more)
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids): the sequences themselves, from pieces packed ``with_ids``; at most capacity ids each."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.unhex(F.array_join("rows.ids", "")).alias("ids")
    )
