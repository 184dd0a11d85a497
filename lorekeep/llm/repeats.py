"""Repeated passages by a common-prefix interval tree over an enhanced suffix array.

``intervals`` is the method: suffixes of a set of byte strings are sorted, the common prefixes of neighbours
computed, and a stack scan lists the intervals of suffixes that share at least ``minimum`` bytes; those whose
occurrences differ in the byte before (or start a string) are maximal and are returned with all occurrences.

``find`` applies it to a corpus in pieces that tasks can hold:

1. Every window of ``minimum`` bytes has a key, the least hash of its GRAM-byte substrings; equal windows have equal
   keys. Documents with equal texts are one class, which takes part once.
2. The keys of all classes are counted in hash buckets. What is met twice within a task is settled there and handed on
   once, so a frequent key is not hot. Only windows whose key occurs elsewhere can be repeated.
3. Runs of such windows with one key are cut out as segments. Equal segments are one segment class with a count.
4. Segment classes of one key meet in one task, many keys together under one suffix array. A key with more than
   KEY_LIMIT different segments (a passage in very many documents has as many different edges) is not brought to one
   task: its windows are compared one by one under 128-bit hashes, an aggregate that splits like any other.
5. Covered stretches go back to the segments' documents, and from there to all copies.

Matches never cross documents. Texts are UTF-8 bytes; a null text counts as empty. A text that has a copy is
covered wholly if it holds ``minimum`` bytes. Shorter texts, empty tables and null ids need no special case;
equal rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.ngram_join import MANY
from lorekeep.llm.ordering import order_key
from lorekeep.llm.shingles import BACK, BASE, LETTER, mixed, powers
from lorekeep.llm.sketch import holds, sketch
from lorekeep.llm.storage import staged
from lorekeep.llm.worker import slices

MINIMUM = 200
GRAM = 64
RUN_STARTS = 248
KEY_LIMIT = 1000
CHUNK_BYTES = 1_000_000
PER_BUCKET = 2_000_000  # keys
HANDED_BYTES = 16 << 20  # texts whose keys a task settles at once
U = np.uint64


# --- the enhanced suffix array -------------------------------------------------------------------


def intervals(strings: list[bytes], minimum: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Maximal repeat groups [(length, places)], the flags of covered places, and where each string begins.

    Places count through the strings with one separator behind each.
    """
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    size = int((lengths + 1).sum())
    symbol = np.zeros(size, dtype=np.int64)
    left = np.arange(size) - np.repeat(begin, lengths + 1)  # bytes before, in the string
    rest = np.repeat(lengths, lengths + 1) - left
    symbol[rest > 0] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
    start = np.flatnonzero(rest >= minimum)
    covered = np.zeros(size, dtype=bool)
    if len(start) < 2:
        return [], covered, begin

    ranks = rank_levels(symbol, int(lengths.max()))
    order = start[np.argsort(ranks[-1][1][start], kind="stable")]
    one, two = order[:-1], order[1:]
    common = np.minimum(common_prefix(symbol, ranks, one, two), np.minimum(rest[one], rest[two]))
    diverse = (left[one] == 0) | (left[two] == 0) | (symbol[one - 1] != symbol[two - 1])

    long = common >= minimum
    turns = np.concatenate([[0], np.cumsum(diverse & long)])  # turns[b] - turns[a]: changes of the byte before within a..b
    edge = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
    longest, groups = np.zeros(len(order), dtype=np.int64), []
    for first, last in zip(edge[::2], edge[1::2]):
        if turns[last] > turns[first]:
            for length, a, b in stack_scan(common[first:last].tolist(), int(first)):
                if turns[b] > turns[a]:
                    groups.append((length, order[a : b + 1]))
                    np.maximum(longest[a : b + 1], length, out=longest[a : b + 1])
    found = longest > 0
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, order[found], 1)
    np.add.at(step, order[found] + longest[found], -1)
    return groups, np.cumsum(step)[:-1] > 0, begin


def rank_levels(symbol: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the prefixes of 7, 14, 28, ... symbols, up to the longest string."""
    padded = np.concatenate([symbol, np.zeros(7, dtype=np.int64)])
    packed = np.zeros(len(symbol), dtype=np.int64)
    for k in range(7):
        packed = packed << 9 | padded[k : k + len(symbol)]
    levels, width = [(7, dense(packed))], 7
    while width < longest:
        rank = levels[-1][1].astype(np.int64)
        onward = np.zeros_like(rank)
        onward[:-width] = rank[width:] + 1 if width < len(rank) else 0
        width *= 2
        levels.append((width, dense(rank * (len(rank) + 2) + onward)))
    return levels


def dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    rank = np.empty(len(values), dtype=np.int32)
    in_order = values[order]
    rank[order] = np.cumsum(np.concatenate([[0], (in_order[1:] != in_order[:-1]).astype(np.int32)]))
    return rank


def common_prefix(symbol: np.ndarray, ranks: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    size, length = len(symbol), np.zeros(len(one), dtype=np.int64)
    for width, rank in [*reversed(ranks), *[(1, symbol)] * 6]:
        a, b = one + length, two + length
        inside = np.maximum(a, b) < size
        same = inside & (rank[np.minimum(a, size - 1)] == rank[np.minimum(b, size - 1)])
        length += np.where(same, width, 0)
    return length


def stack_scan(common: list[int], first: int) -> Iterator[tuple[int, int, int]]:
    """(length, a, b) of every interval of suffixes a..b whose common prefix is exactly ``length``."""
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*common, 0]):
        a = k
        while stack and stack[-1][0] > length:
            height, a = stack.pop()
            yield height, first + a, first + k
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, a))


# --- keys of windows -----------------------------------------------------------------------------


def window_hashes(b: np.ndarray, width: int, back: int = BACK, base: int = BASE) -> np.ndarray:
    """Hash of b[i : i + width] for every i."""
    bits = max(12, int(len(b)).bit_length())
    sums = np.concatenate([np.zeros(1, U), np.cumsum(LETTER[b] * powers(base, bits)[: len(b)], dtype=U)])
    n = len(b) - width + 1
    return mixed((sums[width : width + n] - sums[:n]) * powers(back, bits)[:n] + U(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_keys(b: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every window of ``minimum`` bytes, hashes of all grams)."""
    gram = window_hashes(b, min(GRAM, minimum))
    return sliding_min(gram, minimum - min(GRAM, minimum) + 1), gram


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def owner_of(data: bytes) -> int:
    return int.from_bytes(sha256(data).digest()[:8], "big", signed=True)


def low_half(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(32)).astype(np.uint32)


PACKED = "bucket int, tokens binary, owners binary, names binary, settled binary"


def hand_out(buckets: int, minimum: int) -> Callable:
    """The keys of each class of a batch, packed by bucket; keys met twice in the batch are settled and sent once."""

    def packed(names: list[int], tokens: list[np.ndarray], counts: list[np.ndarray], turn: int) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(t) for t in tokens])
        token, count = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(token, kind="stable")
        token, owner, count = token[order], owner[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        members = np.diff(np.append(first, len(token)))
        many = np.add.reduceat(count, first) > 1
        shared = np.repeat(many, members)
        name = np.array(names, dtype="<i8")
        bucket = (token[first] % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            at = by[cuts[k] : cuts[k + 1]]
            used, local = np.unique(owner[first[at]], return_inverse=True)
            local = np.where(many[at], MANY, local.astype(np.uint32)).astype("<u4")
            rows.append((int(k), low_half(token[first[at]]).astype("<u4").tobytes(), local.tobytes(), name[used].tobytes(), None))
        if shared.any():
            rows.append((turn % buckets, low_half(token[shared]).astype("<u4").tobytes(), None, name[owner[shared]].tobytes(), b""))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "tokens", "owners", "names", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, HANDED_BYTES):
            names, tokens, counts, seen = [], [], [], set()
            for text in batch.columns[0].to_pylist():
                data = text_bytes(text)
                if len(data) < minimum or (name := owner_of(data)) in seen:
                    continue
                seen.add(name)
                keys, gram = window_keys(np.frombuffer(data, dtype=np.uint8), minimum)
                distinct = np.unique(keys)
                near = gram[gram <= distinct[-1]]
                at = np.searchsorted(distinct, near)
                counts.append(np.bincount(at[distinct[at] == near], minlength=len(distinct)))
                names.append(name)
                tokens.append(distinct)
            if names:
                yield packed(names, tokens, counts, names[0])

    return run


def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, token) of the keys that occur twice; rows come sorted by bucket."""
    current, held = None, []

    def result() -> pa.RecordBatch:
        done, tokens, names, many = [], [], [], []
        for low, local, name, settled in held:
            low, name = np.frombuffer(low, dtype="<u4"), np.frombuffer(name, dtype="<i8")
            if settled is not None:
                done.append((name, low))
                continue
            local = np.frombuffer(local, dtype="<u4")
            flags = local == MANY
            tokens.append(low)
            names.append(name[np.where(flags, 0, local)])
            many.append(flags)
        if tokens:
            token, name, flag = map(np.concatenate, (tokens, names, many))
            order = np.lexsort((name, token))
            token, name, flag = token[order], name[order], flag[order]
            change = np.concatenate([[True], token[1:] != token[:-1]])
            first = np.flatnonzero(change)
            fresh = change | np.concatenate([[True], name[1:] != name[:-1]])
            shared = (np.add.reduceat((fresh & ~flag).astype(np.int64), first) > 1) | (np.maximum.reduceat(flag.astype(np.int8), first) > 0)
            keep = np.repeat(shared, np.diff(np.append(first, len(token)))) & ~flag
            done.append((name[keep], token[keep]))
        owner, low = (np.concatenate(c) for c in zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(low.astype(np.int64))], ["owner", "token"])

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current and held:
                yield result()
                held = []
            current = bucket
            held.append(row)
    if held:
        yield result()


# --- segments ------------------------------------------------------------------------------------

SEGMENTS = "sha string, place bigint, key bigint, h1 bigint, h2 bigint, bytes binary"
COVERED = "h1 bigint, h2 bigint, spans array<struct<from:int,to:int>>"


def cut_segments(minimum: int) -> Callable:
    """Runs of windows with one repeated key, with the bytes they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for sha, text, tokens in zip(batch.columns[0].to_pylist(), batch.columns[1].to_pylist(), batch.columns[2]):
                data = text_bytes(text)
                if len(data) < minimum:
                    continue
                keys, _ = window_keys(np.frombuffer(data, dtype=np.uint8), minimum)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                last = np.append(first[1:], len(keys))
                wanted = np.isin(low_half(keys[first]).astype(np.int64), tokens.values.to_numpy())
                for a, b in zip(first[wanted].tolist(), last[wanted].tolist()):
                    key = int(keys[a].view(np.int64))
                    for at in range(a, b, RUN_STARTS):
                        piece = data[at : min(at + RUN_STARTS, b) + minimum - 1]
                        d = blake2b(piece, digest_size=16).digest()
                        rows.append((sha, at, key, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), piece))
                if len(rows) > 20_000:
                    yield segment_batch(rows)
                    rows = []
            if rows:
                yield segment_batch(rows)

    return run


def segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *[pa.int64()] * 4, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["sha", "place", "key", "h1", "h2", "bytes"])


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def scan_segments(minimum: int) -> Callable:
    """Covered stretches of segment classes; rows come sorted by key, many keys share a suffix array."""

    def result(held: list[tuple]) -> pa.RecordBatch:
        _, covered, begin = intervals([h[2] for h in held], minimum)
        rows = []
        for (h1, h2, data, n), at in zip(held, begin.tolist()):
            spans = [(0, len(data))] if n > 1 else spans_of(covered[at : at + len(data)])
            if spans:
                rows.append((h1, h2, [{"from": a, "to": b} for a, b in spans]))
        columns = list(zip(*rows)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["h1", "h2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, current = [], 0, None
        for batch in batches:
            for key, h1, h2, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current and chars > CHUNK_BYTES:
                    yield result(held)
                    held, chars = [], 0
                current = key
                held.append((h1, h2, data, n))
                chars += len(data)
        if held:
            yield result(held)

    return run


SECOND_BASE = 0xD1342543DE82EF95
SECOND_BACK = pow(SECOND_BASE, -1, 1 << 64)


def list_windows(minimum: int) -> Callable:
    """Every window of a segment class under a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, data, n = batch.columns
            for a, b, piece, times in zip(h1.to_pylist(), h2.to_pylist(), data.to_pylist(), n.to_pylist()):
                raw = np.frombuffer(piece, dtype=np.uint8)
                one, two = window_hashes(raw, minimum), window_hashes(raw, minimum, SECOND_BACK, SECOND_BASE)
                same = lambda v: pa.array(np.full(len(one), v, dtype=np.int64))
                arrays = [same(a), same(b), same(times), pa.array(np.arange(len(one), dtype=np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "n", "at", "w1", "w2"])

    return run


def cover(segments: DataFrame, minimum: int) -> DataFrame:
    """(h1, h2, spans) of the segment classes with covered bytes."""
    classes = segments.groupBy("h1", "h2").agg(F.first("key").alias("key"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    classes = staged(classes, "segments")
    # A key with one segment stays: its windows may repeat within it.
    known = classes.join(classes.groupBy("key").agg(F.count(F.lit(1)).alias("different")), "key")
    usual = known.where(f"different <= {KEY_LIMIT}").select("key", "h1", "h2", "bytes", "n")
    usual = usual.repartition("key").sortWithinPartitions("key").mapInArrow(scan_segments(minimum), COVERED)
    large = known.where(f"different > {KEY_LIMIT}").select("h1", "h2", "bytes", "n")
    windows = large.mapInArrow(list_windows(minimum), "h1 bigint, h2 bigint, n bigint, at int, w1 bigint, w2 bigint")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    hit = windows.join(twice, ["w1", "w2"]).select("h1", "h2", F.struct(F.col("at").alias("from"), (F.col("at") + minimum).alias("to")).alias("span"))
    return usual.unionByName(hit.groupBy("h1", "h2").agg(F.collect_list("span").alias("spans")))


def remove(minimum: int) -> Callable:
    """(sha, n_removed, n_spans, kept_sha256, kept) of texts from their covered stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for sha, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text_bytes(text)
                step = np.zeros(len(data) + 1, dtype=np.int64)
                for s in spans:
                    step[s["from"]] += 1
                    step[s["to"]] -= 1
                gone = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                rows.append((sha, int(gone.sum()), len(spans_of(gone)), sha256(kept).hexdigest(), kept))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", minimum: int = MINIMUM, with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row, and ``kept`` (the remaining bytes; null where the
    text is kept whole) if ``with_bytes``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), order_key(id_col).alias("node"), text.alias("text"))
    hashed = keyed.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    base = staged(hashed.select("id", "node", F.octet_length(F.col("text").cast("binary")).cast("long").alias("n_bytes"), "sha"), "texts")
    classes = base.groupBy("sha").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"))

    # A bucket is a task, so buckets number with the keys: about two per stretch of windows with one least gram.
    keys = 2 * (base.agg(F.sum("n_bytes")).first()[0] or 0) // max(1, minimum - min(GRAM, minimum) + 1)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + keys // PER_BUCKET)
    packed = keyed.select("text").mapInArrow(hand_out(buckets, minimum), PACKED)
    packed = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    owned = packed.mapInArrow(settle_buckets, "owner bigint, token bigint").groupBy("owner").agg(F.collect_set("token").alias("tokens"))
    owner = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    wanted = staged(classes.withColumn("owner", owner).join(owned, "owner").select("sha", "node", "tokens"), "wanted")

    flags, bits = sketch(wanted, "node", wanted.count())

    def pass_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["node", "sha", "text"]).filter(pa.array(holds(flags, batch.column("slot").to_numpy())))

    slotted = hashed.select("node", "sha", "text", F.pmod(F.xxhash64("node"), F.lit(bits)).alias("slot"))
    some = slotted.mapInArrow(pass_sketch, "node bigint, sha string, text string").join(wanted, ["sha", "node"])
    some = staged(some.select("sha", "text", "tokens").dropDuplicates(["sha"]), "candidates")

    segments = staged(some.mapInArrow(cut_segments(minimum), SEGMENTS), "runs")
    spans = segments.select("sha", "place", "h1", "h2").join(cover(segments, minimum), ["h1", "h2"])
    spans = spans.select("sha", F.explode(F.transform("spans", lambda s: F.struct((F.col("place") + s["from"]).alias("from"), (F.col("place") + s["to"]).alias("to")))).alias("span"))
    spans = spans.groupBy("sha").agg(F.collect_list("span").alias("spans"))
    removed = some.select("sha", "text").join(spans, "sha").mapInArrow(
        remove(minimum), "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    per_class = classes.select("sha", "copies").join(removed, "sha", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= minimum)
    nothing = F.sha2(F.lit(b""), 256)
    return base.join(per_class, "sha").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
    )
