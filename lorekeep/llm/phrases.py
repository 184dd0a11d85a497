"""Phrases whose words come together more often than their parts would: SETM over sorted occurrence relations.

SETM mines by relations alone: the occurrences of groups of k words are a relation sorted by piece and position; a merge join
with the occurrences of single words at the adjacent position gives those of k + 1 words; a group count finds the frequent
groups, and a semi-join keeps their occurrences before the next length.

The relations are persisted in slices: a row holds the occurrences of one language in about SLICE bytes of text. As pieces lie
in one slice, their order is the slice's: place i of an array stands for the i-th position, each piece ends with an empty
place, and a value is the slice's code of the group that begins there (0: none). So the merge join of two relations on
(piece, position + k) is an aligned shift of two arrays. What meets in shuffles are the distinct groups of a slice with their
counts, packed by hash bucket. A bucket's task adds them up, gives the frequent ones ids, and hands the ids back to the slices,
which is the semi-join. Buckets number with the occurrences, so each holds a bounded share. A group of k + 1 words is named by
the id of its first k words and the id of the last word.

Scores (exact decimals) and the comparison with longer phrases are joins of the tables of frequent groups by id; the words
themselves are looked up for the phrases that may be among the top ones.

Defined cases: a null text is empty, a null language ``und``; texts are bytes, A-Z become a-z; repeated rows count each; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.storage import staged
from lorekeep.llm.worker import slices, trim

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SLICE = 8 << 20
PER_BUCKET = 1_000_000  # occurrences, of which each bucket's groups are at most a fair share
SCALE = 1_000_000

# Bytes between pieces, and between words of a piece.
BETWEEN_PIECES = np.zeros(256, dtype=bool)
BETWEEN_PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN_WORDS = BETWEEN_PIECES.copy()
BETWEEN_WORDS[[0x20, 0x09]] = True

WORDS = "slice bigint, lang string, n bigint, places binary, words array<string>, counts binary"
GROUPS = "slice bigint, places binary, ids binary, groups binary, prev binary, last binary, counts binary"
DEALT = "bucket int, slice bigint, lang string, codes binary, words array<string>, prev binary, last binary, counts binary"
SETTLED = "slice bigint, lang string, codes binary, ids binary, words array<string>, prev binary, last binary, counts binary"
FREQUENT = "id bigint, lang string, word string, prev bigint, last bigint, count bigint"


def occurrences(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(codes by place, 0 where a piece ends; the word of each code less one) of the words of some texts."""
    b = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    gap = BETWEEN_WORDS[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    # The words without what stands between them are the data of a string array.
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(b[~gap].tobytes())])
    coded = words.dictionary_encode()
    breaks = np.cumsum(BETWEEN_PIECES[b], dtype=np.int32)[start]  # marks before each word
    ends = np.concatenate([[0], np.cumsum(np.diff(breaks) > 0)]) if len(start) else np.zeros(0, dtype=np.int64)
    places = np.zeros(len(start) + (int(ends[-1]) if len(ends) else 0), dtype="<u4")
    places[np.arange(len(start)) + ends] = coded.indices.to_numpy() + 1
    return places, coded.dictionary.cast(pa.large_string()).cast(pa.string())


def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of single words, a row per slice and language."""
    task, made = TaskContext.get().partitionId(), 0
    held: dict[str, list[str]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang, texts in held.items():
            places, words = occurrences(texts)
            if len(words):
                counts = np.bincount(places, minlength=len(words) + 1)[1:].astype("<u4")
                listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                arrays = [pa.array([v]) for v in (task << 32 | made, lang, int(counts.sum()), packed(places))]
                yield pa.RecordBatch.from_arrays([*arrays, listed, pa.array([packed(counts)])], ["slice", "lang", "n", "places", "words", "counts"])
                made += 1

    for batch in slices(batches, 1):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= SLICE:
            yield from rows()
            held, size = {}, 0
            trim()
    yield from rows()
    held.clear()
    trim()


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [[]] * len(names)
    made = [lists_of(c) if k == "array<string>" else pa.array(c, types[k]) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(made, list(names))


def lists_of(column: Sequence[pa.Array | None]) -> pa.Array:
    """Lists of words from one array per row."""
    some = [words for words in column if words is not None]
    if not some:
        return pa.nulls(len(column), pa.list_(pa.string()))
    ends = np.cumsum([0, *[0 if words is None else len(words) for words in column]])
    empty = np.array([words is None for words in column] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=empty), pa.concat_arrays(some))


def packed(values: np.ndarray) -> bytes:
    """An array as it travels and is stored: its size in bytes, then its compressed bytes. Codes, ids and counts shrink to a
    fraction, and rows of several MB would be most of an executor's memory."""
    data = np.ascontiguousarray(values)
    return data.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(data), codec="zstd", asbytes=True)


def numbers(data: bytes, kind: str = "<i8") -> np.ndarray:
    """What :func:`packed` was given."""
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd", asbytes=True), dtype=kind)


def in_buckets(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its members) of those that have some."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def deal_words(buckets: int) -> Callable:
    """The distinct words of a slice with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lang, words, counts in zip(*(batch.column(c) for c in ("slice", "lang", "words", "counts"))):
                words, counts = words.values, numbers(counts.as_py(), "<u4")
                bucket = np.fromiter((crc32(w.encode()) for w in words.to_pylist()), dtype=np.int64, count=len(words)) % buckets
                rows = [
                    (b, number.as_py(), lang.as_py(), packed((at + 1).astype("<u4")), words.take(pa.array(at)), None, None, packed(counts[at]))
                    for b, at in in_buckets(bucket, buckets)
                ]
                yield batch_of(rows, DEALT)
        trim()

    return run


def deal_groups(buckets: int) -> Callable:
    """The distinct groups of a slice with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, prev, last, counts in zip(*(batch.column(c) for c in ("slice", "prev", "last", "counts"))):
                prev, last, counts = numbers(prev.as_py()), numbers(last.as_py()), numbers(counts.as_py(), "<u4")
                mixed = prev.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
                bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
                rows = [
                    (b, number.as_py(), None, packed((at + 1).astype("<u4")), None, packed(prev[at]), packed(last[at]), packed(counts[at]))
                    for b, at in in_buckets(bucket, buckets)
                ]
                yield batch_of(rows, DEALT)
        trim()

    return run


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows with the same bucket and language, which follow each other."""
    key, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            now = row["bucket"].as_py(), row["lang"].as_py()
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def settle(minimum: int) -> Callable:
    """Per bucket: the groups with at least ``minimum`` occurrences, numbered; and for each slice the codes of its groups
    among them with these numbers. Rows come sorted by bucket, language and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used = None, 0
        for (bucket, lang), held in groups_of(batches):
            if bucket != current:
                current, used = bucket, 0
            counts = np.concatenate([numbers(r["counts"].as_py(), "<u4") for r in held]).astype(np.int64)
            if held[0]["words"].is_valid:
                every = pa.concat_arrays([r["words"].values for r in held]).dictionary_encode()
                group, first, columns = every.indices.to_numpy(), None, None
            else:
                prev, last = (np.concatenate([numbers(r[c].as_py()) for r in held]) for c in ("prev", "last"))
                order = np.lexsort((last, prev))
                fresh = np.concatenate([[True], (np.diff(prev[order]) != 0) | (np.diff(last[order]) != 0)])
                group = np.empty(len(order), dtype=np.int64)
                group[order] = np.cumsum(fresh) - 1
                first = order[fresh]
            total = np.zeros(int(group.max()) + 1, dtype=np.int64)
            np.add.at(total, group, counts)
            frequent = np.flatnonzero(total >= minimum)
            ids = np.zeros(len(total), dtype=np.int64)
            ids[frequent] = (bucket << 32) + used + 1 + np.arange(len(frequent))
            used += len(frequent)
            if not len(frequent):
                continue
            if first is None:
                columns = (every.dictionary.take(pa.array(frequent)), None, None)
            else:
                columns = (None, packed(prev[first[frequent]]), packed(last[first[frequent]]))
            yield batch_of([(None, lang, None, packed(ids[frequent]), *columns, packed(total[frequent]))], SETTLED)
            rows, at = [], 0
            for r in held:
                codes = numbers(r["codes"].as_py(), "<u4")
                own = ids[group[at : at + len(codes)]]
                at += len(codes)
                if own.any():
                    rows.append((r["slice"].as_py(), None, packed(codes[own > 0]), packed(own[own > 0]), None, None, None, None))
            yield batch_of(rows, SETTLED)
        trim()

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frequent groups, a row each."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            ids = numbers(row["ids"].as_py())
            pair = [pa.array(numbers(row[c].as_py())) if row[c].is_valid else pa.nulls(len(ids), pa.int64()) for c in ("prev", "last")]
            word = row["words"].values if row["words"].is_valid else pa.nulls(len(ids), pa.string())
            arrays = [pa.array(ids), pa.array([row["lang"].as_py()] * len(ids), pa.string()), word, *pair, pa.array(numbers(row["counts"].as_py()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "lang", "word", "prev", "last", "count"])


def lookup(found: pa.ListScalar, codes: int) -> np.ndarray:
    """Ids by code from what a slice got back; 0 for all others."""
    table = np.zeros(codes + 1, dtype=np.int64)
    for part in found.values:
        table[numbers(part["codes"].as_py(), "<u4")] = numbers(part["ids"].as_py())
    return table


def extend(words: int, persist: bool) -> Callable:
    """Merge join of the frequent groups of ``words`` words with the frequent words behind them, and the group counts of a slice.
    Where ``words`` is 1, the groups are the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                places = numbers(row["places"].as_py(), "<u4")
                if words == 1:
                    ids = lookup(row["found"], int(places.max()))
                    word = groups = ids[places]
                else:
                    ids, coded = numbers(row["ids"].as_py()), numbers(row["groups"].as_py(), "<u4")
                    word, groups = ids[places], lookup(row["found"], int(coded.max(initial=0)))[coded]
                at = np.flatnonzero((groups[:-words] > 0) & (word[words:] > 0)) if len(places) > words else np.zeros(0, dtype=np.int64)
                first, first_code = np.unique(groups[at], return_inverse=True)
                last, last_code = np.unique(word[at + words], return_inverse=True)
                joined, code, counts = np.unique(first_code * (len(last) + 1) + last_code, return_inverse=True, return_counts=True)
                new = np.zeros(len(places) if persist else 0, dtype="<u4")
                if persist:
                    new[at] = code + 1
                prev, after = first[joined // (len(last) + 1)], last[joined % (len(last) + 1)]
                kept = (packed(places), packed(ids), packed(new)) if persist else (None, None, None)
                yield batch_of([(row["slice"].as_py(), *kept, packed(prev), packed(after), packed(counts.astype("<u4")))], GROUPS)
                trim()

    return run


def settled(dealt: DataFrame, buckets: int, minimum: int) -> tuple[DataFrame, DataFrame]:
    """The frequent groups (id, lang, word, prev, last, count), and what each slice gets back (slice, found). Each bucket
    is a task."""
    rows = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang", "slice").mapInArrow(settle(minimum), SETTLED)
    rows = staged(rows, "settled")
    frequent = rows.where("slice IS NULL").select("lang", "ids", "words", "prev", "last", "counts").mapInArrow(unpack, FREQUENT)
    found = rows.where("slice IS NOT NULL").groupBy("slice").agg(F.collect_list(F.struct("codes", "ids")).alias("found"))
    return staged(frequent, "groups"), found


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in exact decimals; at most SCALE, as no part is rarer than the phrase."""
    big = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(SCALE).cast("decimal(7,0)"), big(left) * big(right))


def next_level(groups: DataFrame, before: DataFrame, of_words: bool) -> DataFrame:
    """Groups (id, prev, last, count) of one word more than those of ``before``, joined with what these know: the words, the group
    of all words but the first (``tail``), and the counts of all beginnings (``heads``) and ends (``tails``), shortest first."""
    head = before.select(
        F.col("id").alias("prev"), "lang", F.col("words").alias("head_words"), F.col("tail").alias("head_tail"),
        F.array_append("heads", F.col("count")).alias("heads"),
    )
    tail = before.select(
        F.col("id").alias("tail"), F.col("prev").alias("head_tail"), F.col("last"), F.array_append("tails", F.col("count")).alias("tails")
    )
    joined = groups.select("id", "prev", "last", "count").join(head, "prev")
    if of_words:  # the tail of a pair is its second word
        joined = joined.join(tail.drop("head_tail").withColumn("last", F.col("tail")), "last")
    else:
        joined = joined.join(tail, ["head_tail", "last"])
    words = F.array_append("head_words", F.col("last")).alias("words")
    return staged(joined.select("id", "lang", words, "count", "prev", "last", "tail", "heads", "tails"), "phrases")


def scored_phrases(phrases: DataFrame, words: int) -> DataFrame:
    """(id, lang, words, a, l, r, score) by the cut with the lowest score, the first of equal ones."""
    ways = []
    for cut in range(1, words):
        left, right = F.col("heads")[cut - 1], F.col("tails")[words - cut - 1]
        ways.append(F.struct(score(F.col("count"), left, right).alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))
    way = F.array_min(F.array(*ways)).alias("way")
    return phrases.select("id", "lang", "words", F.col("count").alias("a"), way).select("id", "lang", "words", "a", "way.l", "way.r", "way.score")


def without_parts(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """Without the phrases that stand in one of ``longer``, of one word more, for half of their occurrences or more. Phrases
    longer still are no more frequent than those between, so they need no look."""
    most = longer.select(F.explode(F.array("prev", "tail")).alias("id"), "count").groupBy("id").agg(F.max("count").alias("most"))
    return scored.join(most, "id", "left").where("most IS NULL OR 100 * most < 50 * a").drop("most")


def named(chosen: DataFrame, words: DataFrame) -> DataFrame:
    """``phrase`` for the ids in ``words``. Ids are unique among phrases of one length."""
    key = ["lang", "id", "length"]
    chosen = chosen.withColumn("length", F.size("words"))
    parts = chosen.select(*key, F.posexplode("words").alias("place", "word_id")).join(words.select(F.col("id").alias("word_id"), "word"), "word_id")
    parts = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("parts"))
    return chosen.drop("words").join(parts.select(*key, F.array_join("parts.word", " ").alias("phrase")), key)


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", minimum: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``max_words`` words of each language by score."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    relation = staged(rows.mapInArrow(read_words, WORDS), "occurrences")
    totals = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    buckets = 1 + (relation.agg(F.sum("n")).first()[0] or 0) // PER_BUCKET
    words, found = settled(relation.select("slice", "lang", "words", "counts").mapInArrow(deal_words(buckets), DEALT), buckets, minimum)
    relation = relation.select("slice", "places").join(found, "slice")

    none = F.array().cast("array<bigint>")
    level = words.select("id", "lang", F.array("id").alias("words"), "count", F.lit(None).cast("bigint").alias("prev"), F.col("id").alias("last"), F.lit(None).cast("bigint").alias("tail"), none.alias("heads"), none.alias("tails"))
    every, scored = None, None
    for k in range(1, max_words):
        persist = k + 1 < max_words
        relation = staged(relation.mapInArrow(extend(k, persist), GROUPS), "occurrences")
        groups, found = settled(relation.select("slice", "prev", "last", "counts").mapInArrow(deal_groups(buckets), DEALT), buckets, minimum)
        if persist:
            relation = relation.select("slice", "places", "ids", "groups").join(found, "slice")
        level = next_level(groups, level, k == 1)
        if scored is not None:
            scored = without_parts(scored, level)
            every = scored if every is None else every.unionByName(scored)
        scored = scored_phrases(level, k + 1)
    every = scored if every is None else every.unionByName(scored)
    # Names are needed for ties only: first all phrases that may be among the top ones, then their order.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    chosen = staged(every.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "chosen")
    ranking = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named(chosen, words).withColumn("rank", F.row_number().over(ranking).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
