"""How sources of one language differ in their words: an Arrow compute pipeline with merged columnar shards.

1. Within ``mapInArrow`` texts are lower-cased (``ascii_lower``), split at everything that is no term
   (``split_pattern_regex``), their terms dictionary-encoded and counted by hash ``group_by``: occurrences and documents
   per language, source and term. A task merges its slices and sends each partial count once.
2. Partial counts are merged per language, source and term; a term stays if enough documents of its language have it.
3. Kept counts of a language are dealt to shards by a hash of the term; sources to blocks of BLOCK. A shard of two blocks
   is a table of bounded size; it becomes a matrix of terms by sources, whose smoothed shares give the differences of all
   pairs of its sources, and per source the terms it uses more than its language. Sums of shards are the result.

Shares are integers: p = 1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)), N the occurrences of kept terms, V
their number. A quotient is taken in three steps of three digits, exact while N + 5 V stays below 9e15. Terms that neither
of two sources has differ by the same amount, so a pair's sum is V times that, corrected by the terms one of them has.

Defined cases: a null text, language or source is ''; a group without terms has all pairs; V = 0 gives pairs of value 0 and
no terms; repeated rows count each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.storage import staged
from lorekeep.llm.worker import slices

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SCALE, SMOOTHING = 1_000_000_000, 5
BLOCK = 256  # sources compared at once
SHARD_ROWS = 100_000
SLICE_BYTES = 8 << 20
HELD_ROWS = 1_000_000  # partial counts a task merges before it sends them
MATRIX = 4_000_000  # cells of a matrix at a time

# What separates terms, after A-Z became a-z.
OUTSIDE = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

PARTIAL = "lang string, term string, sources array<string>, counts array<bigint>, documents bigint"
FOUND = "lang string, source string, part string, item string, value bigint"


def count_slice(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, documents) of one slice; a null term with zeros for each group that occurs."""
    langs, sources, texts = (c.cast(pa.string()) for c in batch.columns)
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), OUTSIDE)
    doc, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(term, "")
    doc, term = doc.filter(real), term.filter(real).dictionary_encode()
    per_document = pa.table({"doc": doc, "term": term.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), len(source.dictionary)), source.indices.cast(pa.int64()))
    # The groups themselves come in as rows without a term.
    columns = {
        "group": pa.chunked_array([pc.take(group, per_document["doc"]).combine_chunks(), group]),
        "term": pa.chunked_array([*per_document["term"].chunks, pa.nulls(len(group), pa.int32())]),
        "n": pa.chunked_array([*per_document["count_all"].chunks, pa.array(np.zeros(len(group), dtype=np.int64))]),
    }
    counted = pa.table(columns).group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    of_lang, of_source = np.divmod(counted["group"].to_numpy(), max(1, len(source.dictionary)))
    documents = pc.if_else(pc.is_null(counted["term"]), 0, counted["n_count"])
    arrays = [lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)), term.dictionary.take(counted["term"].combine_chunks())]
    return pa.table([*arrays, counted["n_sum"], documents], ["lang", "source", "term", "n", "documents"])


def merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("documents", "sum")])
    return summed.rename_columns(["lang", "source", "term", "n", "documents"])


def by_term(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row per language and term, with the sources that have it."""
    listed = table.group_by(["lang", "term"], use_threads=False).aggregate([("source", "list"), ("n", "list"), ("documents", "sum")])
    yield from listed.rename_columns(["lang", "term", "sources", "counts", "documents"]).to_batches(max_chunksize=20_000)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in slices(batches, 2, SLICE_BYTES):
        held.append(count_slice(batch))
        if sum(map(len, held)) > HELD_ROWS:
            held = [merged(held)]
            if len(held[0]) > HELD_ROWS // 2:
                yield from by_term(held[0])
                held = []
    if held:
        yield from by_term(merged(held))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in 64 bits; count is at most total."""
    quotient, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + digits
    return quotient + 1


def diverge(top: int):
    """The part of the result that one shard of two blocks of sources gives."""

    def run(table: pa.Table) -> pa.Table:
        head = pc.is_valid(table["source"])
        heads, rows = table.filter(head).sort_by("place"), table.filter(pc.invert(head))
        lang, terms = heads["lang"][0].as_py(), heads["n_terms"][0].as_py()
        base = heads["shard"][0].as_py() == 0
        first, second = heads["one"][0].as_py(), heads["two"][0].as_py()
        places, names = heads["place"].to_numpy(), heads["source"].combine_chunks()
        total = np.maximum(heads["total"].to_numpy() + SMOOTHING * terms, 1)
        in_lang = max(heads["lang_total"][0].as_py() + SMOOTHING * terms, 1)
        none = share(np.full(len(places), SMOOTHING, dtype=np.int64), total) if terms else np.ones(len(places), dtype=np.int64)

        words = rows["term"].combine_chunks().dictionary_encode()
        word, at = words.indices.to_numpy(), np.searchsorted(places, rows["place"].to_numpy())
        n, n_lang = rows["n"].to_numpy(), rows["n_lang"].to_numpy()
        order = np.argsort(word, kind="stable")
        word, at, n, n_lang = word[order], at[order], n[order], n_lang[order]

        left = np.flatnonzero(places // BLOCK == first)
        right = np.flatnonzero(places // BLOCK == second)
        between = np.abs(none[left][:, None] - none[right][None])
        value = between * (terms if base else 0)
        step = max(1, MATRIX // max(1, len(places)))
        for k in range(0, len(words.dictionary), step):
            a, b = np.searchsorted(word, [k, k + step])
            counts = np.zeros((min(step, len(words.dictionary) - k), len(places)), dtype=np.int64)
            counts[word[a:b] - k, at[a:b]] = n[a:b]
            p = share(counts + SMOOTHING, total[None])
            for i, s in enumerate(left):
                value[i] += np.abs(p[:, s][:, None] - p[:, right]).sum(axis=0) - between[i] * len(p)
        one, two = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
        flat, apart = value.ravel(), one != two
        if first != second:  # both directions
            one, two, flat, apart = np.concatenate([one, two]), np.concatenate([two, one]), np.tile(flat, 2), np.tile(apart, 2)
        found = [(names.take(pa.array(one[apart])), "pair", names.take(pa.array(two[apart])), flat[apart])]

        if first == second and len(word):
            above = share(n + SMOOTHING, total[at]) - share(n_lang + SMOOTHING, np.int64(in_lang))
            place_of = np.empty(len(words.dictionary), dtype=np.int64)  # UTF-8 order of the terms
            place_of[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(place_of))
            some = np.flatnonzero((n > 0) & (above > 0))
            some = some[np.lexsort((place_of[word[some]], -above[some], at[some]))]
            begin = np.searchsorted(at[some], at[some])
            some = some[np.arange(len(some)) - begin < top]
            found.append((names.take(pa.array(at[some])), "term", words.dictionary.take(pa.array(word[some])), above[some]))
        same = lambda v, m: pa.array([v] * m, pa.string())
        return pa.concat_tables(
            pa.table({"lang": same(lang, len(v)), "source": s, "part": same(part, len(v)), "item": item, "value": pa.array(v, pa.int64())})
            for s, part, item, v in found
        )

    return run


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    minimum: int = MIN_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): per source the distance to each other source of its language (part ``pair``)
    and the ``top`` terms it uses more than its language does (part ``term``)."""
    plain = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    rows = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    # One exchange by language and term serves the counts of languages, which come first, and those of sources.
    term = Window.partitionBy("lang", "term")
    parts = rows.mapInArrow(partial_counts, PARTIAL).repartition("lang", "term")
    parts = parts.withColumn("in_documents", F.sum("documents").over(term)).where(f"term IS NULL OR in_documents >= {minimum}")
    counts = parts.select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    counts = counts.withColumns({"n_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = staged(counts, "terms")

    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count("term").alias("rows"), F.sum(F.expr("cast(first and term is not null as bigint)")).alias("terms")
    )
    lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "total", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"),
        F.sum("terms").over(lang).alias("n_terms"), F.sum("total").over(lang).alias("lang_total"),
        F.expr(f"1 + sum(rows) over (partition by lang) div {SHARD_ROWS}").alias("shards"),
        F.expr(f"1 + (count(*) over (partition by lang) - 1) div {BLOCK}").alias("blocks"),
    )
    groups = staged(groups, "groups")

    def blocks(frame: DataFrame) -> DataFrame:
        """Rows once per pair of blocks that their source's block is part of."""
        other = frame.withColumn("other", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")))
        own = f"cast(place div {BLOCK} as int)"
        return other.withColumns({"one": F.expr(f"least({own}, other)"), "two": F.expr(f"greatest({own}, other)")})

    heads = blocks(groups.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)"))))
    heads = heads.selectExpr("lang", "one", "two", "shard", "place", "source", "total", "n_terms", "lang_total", "cast(null as string) as term", "0L as n", "0L as n_lang")
    counted = kept.where("term IS NOT NULL").select("lang", "source", "term", "n", "n_lang").join(groups, ["lang", "source"])
    counted = blocks(counted).selectExpr(
        "lang", "one", "two", "pmod(xxhash64(term), shards) as shard", "place", "cast(null as string) as source",
        "total", "n_terms", "lang_total", "term", "n", "n_lang",
    )
    found = heads.unionByName(counted).groupBy("lang", "one", "two", "shard").applyInArrow(diverge(top), FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(f"part = 'pair' OR rank <= {top}")
