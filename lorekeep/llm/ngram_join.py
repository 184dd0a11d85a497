"""N-gram Jaccard join by prefix trees, and the groups its links form.

Documents with equal shingle sets are one class; classes are joined. Sets have one global order, rarest shingles
first. For a link (Jaccard at least 0.75) the first ``n - ceil(0.75 n) + l`` shingles of both sets share at least l
of them, in any global order. So:

1. Under the order of the hashes, each class hands these first shingles to hash buckets, and learns how many of them
   another class also has. Shingles met twice within a task are settled there and handed on once, so a frequent
   one is no hot key. Classes with too few shared ones have no link. (Buckets compare 32 bits: an accident only
   keeps a class.)
2. The rest, mostly true near copies, get the frequencies of all their shingles among them. Shingles nobody shares
   come first in the order and can't match, so they are only counted.
3. Classes that share a shingle of their prefix may be linked; connected components of "may" are the units of work.
   A unit goes to tasks in blocks of bounded size, each with a few common pivots.
4. Within a block the ordered sets form a trie with compressed paths. Each set walks it, sharing the overlap counted
   on common paths, and leaves a subtree when the shingles that remain cannot reach the overlap a link needs.
5. If the blocks of a unit fall into several groups, the members outside its largest group are also compared with all
   blocks. Members of one group need no further comparison: links inside a group change nothing.

Returned per row: id, n_shingles, component_id (smallest id reachable by links). Pairs are never listed.

Defined cases: null texts and texts without words have 0 shingles and link with nothing, not even each other; a
null id sorts before all others and names no document, so rows with it are joined by their texts only; rows of one id
but different texts keep their own n_shingles, are linked each by its own text, and share one component; equal rows are
linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import components
from lorekeep.llm.ordering import LEAST, order_key
from lorekeep.llm.shingles import shingles
from lorekeep.llm.sketch import holds, sketch
from lorekeep.llm.storage import staged
from lorekeep.llm.worker import forget, slices

SIZE = 5
BLOCK, PIVOTS = 128, 8
MANY = np.uint32(0xFFFFFFFF)
PER_BUCKET = 2_000_000  # shingles
HANDED_BYTES = 16 << 20  # texts whose shingles a task settles at once
SEEN = 100_000  # sets a task remembers as handed on
SETS = "doc bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint"
PACKED = "bucket int, tokens binary, owners binary, keys binary, credits binary"


def required(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(0.75 n): shingles of a set that a linked one has too."""
    return -(-3 * n // 4)


def prefix(n: int) -> int:
    return n - required(n) + max(1, n // 8)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    d = blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget("encoders")
    for batch in slices(batches, 2):
        docs, hashes, texts = batch.columns
        rows = [(len(s), *set_key(s)) for s in map(shingles, texts.to_pylist())]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([docs, hashes, *[pa.array(c, pa.int64()) for c in columns]], ["doc", "text_hash", "n", "h1", "h2"])


def hand_out(buckets: int) -> Callable:
    """The first shingles of each class of a batch, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, HANDED_BYTES):
            keys, parts = {}, []
            for text in batch.columns[0].to_pylist():
                s = shingles(text)
                if len(s) and (key := set_key(s)[0]) not in keys:
                    keys[key] = len(keys)
                    parts.append(s[: prefix(len(s))])
            if not parts:
                continue
            owner = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
            token = np.concatenate(parts)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.diff(token, prepend=token[0] ^ np.uint64(1)))
            count = np.diff(np.append(first, len(token)))
            shared = np.repeat(count > 1, count)
            keys_of = np.fromiter(keys, dtype=np.int64, count=len(keys))
            credit = np.bincount(owner[shared], minlength=len(keys))
            some = np.flatnonzero(credit)
            bucket = (token[first] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                at = by[cuts[b] : cuts[b + 1]]
                one = owner[first[at]]
                used, local = np.unique(one, return_inverse=True)
                local = np.where(count[at] > 1, MANY, local.astype(np.uint32)).astype("<u4")
                low = (token[first[at]] >> np.uint64(32)).astype("<u4")
                rows.append((int(b), low.tobytes(), local.tobytes(), keys_of[used].tobytes(), None))
            if len(some):
                rows.append((int(keys_of[0] % buckets), None, None, keys_of[some].tobytes(), credit[some].astype("<i8").tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "tokens", "owners", "keys", "credits"])

    return run


def settle(group: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(class key, shared shingles) of one bucket."""
    tokens, owners, done = [], [], []
    for low, local, keys, credits in group:
        names = np.frombuffer(keys, dtype="<i8")
        if credits is not None:
            done.append((names, np.frombuffer(credits, dtype="<i8")))
            continue
        local = np.frombuffer(local, dtype="<u4")
        many = local == MANY
        tokens.append(np.frombuffer(low, dtype="<u4"))
        owners.append((np.where(many, 0, names[np.where(many, 0, local)]), many))
    if tokens:
        token, name, many = np.concatenate(tokens), np.concatenate([o for o, _ in owners]), np.concatenate([m for _, m in owners])
        order = np.lexsort((name, token))
        token, name, many = token[order], name[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])
        shared = (np.add.reduceat(fresh.astype(np.int64), first) > 1) | (np.maximum.reduceat(many.astype(np.int8), first) > 0)
        got = name[np.repeat(shared, count) & ~many]
        done.append((got, np.ones(len(got), dtype=np.int64)))
    names, inverse = np.unique(np.concatenate([n for n, _ in done]), return_inverse=True)
    return names, np.bincount(inverse, weights=np.concatenate([c for _, c in done])).astype(np.int64)


CREDITS = "slot int, names binary, credits binary"


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each value of the first column, which come one after the other."""
    current, held = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current and held:
                yield held
                held = []
            current = key
            held.append(row)
    if held:
        yield held


def settle_buckets(slots: int) -> Callable:
    """Shared shingles per class, packed by slots of the class key: a row per bucket and slot, not per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            names, credit = settle(held)
            slot = names % slots
            order = np.argsort(slot, kind="stable")
            cuts = np.searchsorted(slot[order], np.arange(slots + 1))
            rows = [
                (int(k), names[at].astype("<i8").tobytes(), credit[at].astype("<i4").tobytes())
                for k in np.flatnonzero(np.diff(cuts))
                for at in (order[cuts[k] : cuts[k + 1]],)
            ]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["slot", "names", "credits"])

    return run


def add_credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class key, shared shingles); rows come sorted by slot."""
    for held in by_bucket(batches):
        names, inverse = np.unique(np.concatenate([np.frombuffer(n, dtype="<i8") for n, _ in held]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, dtype="<i4") for _, c in held]))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total.astype(np.int64))], ["h1", "credit"])


def sets_of(packed: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, 1):
            docs, texts, slots = batch.columns
            rows = []
            for k in np.flatnonzero(holds(packed, slots.to_numpy())):
                s = shingles(texts[k].as_py())
                key = (docs[k].as_py(), *set_key(s))
                if len(s) and key not in seen:
                    rows.append((*key, s))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
            for k in range(0, len(rows), 500):
                doc, h1, h2, sets = zip(*rows[k : k + 500])
                lengths = np.cumsum([0, *[len(s) for s in sets]])
                tokens = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (doc, h1, h2)], tokens], ["doc", "h1", "h2", "tokens"])

    return run


class Trie:
    """Ordered sets as a trie with compressed paths; leaves carry (member, size of the whole set)."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.children: list[tuple[np.ndarray, Trie]] = []
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.build([sets[k] for k in order], [sizes[k] for k in order], order, 0)

    @classmethod
    def below(cls, sets, sizes, members, depth) -> Trie:
        node = cls.__new__(cls)
        node.children = []
        node.build(sets, sizes, members, depth)
        return node

    def build(self, sets, sizes, members, depth) -> None:
        self.here = [(m, n) for s, n, m in zip(sets, sizes, members) if len(s) == depth]
        self.least, self.most = min(sizes), max(sizes)
        self.longest = max(len(s) for s in sets) - depth  # shingles below this node
        k = len(self.here)
        while k < len(sets):
            end = k + 1
            while end < len(sets) and sets[end][depth] == sets[k][depth]:
                end += 1
            low, high = sets[k], sets[end - 1]
            n = min(len(low), len(high))
            differ = np.flatnonzero(low[depth:n] != high[depth:n])
            to = depth + int(differ[0]) if len(differ) else n
            self.children.append((low[depth:to], Trie.below(sets[k:end], sizes[k:end], members[k:end], to)))
            k = end

    def links(self, own: np.ndarray, has: np.ndarray, size: int) -> Iterator[int]:
        """Members linked with the set ``own`` (ranks ascending, ``has`` its flags, ``size`` its whole size)."""
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, seen = stack.pop()
            for member, n in node.here:
                if 7 * overlap >= 3 * (size + n):
                    yield member
            for path, child in node.children:
                if 4 * child.most < 3 * size or 3 * child.least > 4 * size:
                    continue
                both = overlap + int(has[path].sum())
                passed = int(np.searchsorted(own, path[-1], side="right"))
                best = both + min(len(own) - passed, child.longest)
                if 7 * best >= 3 * (size + max(child.least, -(-3 * size // 4))):
                    stack.append((child, both, passed))


def join_block(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the members that have a link within the block; members that are ``anchor`` only need to be compared with the others."""
    rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
    keys = np.concatenate([np.asarray(t, dtype=np.int64) for t in rows["tokens"]])
    counts = np.concatenate([np.asarray(t, dtype=np.int64) for t in rows["counts"]])
    # Global order: frequency, then hash. Ranks within the block keep it.
    order = np.lexsort((keys, counts))
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(fresh) - 1
    sets = np.split(rank, np.cumsum([len(t) for t in rows["tokens"]])[:-1])
    sets = [np.sort(s) for s in sets]
    sizes, trie = rows["n"].tolist(), Trie(sets, rows["n"].tolist())
    has = np.zeros(int(rank.max(initial=-1)) + 1, dtype=bool)
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    anchor = rows["anchor"].tolist()
    for k, own in enumerate(sets):
        if anchor[k]:
            continue
        has[own] = True
        for other in trie.links(own, has, sizes[k]):
            a, b = find(k), find(other)
            parent[max(a, b)] = min(a, b)
        has[own] = False
    root = [find(k) for k in range(len(sets))]
    nodes = rows["node"].to_numpy()
    linked = [k for k, r in enumerate(root) if r != k]
    return pd.DataFrame({"node": nodes[linked], "root": nodes[[root[k] for k in linked]]})


def in_blocks(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links found in the blocks ``blocks`` (unit, block, node, anchor) of the sets in ``units``."""
    dealt = blocks.join(units.select("node", "n", "tokens", "counts"), "node")
    return dealt.groupBy("unit", "block").applyInPandas(join_block, "node bigint, root bigint")


def join_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with one of a smaller node. A class (node, doc, n, h1, h2) is one
    set; ``doc`` is one of the documents in ``docs`` (doc, text) that have it."""
    spark = docs.sparkSession
    # A bucket is a task, so buckets number with the shingles that are handed out.
    shingle_count = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + shingle_count * 3 // 8 // PER_BUCKET)
    packed = docs.select("text").mapInArrow(hand_out(buckets), PACKED)
    packed = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    settled = packed.mapInArrow(settle_buckets(max(1, buckets // 4)), CREDITS).repartition("slot").sortWithinPartitions("slot")
    credit = settled.mapInArrow(add_credits, "h1 bigint, credit bigint")
    enough = "credit >= greatest(1, ((3 * n + 3) div 4) div 8)"
    kept = staged(classes.join(credit, "h1").where(enough).select("node", "doc", "n", "h1", "h2"), "kept")

    flags, bits = sketch(kept, "doc", kept.count())
    slotted = docs.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("slot"))
    sets = slotted.mapInArrow(sets_of(flags), "doc bigint, h1 bigint, h2 bigint, tokens array<bigint>")
    # A row may stand several times, a set goes on once.
    sets = sets.join(kept, ["doc", "h1", "h2"]).dropDuplicates(["doc", "h1", "h2"])
    sets = staged(sets.select("node", "n", "tokens"), "sets")

    pairs = sets.select("node", F.explode("tokens").alias("token"))
    counts = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    ordered = pairs.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("set"))
    ordered = ordered.join(kept.select("node", "n"), "node")
    # Shingles nobody shares fill the first places of the prefix.
    ordered = ordered.withColumn("lead", F.expr("n - (3 * n + 3) div 4 + 1 - (n - size(set))")).where("lead > 0")
    units = staged(ordered.select("node", "n", "lead", F.col("set.token").alias("tokens"), F.col("set.count").alias("counts")), "ordered")

    lead = units.select("node", F.explode(F.slice("tokens", F.lit(1), F.col("lead").cast("int"))).alias("token"))
    least = lead.groupBy("token").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("count")).where("count > 1")
    may = components(lead.join(least, "token").select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b"))
    heads = may.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("unit"))
    member = staged(may.select("node", F.col("component").alias("unit")).unionByName(heads), "members")
    size = member.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))

    salted = member.join(size, "unit").withColumn("block", F.expr(f"pmod(xxhash64(node), (size + {BLOCK - 1}) div {BLOCK})"))
    alone = salted.select("unit", "block", "node", F.lit(False).alias("anchor"))
    large = size.where(f"size > {BLOCK}")
    # Pivots: the heads of a few ranges of hashes, the same for all blocks of a unit.
    pivots = salted.where(f"size > {BLOCK}").groupBy("unit", F.expr(f"pmod(xxhash64(node, 1), {PIVOTS})").alias("range")).agg(F.min("node").alias("node"))
    spread = large.select("unit", F.explode(F.expr(f"sequence(0L, (size + {BLOCK - 1}) div {BLOCK} - 1)")).alias("block"))
    shared = pivots.join(spread, "unit").select("unit", "block", "node", F.lit(True).alias("anchor"))
    found = staged(in_blocks(units, alone.unionByName(shared)), "links")

    if not large.isEmpty():
        group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = salted.where(f"size > {BLOCK}").join(group, "node", "left").select("unit", "node", "size", F.coalesce("component", "node").alias("label"))
        weight = named.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("members"))
        main = weight.groupBy("unit").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
        named = staged(named.join(main, "unit").withColumn("other", F.col("label") != F.col("main")), "labels")
        others = named.where("other").withColumn("part", F.expr(f"pmod(xxhash64(node), 1 + size div {BLOCK})"))
        pieces = others.groupBy("unit", "part").agg(F.first("size").alias("size"))
        # Each part of the outsiders meets every block of its unit.
        whole = named.select("unit", "node", F.expr(f"pmod(xxhash64(node), (size + {BLOCK - 1}) div {BLOCK})").alias("row"))
        name = "part * 1000000007 + row"
        right = whole.join(pieces.select("unit", "part"), "unit").selectExpr("unit", f"{name} as block", "node", "true as anchor")
        rows = pieces.select("unit", "part", F.explode(F.expr(f"sequence(0L, (size + {BLOCK - 1}) div {BLOCK} - 1)")).alias("row"))
        left = others.join(rows, ["unit", "part"]).selectExpr("unit", f"{name} as block", "node", "false as anchor")
        both = left.unionByName(right).groupBy("unit", "block", "node").agg(F.min("anchor").alias("anchor"))
        found = found.unionByName(staged(in_blocks(units, both), "links"))
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def set_groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, text_hash, n, h1, h2), and classes (n, h1, h2, doc, component) with the components of their sets alone."""
    keyed = docs.select(order_key(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    described = staged(keyed.mapInArrow(describe, SETS), "sets")
    classes = described.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("doc"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    linked = join_classes(classes, keyed)
    named = classes.join(linked, "node", "left").select("h1", "h2", "n", "doc", F.coalesce("component", "node").alias("component"))
    return described, staged(named, "named")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash) of the texts that are near copies of another: all but the one of the smallest id (and hash) of each
    group. ``doc`` is the id's order key, ``text_hash`` the text's xxhash64. Texts without words are none."""
    described, named = set_groups(docs, id_col, text_col)
    rows = described.where("n > 0").join(named.drop("doc"), ["h1", "h2", "n"]).select("component", "doc", "text_hash").distinct()
    first = rows.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("first"))
    return rows.join(first, "component").where("struct(doc, text_hash) <> first").select("doc", "text_hash").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    described, named = set_groups(docs, id_col, text_col)
    rows = described.where("n > 0").join(named.drop("doc"), ["h1", "h2", "n"]).select("doc", "n", "component")
    # An id may have texts of several groups, which then are one.
    spread = rows.where(F.col("doc") != LEAST).groupBy("doc").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    spread = staged(spread.select("doc", "low"), "spread")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    if not spread.isEmpty():
        edges = rows.join(spread, "doc").where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b")).distinct()
        joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        whole = least.join(joined, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
        smallest = whole.groupBy("whole").agg(F.min("least").alias("least"))
        least = whole.select("component", "whole").join(smallest, "whole").select("component", "least")
    of_set = named.join(least, "component").select("h1", "h2", "n", "least")
    real = lambda c: F.nullif(F.col(c), F.lit(LEAST).cast("long"))
    full = described.where("n > 0").join(of_set, ["h1", "h2", "n"]).select("doc", "n", "least")
    none = described.where("n = 0").select("doc", "n", F.col("doc").alias("least"))
    return full.unionByName(none).select(real("doc").alias(id_col), F.col("n").alias("n_shingles"), real("least").alias("component_id"))
