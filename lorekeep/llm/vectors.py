"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative kept.

1. Equal vectors are one class (smallest id, count). Only classes are compared.
2. Spherical k-means is fitted on at most SAMPLE_VALUES values of classes with the smallest hash of their id; k
   is one cell per CELL_ROWS classes, at most MAX_CELLS. Every class goes to its nearest centre.
3. Classes are shuffled once, by cell, into files of bounded size, the blocks. A task reads pairs of blocks from shared
   storage; no class is copied for the cells it is compared with, so the disk taken grows with the input alone.
4. A pair may be cut by the border of two cells. Vectors within cosine ``threshold`` of each other that lie on both
   sides of it are within sqrt(1 - threshold ** 2) of it, and their angles to a centre differ by their own angle at most.
   All vectors of one block that near are guests of the cells of the other, so no pair is missed, whatever the data look
   like; of two blocks the second sends its guests to the first, so a pair meets once.
   A finite ``deviations`` is for callers who want fewer guests and accept lost pairs.
5. A cell meets its guests in tiles of bounded size, its rows by their angle to the centre, as the outer ones reach further.
   A product of the leading principal axes and of the lengths of what is left, in single precision, is the most that the
   whole product can be; what comes near the threshold is compared whole, and what does so again in double precision. A
   pair of blocks returns per class its number of links there and the root of its component there, never the pairs.

Where the data have no clusters, as many dimensions have no narrow borders, every cell is near every other and the work
is that of all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; a
vector is only compared with those of its length (lengths other than the commonest are one cell each); a null id
sorts before all others; rows of one id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import components
from lorekeep.llm.ordering import LEAST, order_key
from lorekeep.llm.storage import new_folder, staged
from lorekeep.llm.token_files import location
from lorekeep.llm.worker import trim

THRESHOLD = 0.9
DEVIATIONS = math.inf
SAMPLE_VALUES = 2_000_000
CELL_ROWS = 1000
MAX_CELLS = 1024
OWN_BLOCK, ALL_BLOCK = 256, 512  # rows of a cell and guests that are one product
ROUNDS = 12
BLOCK_VALUES = 8_000_000  # values of a file; a task holds two of them
BLOCKS, LEAST_BLOCK = 24, 1024  # files of a table that needs no more for its size, and rows that are worth one
TASK_PAIRS, LEAST_TASKS, MOST_TASKS = 1 << 32, 24, 2000
HEAD_STEP, HEAD_SAMPLE, HEAD_PASSED = 8, 1024, 1e-5  # axes are added until no more than this share of pairs needs the others
MAX_AXES = 1024  # longer vectors are compared on their components as they are
PLACED = "node bigint, weight bigint, cell int, part int, near float, vector binary"
FOUND = "node bigint, links bigint, root bigint"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and the product with it."""
    at, near = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=x.dtype)
    for k in range(0, len(x), 2048):
        products = x[k : k + 2048] @ centres.T
        at[k : k + 2048], near[k : k + 2048] = products.argmax(axis=1), products.max(axis=1)
    return at, near


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centres of the rows of x; an empty cell is started anew from the worst placed row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at, near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        lost = np.flatnonzero(np.bincount(at, minlength=len(centres)) == 0)
        sums[lost] = x[near.argsort()[: len(lost)]]
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centres)
    return centres


def neighbours_first(centres: np.ndarray) -> np.ndarray:
    """The centres in an order that keeps near ones together."""
    return centres[spherical_kmeans(centres, math.isqrt(len(centres))).dot(centres.T).argmax(axis=0).argsort(kind="stable")]


def head_size(x: np.ndarray, threshold: float) -> int:
    """Leading components of the rows of x that rule out all but HEAD_PASSED of the pairs that can be ruled out."""
    size = x.shape[1]
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    far = a @ b.T < threshold
    for n in range(HEAD_STEP, size * 3 // 4, HEAD_STEP):
        ha, hb = heads(a, n), heads(b, n)
        if ((ha @ hb.T >= threshold) & far).sum() <= HEAD_PASSED * far.size:
            return n
    return size


def slack(size: int) -> float:
    """More than the product of two rows of this size can be off in single precision, after a rotation."""
    return (4 * size + 64) * 2.0**-23


def heads(x: np.ndarray, n: int) -> np.ndarray:
    """The first n components and the length of the rest, so that a product is no less than that of the whole rows."""
    if n >= x.shape[1]:
        return x
    h = np.empty((len(x), n + 1), dtype=np.float32)
    h[:, :n] = x[:, :n]
    h[:, n] = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", h[:, :n], h[:, :n]), 0) + slack(x.shape[1]))
    return h


def unit32(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision."""
    x = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def parts_of(rows: dict[int, float], room: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first part, number of parts) of each cell, in the order of ``rows``, and how many parts there are. A cell of more than
    ``room`` rows has parts of its own, others share one with the next."""
    found, part, held = {}, 0, 0.0
    for cell, n in rows.items():
        if held and held + n > room:
            part, held = part + 1, 0.0
        found[cell] = (part, max(1, math.ceil(n / room)))
        held += n
        if n > room:
            part, held = part + found[cell][1], 0.0
    return found, part + bool(held)


def place(centres: np.ndarray, parts: dict[int, tuple[int, int]]) -> Callable:
    size = centres.shape[1]
    cells, first, number = np.array([(c, *p) for c, p in sorted(parts.items())] or [(0, 0, 1)], dtype=np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, weights, vectors = batch.columns
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            usual = np.flatnonzero(lengths == size)
            values, cell, near = vectors.flatten().to_numpy(zero_copy_only=False), -lengths, np.zeros(len(lengths), dtype=np.float32)
            ends = np.cumsum([0, *lengths]) * values.itemsize
            if len(usual):
                x = values if len(usual) == len(lengths) else values[np.repeat(lengths == size, lengths)]
                cell[usual], near[usual] = nearest(unit32(x.reshape(-1, size)), centres)
            salt = nodes.to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            at = np.searchsorted(cells, cell)
            part = first[at] + salt.astype(np.int64) % number[at]
            buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
            vector = pa.Array.from_buffers(pa.binary(), len(lengths), buffers)
            arrays = [nodes, weights, pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(near), vector]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "weight", "cell", "part", "near", "vector"])

    return run


def tasks_of(blocks: list[tuple[str, int, int, int]]) -> list[tuple[str, list[str]]]:
    """A block and those it is compared with, for each task, from (name, rows, least cell, greatest cell) of the blocks."""
    meet = lambda a, b: a[3] >= 0 and b[3] >= 0 or max(a[2], b[2]) <= min(a[3], b[3])
    pairs = [(a, b) for k, a in enumerate(blocks) for b in blocks[k:] if meet(a, b)]
    total = sum(a[1] * b[1] for a, b in pairs)
    most = max(total / MOST_TASKS, min(TASK_PAIRS, total / LEAST_TASKS))
    tasks, held = [], 0
    for a, b in pairs:
        if not tasks or tasks[-1][0] != a[0] or held + a[1] * b[1] > most:
            tasks.append((a[0], []))
            held = 0
        tasks[-1][1].append(b[0])
        held += a[1] * b[1]
    return tasks


class Block:
    """The classes of a file, by cell and the nearest to its centre first, and what their products need."""

    def __init__(self, files, path: str, kind: str, centres: np.ndarray, axes: np.ndarray, head: int):
        import pyarrow.parquet as pq

        with files.open_input_file(path) as source:
            table = pq.read_table(source, columns=["node", "weight", "cell", "near", "vector"])
        cell = table.column("cell").to_numpy()
        order = np.lexsort((-table.column("near").to_numpy(), cell))
        self.node, self.weight, self.cell = table.column("node").to_numpy()[order], table.column("weight").to_numpy()[order], cell[order]
        starts = np.flatnonzero(np.diff(self.cell, prepend=self.cell[:1] - 1))
        self.runs = [(int(self.cell[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(order)])]
        # Rows of a length are one matrix; those of the centres' come last, as their cells have numbers from 0 on.
        vector = table.column("vector").take(pa.array(order)).combine_chunks()
        flat = np.frombuffer(b"".join(vector.to_pylist()), dtype=np.float32 if kind == "float" else np.float64)
        lengths = pc.binary_length(vector).to_numpy(zero_copy_only=False).astype(np.int64) // flat.itemsize
        ends = np.cumsum([0, *lengths])
        self.groups = {}
        usual = int(np.searchsorted(self.cell, 0))
        for c, a, b in [(c, a, b) for c, a, b in self.runs if c < 0] + ([(0, usual, len(order))] if usual < len(order) else []):
            size = int(lengths[a])
            self.groups[size if c < 0 else 0] = Group(a, flat[ends[a] : ends[b]].reshape(b - a, size), None if c < 0 else axes, head)
        if 0 in self.groups:
            group = self.groups[0]
            self.runs = [r for r in self.runs if r[0] >= 0]
            self.own = np.concatenate([group.x[a - usual : b - usual] @ centres[c] for c, a, b in self.runs])


class Group:
    """Rows of one length: as they are, of length 1 along the axes, and their heads."""

    def __init__(self, start: int, raw: np.ndarray, axes: np.ndarray | None, head: int):
        self.start, self.raw = start, raw
        self.x = np.empty(raw.shape, dtype=np.float32)
        for k in range(0, len(raw), 8192):
            x = unit32(raw[k : k + 8192])
            self.x[k : k + 8192] = x if axes is None else x @ axes
        self.h = self.x if axes is None else heads(self.x, head)


class Links:
    """Links between the classes of two blocks, or within one: their number by class, and a smaller class of the component."""

    def __init__(self, left: Block, right: Block):
        self.offset = 0 if left is right else len(left.node)
        both = lambda a, b: a if left is right else np.concatenate([a, b])
        self.node, self.weight = both(left.node, right.node), both(left.weight, right.weight)
        self.links, self.label = np.zeros(len(self.node), dtype=np.int64), self.node.copy()
        self.touched, self.merged = np.zeros(len(self.node), dtype=bool), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        j = j + self.offset
        other = self.node[i] != self.node[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        rows = np.concatenate([k.min() + np.flatnonzero(np.bincount(k - k.min())) for k in (i, j)])
        self.touched[rows] = True
        before = self.label[rows]
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(self.label, i, least)
            np.minimum.at(self.label, j, least)
        # A label that is given up for a smaller one is linked with it, so what it was given for stays connected.
        after = self.label[rows]
        moved = (before != after) & (before != self.node[rows])
        if moved.any():
            self.merged.append(np.unique(np.stack([before[moved], after[moved]], axis=1), axis=0))

    def found(self) -> pa.RecordBatch:
        rows, merged = np.flatnonzero(self.touched), np.concatenate([np.empty((0, 2), dtype=np.int64), *self.merged])
        node, links = np.concatenate([self.node[rows], merged[:, 0]]), np.concatenate([self.links[rows], np.zeros(len(merged), dtype=np.int64)])
        root = np.concatenate([self.label[rows], merged[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])


def tile(a: Group, b: Group, i: np.ndarray, j: np.ndarray, near: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b with a product of at least ``threshold`` in double precision, as places in i and j; ``near`` holds what
    the products can be at most."""
    low = np.float32(threshold - slack(a.x.shape[1]))
    if near.max() < low:
        return (np.empty(0, dtype=np.int64),) * 2
    p, q = np.divmod(np.flatnonzero(near >= low), len(j))
    if a.h is not a.x:
        if len(p) * 16 > near.size:
            p, q = np.divmod(np.flatnonzero(a.x[i] @ b.x[j].T >= low), len(j))
        else:
            linked = np.einsum("ij,ij->i", a.x[i[p]], b.x[j[q]]) >= low
            p, q = p[linked], q[linked]
    if len(p) * 16 > near.size:
        return np.nonzero(unit(a.raw[i].astype(np.float64)) @ unit(b.raw[j].astype(np.float64)).T >= threshold)
    linked = np.einsum("ij,ij->i", unit(a.raw[i[p]].astype(np.float64)), unit(b.raw[j[q]].astype(np.float64))) >= threshold if len(p) else p
    return p[linked], q[linked]


def compare_rows(a: Group, b: Group, rows: np.ndarray, guests: np.ndarray, h: np.ndarray, threshold: float, links: Links) -> None:
    """Tiles of ``rows`` of a, which follow each other, and ``guests`` of b, whose heads are ``h``; in one block, where both
    ascend, a row meets those behind it."""
    space = np.empty(OWN_BLOCK * ALL_BLOCK, dtype=np.float32)
    for at in range(0, len(guests), ALL_BLOCK):
        j = guests[at : at + ALL_BLOCK]
        for k in range(0, len(rows), OWN_BLOCK):
            i = rows[k : k + OWN_BLOCK]
            if a is b and i[0] >= j[-1]:
                break
            near = np.matmul(a.h[i[0] : i[-1] + 1], h[at : at + ALL_BLOCK].T, out=space[: len(i) * len(j)].reshape(len(i), len(j)))
            p, q = tile(a, b, i, j, near, threshold)
            if a is b:
                p, q = p[i[p] < j[q]], q[i[p] < j[q]]
            if len(p):
                links.add(i[p] + a.start, j[q] + b.start)


def compare_cells(left: Block, right: Block, centres: np.ndarray, threshold: float, margin: float, links: Links) -> None:
    """The cells of one block and their guests from another, or the same."""
    a, b = left.groups[0], right.groups[0]
    off, t = slack(a.x.shape[1]), min(1.0, max(-1.0, threshold))
    others, counts = centres[[c for c, _, _ in right.runs]], [hi - lo for _, lo, hi in right.runs]
    for c, lo, hi in left.runs:
        lo, hi = lo - a.start, hi - a.start
        starts = np.arange(lo, hi, OWN_BLOCK)
        least = np.minimum.reduceat(left.own[:hi], starts).clip(-1, 1) - off
        # The least product with the centre that a vector can have which is within the threshold of the outermost of these rows.
        reach = np.where(least > -t, least * t - np.sqrt(np.maximum(1 - least * least, 0) * (1 - t * t)) - off, -np.inf)
        products, apart = b.x @ centres[c], np.sqrt(((others - centres[c]) ** 2).sum(axis=1))
        guest = (products >= reach.min()) & (right.own - products <= np.repeat(margin * apart + off, counts))
        if a is b:
            guest[:lo] = False
        guests = np.flatnonzero(guest)
        if not len(guests):
            continue
        if a is b:
            compare_rows(a, b, np.arange(lo, hi), guests, b.h.take(guests, axis=0), threshold, links)
            continue
        guests = guests[np.argsort(-products[guests])]
        far, h = -products[guests], b.h.take(guests, axis=0)
        for start, n in zip(starts, np.searchsorted(far, -reach, side="right")):
            if n:
                compare_rows(a, b, np.arange(start, min(start + OWN_BLOCK, hi)), guests[:n], h[:n], threshold, links)


def compare(
    folder: str, tasks: list[tuple[str, list[str]]], kind: str, centres: np.ndarray, axes: np.ndarray, head: int, threshold: float, margin: float
) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = location(folder)
        turned = (centres @ axes).astype(np.float32)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, others = tasks[k]
                left = Block(files, f"{path}/{first}", kind, turned, axes, head)
                for name in others:
                    right = left if name == first else Block(files, f"{path}/{name}", kind, turned, axes, head)
                    links = Links(left, right)
                    for size in sorted(left.groups.keys() & right.groups.keys()):
                        a, b = left.groups[size], right.groups[size]
                        if size:
                            compare_rows(a, b, np.arange(len(a.x)), np.arange(len(b.x)), b.h, threshold, links)
                        else:
                            compare_cells(left, right, turned, threshold, margin, links)
                    yield links.found()
        trim()

    return run


def blocks_of(classes: DataFrame, centres: np.ndarray, rows: dict[int, float], block: int) -> tuple[str, list[tuple[str, int, int, int]]]:
    """Writes the classes by cell into files of about ``block`` rows; their folder, and (name, rows, least cell, greatest cell) of each."""
    parts, number = parts_of(rows, block)
    placed = classes.select("node", "weight", "values").mapInArrow(place(centres, parts), PLACED)
    folder = new_folder(classes.sparkSession, "blocks")
    dealt = placed.repartitionById(max(1, number), F.col("part")).drop("part")
    dealt.write.option("maxRecordsPerFile", 2 * block).parquet(folder, compression="zstd")
    written = classes.sparkSession.read.schema(dealt.schema).parquet(folder).select(F.input_file_name().alias("file"), "cell")
    totals = written.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("low"), F.max("cell").alias("high"))
    return folder, sorted((r["file"].rsplit("/", 1)[1], r["n"], r["low"], r["high"]) for r in totals.collect())  # a row per file


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, deviations: float = DEVIATIONS
) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id (smallest id reachable), kept."""
    sound = F.coalesce(
        F.col(vector_col).isNotNull()
        & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(vector_col, lambda v: v != 0),
        F.lit(False),
    )
    kind = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"
    values = F.col(vector_col).cast(f"array<{kind}>")
    known = rows.select(F.col(id_col).alias("id"), order_key(id_col).alias("node"), values.alias("values"), sound.alias("sound"))
    keyed = known.where("sound").withColumns({"h1": F.xxhash64("values"), "h2": F.xxhash64(F.lit(1), "values"), "size": F.size("values")})
    classes = keyed.groupBy("h1", "h2", "size").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("values").alias("values"))
    classes = staged(classes, "classes")

    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    usual = max(sizes, key=lambda s: (sizes[s], s), default=1)
    n, wanted = sizes.get(usual, 0), max(1, SAMPLE_VALUES // usual)
    hashed = F.xxhash64("node", F.lit("sample"))
    # The smallest hashes are well below this share of all; without it, the order would be that of the whole table in one task.
    share = (wanted + 10 * math.sqrt(wanted) + 100) / max(1, n)
    some = classes.where(F.col("size") == usual).where(hashed <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63))))
    sample = some.orderBy(hashed, "node").limit(wanted).select("values").toArrow()
    fitted = unit(matrix(sample.column("values").combine_chunks(), usual)) if len(sample) else np.ones((1, usual)) / math.sqrt(usual)
    k = min(MAX_CELLS, max(1, n // CELL_ROWS))
    centres = neighbours_first(spherical_kmeans(fitted, k)).astype(np.float32)
    axes = np.eye(usual) if usual > MAX_AXES else np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1]
    head = head_size((fitted[:HEAD_SAMPLE] @ axes).astype(np.float32), threshold)
    exact = math.sqrt(1 - threshold * threshold) if 0 < threshold < 1 else float(threshold <= 0)
    margin = min(exact, math.sqrt(max(0.0, 2 - 2 * threshold)) * deviations / math.sqrt(usual)) if deviations < math.inf else exact

    block = max(1, min(BLOCK_VALUES // usual, max(LEAST_BLOCK, -(-n // BLOCKS))))
    share_of = np.bincount(nearest(fitted.astype(np.float32), centres)[0], minlength=len(centres)) * (n / max(1, len(fitted)))
    rows = {-s: float(m) * max(1, s / usual) for s, m in sorted(sizes.items()) if s != usual} | dict(enumerate(share_of.tolist()))
    folder, blocks = blocks_of(classes, centres, rows, block)
    tasks = tasks_of(blocks)
    numbers = classes.sparkSession.range(0, len(tasks), 1, max(1, len(tasks)))
    found = numbers.mapInArrow(compare(folder, tasks, kind, centres, np.ascontiguousarray(axes, dtype=np.float32), head, threshold, margin), FOUND)
    found = staged(found, "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("h1", "h2", "size", F.col("node").alias("first"), "weight")
        .join(links.withColumnRenamed("node", "first"), "first", "left")
        .join(group.withColumnRenamed("node", "first"), "first", "left")
    )
    linked = keyed.drop("values").join(per_class, ["h1", "h2", "size"]).select(
        "id", "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")
    )
    alone = known.where("NOT sound").select("id", "node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        F.nullif("component", F.lit(LEAST).cast("long")).alias("component_id"),
        (F.col("node") == F.col("component")).alias("kept"),
    )
