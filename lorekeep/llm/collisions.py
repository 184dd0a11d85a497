"""Nearest vectors by inner product: query-aware collision counting over sorted arrays of single projections.

Largest inner product is nearest distance: a vector x becomes (x, sqrt(M^2 - |x|^2)) / M with M the largest length, a query q
becomes (q, 0) / |q|, and the squared distance of the two is 2 - 2 <q, x> / (|q| M).

1. Index: every vector goes to a block of about BLOCK rows. A block holds PROJECTIONS sorted arrays: the projections of its
   vectors on one random direction each, with the rows they belong to.
2. Search: a query's own projection is the centre of a window of width 2 R in each array. A vector within distance R falls into
   a window with probability P(|z| <= 1), so into at least THRESHOLD of the PROJECTIONS windows with probability at least
   1 - MISSED. Vectors that collide that often are verified: their inner product is computed on the original vectors.
3. Virtual rehashing: R grows from step to step, windows grow on both sides and only what is new is counted, until the k-th
   best verified vector lies within R, or R reaches the largest possible distance; then all the rest is verified. No number of
   candidates ends the search early, so each of the nearest is found with probability 1 - MISSED.
4. Blocks of queries meet all blocks of vectors; the k best of each pair of blocks are merged by a window.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part;
vectors are compared with queries of their own length only; each row whose id is a query's is searched for on its own, and no
row of its id is an answer; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.storage import staged

NEAREST, EVERY = 20, 20
PROJECTIONS, MISSED = 64, 0.05
BLOCK, QUERIES = 16_384, 1_024
FIRST_RADIUS, GROWTH, FARTHEST = 0.25, 1.3, 2.0
SLACK = 1e-9
MAX_TASKS = 10_000  # pairs of blocks beyond share tasks
SEED = 20240612

INDEX = "size int, block bigint, ids binary, vectors binary, norm double, keys binary, places binary"
ASKED = "size int, part bigint, rows binary, ids binary, vectors binary"
FOUND = "row bigint, query_id bigint, vec_id bigint, score double"


def threshold(projections: int = PROJECTIONS, missed: float = MISSED) -> int:
    """The most collisions that a vector within the radius reaches with probability 1 - missed."""
    p = erf(1 / sqrt(2))
    below, least = 0.0, 0
    while True:
        below += comb(projections, least) * p**least * (1 - p) ** (projections - least)
        if below > missed:
            return least
        least += 1


def directions(size: int, projections: int) -> np.ndarray:
    """Random directions for lifted vectors of ``size`` + 1 components, the same in all tasks."""
    return np.random.default_rng([SEED, size]).standard_normal((projections, size + 1))


def matrix(lists: pa.ChunkedArray, size: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, size)


def build(projections: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """The sorted arrays of a block."""
        size, norm = table["size"][0].as_py(), table["norm"][0].as_py()
        table = table.sort_by("row")
        vectors = matrix(table["embedding"], size)
        lifted = vectors / norm
        lifted = np.column_stack([lifted, np.sqrt(np.maximum(0.0, 1 - (lifted**2).sum(axis=1)))])
        keys = (directions(size, projections) @ lifted.T).astype("<f4")
        places = np.argsort(keys, axis=1, kind="stable").astype("<u4")
        columns = [
            pa.array([size], pa.int32()), pa.array([table["block"][0].as_py()]), pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()]),
            pa.array([vectors.astype("<f8").tobytes()]), pa.array([norm]), pa.array([np.take_along_axis(keys, places, axis=1).tobytes()]), pa.array([places.tobytes()]),
        ]
        return pa.table(columns, ["size", "block", "ids", "vectors", "norm", "keys", "places"])

    return run


def gather(table: pa.Table) -> pa.Table:
    """A block of queries as one row."""
    size = table["size"][0].as_py()
    columns = [
        pa.array([size], pa.int32()), pa.array([table["part"][0].as_py()]), pa.array([table["row"].to_numpy().astype("<i8").tobytes()]),
        pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()]), pa.array([matrix(table["embedding"], size).astype("<f8").tobytes()]),
    ]
    return pa.table(columns, ["size", "part", "rows", "ids", "vectors"])


def distance(score: np.ndarray | float, length: np.ndarray | float, norm: float) -> np.ndarray:
    """Of the lifted vectors, from their inner product."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * score / (length * norm)))


class Query:
    """One query's search in one block."""

    def __init__(self, vector: np.ndarray, own: np.ndarray, n: int):
        self.vector = vector
        self.count = np.zeros(n, dtype=np.int64)
        self.open = np.ones(n, dtype=bool)
        self.open[own] = False
        self.rows, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.verified = 0

    def verify(self, found: np.ndarray, vectors: np.ndarray, nearest: int) -> None:
        if len(found):
            self.open[found] = False
            self.verified += len(found)
            rows = np.concatenate([self.rows, found])
            scores = np.concatenate([self.scores, vectors[found] @ self.vector])
            if len(rows) > nearest:
                # What rounding may have put behind stays until the scores are taken anew.
                near = scores >= np.partition(scores, -nearest)[-nearest] - SLACK * np.abs(scores).max()
                rows, scores = rows[near], scores[near]
            self.rows, self.scores = rows, scores

    def result(self, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores in double precision, every row summed in the same order."""
        scores = (vectors[self.rows] * self.vector).sum(axis=1)
        order = np.lexsort((ids[self.rows], -scores))[:nearest]
        return self.rows[order], scores[order]


def search_block(
    ids: np.ndarray, vectors: np.ndarray, norm: float, keys: np.ndarray, places: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, nearest: int, least: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per query the rows of its nearest vectors in this block and their scores; and how many vectors were verified."""
    projections, n = keys.shape
    places = places.astype(np.intp)
    lengths = np.sqrt((asked**2).sum(axis=1))
    centre = (directions(vectors.shape[1], projections)[:, :-1] @ (asked / lengths[:, None]).T).astype(np.float32)
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], asked_ids, side=side) for side in ("left", "right"))
    queries = [Query(v, by_id[a:b], n) for v, a, b in zip(asked, first, last)]
    low = np.stack([k.searchsorted(c) for k, c in zip(keys, centre)])
    high = low.copy()
    active = np.arange(len(asked))
    radius = np.full(len(asked), FIRST_RADIUS)
    while len(active):
        reach, middle = radius[active].astype(np.float32), centre[:, active]
        to_low = np.stack([k.searchsorted(c - reach) for k, c in zip(keys, middle)])
        to_high = np.stack([k.searchsorted(c + reach, side="right") for k, c in zip(keys, middle)])
        for j, q in enumerate(active.tolist()):
            query = queries[q]
            fresh = []
            for place, a, b, c, d in zip(places, to_low[:, j].tolist(), low[:, q].tolist(), high[:, q].tolist(), to_high[:, j].tolist()):
                fresh += place[a:b], place[c:d]
            query.count += np.bincount(np.concatenate(fresh), minlength=n)
            query.verify(np.flatnonzero((query.count >= least) & query.open), vectors, nearest)
        low[:, active], high[:, active] = to_low, to_high
        # Done are those whose nearest-th best lies within the radius, as all vectors nearer had their chance; nobody needs
        # a larger radius than the nearest-th best so far.
        best = np.array([np.partition(queries[q].scores, -nearest)[-nearest] if len(queries[q].scores) >= nearest else -np.inf for q in active])
        apart = distance(best, lengths[active], norm)
        going = ~(apart <= radius[active])
        active, apart = active[going], apart[going]
        radius[active] = np.minimum(radius[active] * GROWTH, apart)
        for q in active[radius[active] >= FARTHEST]:
            queries[q].verify(np.flatnonzero(queries[q].open), vectors, nearest)
        active = active[radius[active] < FARTHEST]
    return [q.result(ids, vectors, nearest) for q in queries], sum(q.verified for q in queries)


def search_pairs(nearest: int, least: int) -> Callable:
    """The nearest vectors that a block of vectors has for a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids, asked_ids, asked_rows = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "asked_ids", "asked_rows"))
                vectors, asked = (np.frombuffer(row[c], dtype="<f8").reshape(-1, row["size"]) for c in ("vectors", "asked"))
                keys, places = (np.frombuffer(row[c], dtype=t).reshape(-1, len(ids)) for c, t in (("keys", "<f4"), ("places", "<u4")))
                found, _ = search_block(ids, vectors, row["norm"], keys, places, asked, asked_ids, nearest, least)
                times = [len(f) for f, _ in found]
                if sum(times):
                    at, score = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asked_rows, times)), pa.array(np.repeat(asked_ids, times)), pa.array(ids[at]), pa.array(score)],
                        ["row", "query_id", "vec_id", "score"],
                    )

    return run


def index(vectors: DataFrame, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """The blocks of ``vectors`` (row, vec_id, embedding, size), each a row."""
    of_size = vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)"))).alias("norm"))
    dealt = vectors.join(of_size, "size").withColumn("block", F.expr(f"pmod(xxhash64(row), (n + {block - 1}) div {block})"))
    dealt = dealt.select("size", "block", "row", "vec_id", "embedding", "norm")
    return dealt.groupBy("size", "block").applyInArrow(build(projections), INDEX)


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, nearest: int = NEAREST,
    projections: int = PROJECTIONS, missed: float = MISSED, block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` rows of each row whose id is divisible by ``every``."""
    known = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = "vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    known = known.where(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("size"))
    known = staged(known, "vectors")
    built = staged(index(known, projections, block), "index")

    asked = known.where(f"vec_id % {every} = 0")
    parts = asked.groupBy("size").agg(F.expr(f"(count(*) + {queries - 1}) div {queries}").alias("parts"))
    dealt = asked.join(parts, "size").withColumn("part", F.expr("pmod(xxhash64(row), parts)"))
    blocks = staged(dealt.select("size", "part", "row", "vec_id", "embedding").groupBy("size", "part").applyInArrow(gather, ASKED), "queries")
    blocks = blocks.select("size", "part", F.col("rows").alias("asked_rows"), F.col("ids").alias("asked_ids"), F.col("vectors").alias("asked"))
    pairs = built.join(blocks, "size")
    # Every pair of blocks is the work of seconds: one task each as far as that is reasonable.
    tasks = min(MAX_TASKS, max(1, built.count() * blocks.count()))
    found = pairs.repartition(tasks, "block", "part").mapInArrow(search_pairs(nearest, threshold(projections, missed)), FOUND)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
