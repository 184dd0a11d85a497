import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lorekeep.llm import collisions

VECTORS = "vec_id bigint, embedding array<double>, label int, row string, score int, rank int"


def brute(rows, every, nearest):
    """(query_id, vec_id, score) lists by query row; rows: (vec_id, vector)."""
    sound = [
        (i, np.array(v, dtype=float))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = defaultdict(list)
    for i, q in sound:
        if i % every == 0:
            found = [(-float((v * q).sum()), j) for j, v in sound if j != i and len(v) == len(q)]
            out[i].append([(j, -s) for s, j in sorted(found)[:nearest]])
    return out


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def shared(found, expected):
    """Part of the expected neighbours that were found."""
    hit = sum(len({v for _, v, _ in found.get(q, [])} & {v for v, _ in one}) for q, (one,) in expected.items())
    return hit / sum(len(one) for (one,) in expected.values())


@pytest.mark.parametrize("kind", ["unit", "clustered", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    if kind == "clustered":
        x = 3 * rng.standard_normal((15, 24))[rng.integers(0, 15, 1500)] + x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x *= rng.uniform(0.1, 4, 1500)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame([(*r, None, "r", 0, 0) for r in rows], VECTORS).repartition(3)
    found = got(collisions.search(vectors, block=400, queries=30))
    expected = brute(rows, 20, 20)
    assert set(found) == set(expected)
    assert shared(found, expected) >= 0.95
    for q, listed in found.items():
        assert [k for k, _, _ in listed] == list(range(1, 21)) and q not in [v for _, v, _ in listed]
        assert [(-s, v) for _, v, s in listed] == sorted((-s, v) for _, v, s in listed)
        assert all(abs(s - float(x[v] @ x[q])) < 1e-12 for _, v, s in listed)


def test_registered_query(run, sf_dir):
    found = defaultdict(list)
    for r in run("op12_collision_counting"):
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    expected = brute(rows, 20, 20)
    assert set(found) == set(expected) and shared(found, expected) >= 0.95


def test_ties_copies_and_few_candidates(spark):
    """Copies of one vector: the smaller ids come first, and all candidates are returned where there are fewer."""
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(600)] + [(1000, [0.5, 0.0]), (1001, [0.0, 1.0]), (1020, [-1.0, -1.0])]
    vectors = spark.createDataFrame([(*r, None, "r", 0, 0) for r in rows], VECTORS).repartition(4)
    found = got(collisions.search(vectors, block=100, queries=7))
    for q, (expected,) in brute(rows, 20, 20).items():
        assert [(v, s) for _, v, s in found[q]] == expected
    assert len(found[1000]) == 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0])]
    sound = [(120, [1.0, 0.0]), (121, [1.0, 1.0]), (122, [0.0, 1.0]), (140, [2.0]), (160, [5.0, 5.0, 5.0]), (121, [3.0, 0.0]), (120, [0.0, 2.0])]
    vectors = spark.createDataFrame([(*r, None, "r", 0, 0) for r in odd + sound], VECTORS)
    found = got(collisions.search(vectors))
    # Both rows of id 120 are searched for, neither answers; ids without a candidate have no rows.
    assert set(found) == {120}
    expected = sorted((k, *one) for listed in brute(odd + sound, 20, 20)[120] for k, one in enumerate(listed, 1))
    assert found[120] == expected
    assert collisions.search(vectors.limit(0)).count() == 0


def test_threshold():
    """A vector at the radius collides often enough with probability 0.95."""
    rng, least = np.random.default_rng(1), collisions.threshold(64, 0.05)
    hits = (np.abs(rng.standard_normal((20_000, 64))) <= 1).sum(axis=1)
    assert (hits >= least).mean() > 0.945 and (hits >= least + 1).mean() < 0.955
