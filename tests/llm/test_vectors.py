import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import vectors
from lorekeep.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, shard int"


def brute(rows, threshold=0.9):
    """{position: (n_links, smallest linked id)} by all pairs."""
    sound = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, dtype=np.float64)
            sound[k] = v / np.linalg.norm(v)
    links, parent = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in sound:
        for j in sound:
            if i < j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:60, None] + 0.12 * rng.normal(size=(60, 5, 16))
    hot = base[0] + 0.05 * rng.normal(size=(400, 16))
    x = np.concatenate([base, near.reshape(-1, 16), hot, np.repeat(base[7:8], 250, axis=0)]).astype(np.float32)
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_equals_all_pairs(spark, crowd, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    monkeypatch.setattr(vectors, "OWN_BLOCK", 64)
    monkeypatch.setattr(vectors, "ALL_BLOCK", 128)
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in crowd], SCHEMA)
    expected = sorted(brute(crowd))
    assert got(vectors.near_duplicates(df, deviations=float("inf"))) == expected
    default = got(vectors.near_duplicates(df))
    found, there = sum(r[1] for r in default), sum(r[1] for r in expected)
    assert found >= 0.99 * there and all(a[1] <= b[1] for a, b in zip(default, expected))


def test_query_equals_all_pairs(run, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, run("op5_spherical_cells"))) == sorted(brute(rows))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (9, [2.0, 0.0]),
            (8, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.1, 0.0]), (12, [-1.0, 0.0]), (13, [3e38, 1e30])]
    df = spark.createDataFrame([(i, v, None, 1) for i, v in rows], SCHEMA)
    assert got(vectors.near_duplicates(df)) == sorted(brute(rows))
    assert vectors.near_duplicates(df.where("false")).count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 0.0], 0, 0), (3, [1.0, 0.01], 0, 0)], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(nameless).collect()}
    assert out == {None: (1, None, True), 3: (1, None, False)}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 101 + k) for k in range(30)] + [(131, 130)]
    loops = [(500, 500), (601, 600), (600, 601)]
    df = components(spark.createDataFrame(chain + star + loops, "a long, b long"))
    out = {r.node: r.component for r in df.collect()}
    expected = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 132)} | {601: 600}
    assert {k: c for k, c in out.items() if k != c} == expected
    assert components(df.where("false").select(F.col("node").alias("a"), F.col("component").alias("b"))).count() == 0


def test_pairs_across_a_border_of_data_along_a_line(spark, monkeypatch):
    """Vectors spread along one arc: the difference of a pair lies along the line between the centres."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 30)
    rng = np.random.default_rng(5)
    angles = np.sort(rng.uniform(0, 2.5, size=300))
    x = np.zeros((300, 64))
    x[:, 0], x[:, 1] = np.cos(angles), np.sin(angles)
    rows = [(k, v.tolist()) for k, v in enumerate((x + 0.002 * rng.normal(size=x.shape)).astype(np.float32))]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    assert got(vectors.near_duplicates(df)) == sorted(brute(rows))


def test_results_are_the_same_for_any_cells(spark, crowd, monkeypatch):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in crowd], SCHEMA)
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    assert got(vectors.near_duplicates(df)) == sorted(brute(crowd))


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_disk_grows_with_the_vectors_alone(spark, monkeypatch, tmp_path):
    """No clusters: every cell is near every other, and no vector is copied for them."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 50)
    monkeypatch.setattr(vectors, "new_folder", lambda session, name: f"file://{tmp_path}/{name}", raising=False)
    x = np.random.default_rng(11).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0, 0) for k, v in enumerate(x)], SCHEMA)
    before = shuffled(spark)
    out = vectors.near_duplicates(df)
    assert out.count() == 4000 and out.where("n_links > 0 OR NOT kept").count() == 0
    assert shuffled(spark) - before < 4 * x.nbytes
    assert sum(f.stat().st_size for f in tmp_path.glob("blocks/*.parquet")) < 2 * x.nbytes


@pytest.mark.parametrize(("kind", "threshold"), [("float", -0.2), ("double", 0.3), ("float", 0.9), ("double", 0.99)])
def test_blocks_of_several_lengths(spark, monkeypatch, kind, threshold):
    """Many files, cells over several of them, and lengths of their own; groups of near copies and of equal ids."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "LEAST_BLOCK", 16)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 1200)
    monkeypatch.setattr(vectors, "OWN_BLOCK", 8)
    monkeypatch.setattr(vectors, "ALL_BLOCK", 16)
    rng = np.random.default_rng(13)
    near = lambda n, size, spread: rng.normal(size=(1, size)) + spread * rng.normal(size=(n, size))
    groups = [rng.normal(size=(200, 40)), near(90, 40, 0.1), near(60, 40, 0.4), near(30, 7, 0.2), rng.normal(size=(25, 7)), near(20, 3, 0.1)]
    x = [v.astype(np.float32).tolist() for g in groups for v in g]
    rows = [(k, v) for k, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA.replace("float", kind))
    assert got(vectors.near_duplicates(df, threshold=threshold)) == sorted(brute(rows, threshold))


def test_heads_are_no_less_than_products():
    rng = np.random.default_rng(17)
    x = vectors.unit32(rng.normal(size=(300, 48)) * 0.9 ** np.arange(48))
    for n in (1, 8, 24, 47):
        h = vectors.heads(x, n)
        assert h.shape == (300, n + 1) and (h @ h.T >= x @ x.T).all()


def test_links_keep_components_when_labels_change():
    """Three nodes in a row, the smallest found last: what is returned connects all of them."""

    class Nodes:
        node, weight = np.array([5, 9, 2]), np.array([1, 2, 3])

    block = Nodes()
    links = vectors.Links(block, block)
    links.add(np.array([0]), np.array([1]))
    links.add(np.array([1]), np.array([2]))
    node, count, root = (c.to_pylist() for c in links.found().columns)
    assert sorted(zip(node[:3], count[:3])) == [(2, 2), (5, 2), (9, 4)]
    reached = {2}
    for _ in range(3):
        reached |= {n for pair in zip(node, root) if reached & set(pair) for n in pair}
    assert reached == {2, 5, 9}
