import random
import re

import numpy as np
import pytest

from lorekeep.llm import ngram_join
from lorekeep.llm.shingles import shingles

DOCS = "doc_id bigint, text string, n int, component string"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_shingles_equal_word_tuples(texts):
    odd = [None, "", " \n\t", "A b", "a\x0bB\x0cc\rd e f", "Ä ä é", "x " * 50, "a b c d e f\xa0g h", "one two three four five six"]
    for text in [*odd, *list(texts.values())[:60]]:
        assert len(shingles(text)) == len(plain_set(text))
    assert (shingles("A B c d E f") == shingles("a b C D e F")).all()
    assert not np.intersect1d(shingles("a b c d"), shingles("a b c d e")).size


@pytest.fixture(scope="module")
def crowd():
    """Copies, chains of edits, a large group of near copies, a passage in every third text, short texts."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage, hot = [], fresh(30), fresh(120)
    for k in range(150):
        rows.append(fresh(rng.randint(1, 150)) + (passage if k % 3 == 0 else []))
    for k in range(320):
        edited = list(hot)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(edited)
    chain = fresh(100)
    for k in range(25):
        chain = list(chain)
        chain[(k * 17) % 100] = "edit"
        rows.append(chain)
    rows += [rows[5], rows[5], rows[7], fresh(3), ["one", "two"], ["one", "two"], ["One", "TWO"]]
    texts = [" ".join(r) for r in rows] + [None, "", " "]
    rng.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block", [16, 128, 1000])
def test_equals_all_pairs(spark, crowd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in crowd], DOCS).repartition(5)
    assert got(ngram_join.near_groups(df)) == brute(crowd)


def test_query_equals_all_pairs(run, texts):
    assert sorted(map(tuple, run("op2_prefix_tree_join"))) == brute(list(texts.items()))


def test_odd_tables(odd_docs, no_docs, spark):
    rows = ngram_join.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert ngram_join.near_groups(no_docs).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(nameless).collect()} == {(None, 2, None), (4, 2, None), (None, 0, None)}


def test_trie_finds_all_links():
    rng = np.random.default_rng(1)
    base = [np.sort(rng.choice(60, size=rng.integers(5, 30), replace=False)) for _ in range(40)]
    sets = base + [np.sort(np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(60)))) for b in base]
    sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
    trie = ngram_join.Trie(sets, sizes)
    for k, s in enumerate(sets):
        has = np.zeros(60, dtype=bool)
        has[s] = True
        expected = {j for j, o in enumerate(sets) if 7 * len(np.intersect1d(s, o)) >= 3 * (sizes[k] + sizes[j])}
        assert set(trie.links(s, has, sizes[k])) == expected


def brute_by_id(rows):
    """Rows by position, so that ids may repeat; rows of one id that have words share a component, null ids don't."""
    groups = {k: c for k, _, c in brute([(k, t) for k, (_, t) in enumerate(rows)])}
    parent = {c: c for c in groups.values()}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    sized = [len(plain_set(t)) for _, t in rows]
    at = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sized[k]:
            parent[find(groups[k])] = find(at.setdefault(i, groups[k]))
    order, least = (lambda i: -1 if i is None else i), {}
    for k, (i, _) in enumerate(rows):
        least[find(groups[k])] = min(least.get(find(groups[k]), i), i, key=order)
    return sorted(((i, sized[k], least[find(groups[k])]) for k, (i, _) in enumerate(rows)), key=str)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(5)
    fresh = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]
    joined = lambda *parts: " ".join(sum(parts, []))
    half, long, tail = fresh(40), fresh(80), fresh(30)
    edited = [*long[:40], "edit", *long[41:]]
    rows = [(1, joined(half, fresh(40))), (2, joined(half, fresh(40)))]
    rows += [rows[0]] * 4 + [rows[1]] * 3
    rows += [(3, joined(long)), (3, joined(tail)), (4, joined(edited)), (5, joined(tail, ["more"])), (3, None), (3, "")]
    one, two = fresh(60), fresh(200)
    rows += [(None, joined(one)), (None, joined(two)), (None, joined(fresh(50))), (9, joined(one, ["end"])), (8, joined(two, ["end"])), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(df).collect()), key=str)
    assert found == brute_by_id(rows)
    assert {c for i, _, c in found if i in (1, 2)} == {1, 2} and {c for i, _, c in found if i in (8, 9)} == {None}
