import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import repeats

DOCS = "doc_id bigint, text string, spans string, sha int"


def brute(rows, minimum):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + minimum] for _, b in data for k in range(len(b) - minimum + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - minimum + 1):
            if seen[b[k : k + minimum]] > 1:
                gone[k : k + minimum] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def maximal_groups(strings, minimum):
    """Every maximal repeat: a string of at least ``minimum`` bytes that occurs twice and cannot grow to either side."""
    out = set()
    for n in range(minimum, max(map(len, strings), default=0) + 1):
        places = {}
        for k, s in enumerate(strings):
            for i in range(len(s) - n + 1):
                places.setdefault(s[i : i + n], []).append((k, i))
        for text, at in places.items():
            before = {strings[k][i - 1] if i else ("start", k, i) for k, i in at}
            after = {strings[k][i + n] if i + n < len(strings[k]) else ("end", k, i) for k, i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                out.add((n, tuple(sorted(at))))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=25).map(str.encode), min_size=1, max_size=5), st.integers(2, 6))
def test_intervals_are_the_maximal_repeats(strings, minimum):
    groups, covered, begin = repeats.intervals(strings, minimum)
    where = lambda p: (int(np.searchsorted(begin, p, side="right")) - 1,)
    found = {(n, tuple(sorted((*where(p), int(p - begin[where(p)[0]])) for p in at))) for n, at in groups}
    assert found == maximal_groups(strings, minimum)
    for k, s in enumerate(strings):
        expected = np.zeros(len(s), dtype=bool)
        for n, at in maximal_groups(strings, minimum):
            for j, i in at:
                if j == k:
                    expected[i : i + n] = True
        assert (covered[begin[k] : begin[k] + len(s)] == expected).all()


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abcdefgh \né") for _ in range(n))
    passage, other = fresh(330), fresh(230)
    texts = [fresh(rng.randint(0, 400)) for _ in range(40)]
    texts += [fresh(rng.randint(0, 60)) + passage + fresh(rng.randint(0, 60)) for _ in range(60)]
    texts += [fresh(30) + other[rng.randint(0, 40) :] + fresh(9) + passage[: rng.randint(150, 330)] for _ in range(30)]
    base = fresh(900)
    for _ in range(30):
        k = rng.randrange(880)
        texts.append(base[:k] + fresh(3) + base[k + 3 :])
    texts += ["x" * 500, "x" * 199, "xy" * 300, "abc" * 200, base, base, texts[1], texts[1], "short", "short", "", "", None]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_equals_brute_force(spark, crowd, monkeypatch, limit):
    monkeypatch.setattr(repeats, "KEY_LIMIT", limit)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 5000)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in crowd], DOCS).repartition(6)
    assert got(repeats.find(df)) == brute(crowd, 200)


def test_query_equals_brute_force(run, texts):
    assert sorted(map(tuple, run("op6_interval_tree")), key=str) == brute(list(texts.items()), 200)


def test_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(repeats.find(odd_docs)) == brute(rows, 200)
    assert repeats.find(no_docs).count() == 0
    kept = repeats.find(odd_docs, with_bytes=True).collect()
    assert all(r.kept is None or sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
