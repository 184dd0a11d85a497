import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import phrases

DOCS = "doc_id bigint, text string, lang string, source string, word string, slice int, places int"


def brute(rows, minimum, longest, top):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= minimum}
        listed = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 50 * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(listed)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


WORDS = ["new", "New", "york", "city", "the", "of", "ß", "日本", "a", "b", "c"]
MARKS = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "? ! ", " ; ", "\x0b", " "]


def random_texts(seed, n, length):
    rng = np.random.default_rng(seed)
    weights = np.array([4.0, 1, 4, 3, 6, 5, 1, 1, 2, 2, 2])
    for _ in range(n):
        words = rng.choice(WORDS, size=int(rng.integers(0, length)), p=weights / weights.sum())
        yield "".join(w + MARKS[int(rng.integers(0, len(MARKS)))] for w in words)


@pytest.mark.parametrize("slice_bytes, per_bucket, longest, minimum, top", [(8 << 20, 10**6, 3, 10, 2000), (300, 200, 3, 3, 7), (1000, 500, 4, 3, 40)])
def test_equals_brute_force(spark, monkeypatch, slice_bytes, per_bucket, longest, minimum, top):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    monkeypatch.setattr(phrases, "PER_BUCKET", per_bucket)
    langs = ["en", "de", None, ""]
    rows = [(t, langs[k % 3 if k % 11 else 3]) for k, t in enumerate(random_texts(2, 150, 40))]
    rows += [rows[4]] * 12 + [(None, "en"), ("", "en"), ("...", "fr"), ("word", None), (" \t new york ", "en")]
    docs = spark.createDataFrame([(k, *r, None, "w", 1, 2) for k, r in enumerate(rows)], DOCS).repartition(3)
    assert got(phrases.mine(docs, minimum=minimum, max_words=longest, top=top)) == brute(rows, minimum, longest, top)


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert got(phrases.mine(odd_docs)) == brute(rows, 10, 3, 2000)
    assert phrases.mine(no_docs).count() == 0


def test_long_text(spark):
    text = " ".join(random_texts(5, 20_000, 60))
    assert len(text) > 2_000_000
    docs = spark.createDataFrame([(text, "en"), ("new york", "en")], "text string, lang string")
    assert got(phrases.mine(docs)) == brute([(text, "en"), ("new york", "en")], 10, 3, 2000)


def test_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**14 + 7, 9 * 10**14 + 1, 10**15 + 3
    df = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint")
    assert df.select(phrases.score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (l * r)


@pytest.mark.parametrize("kind", ["<u4", "<i8"])
@pytest.mark.parametrize("size", [0, 1, 100_000])
def test_packed_arrays_come_back(kind, size):
    values = np.random.default_rng(size).integers(0, 1 << 31, size).astype(kind)
    assert np.array_equal(phrases.numbers(phrases.packed(values), kind), values)


def test_relations_are_small(monkeypatch):
    """Rows with the occurrences of a slice and its groups hold far less than the arrays they stand for."""
    monkeypatch.setattr(phrases.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    words = [f"word{k}" for k in range(3000)]
    picked = np.random.default_rng(1).zipf(1.3, 300_000) % 3000
    texts = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words[k] for k in picked)]})
    row = next(phrases.read_words(iter([texts])))
    size = lambda batch, *names: sum(len(batch.column(c)[0].as_py()) for c in names)
    assert size(row, "places") < 0.5 * 4 * len(picked)
    codes = np.arange(1, len(row.column("words")[0].as_py()) + 1, dtype="<u4")
    found = [{"codes": phrases.packed(codes), "ids": phrases.packed(codes.astype("<i8"))}]
    slices = pa.RecordBatch.from_arrays([row.column("slice"), row.column("places"), pa.array([found])], ["slice", "places", "found"])
    pairs = next(phrases.extend(1, True)(iter([slices])))
    groups = len(phrases.numbers(pairs.column("prev")[0].as_py()))
    assert size(pairs, "places", "groups") < 0.6 * 8 * len(picked)
    assert size(pairs, "prev", "last", "counts") < 0.3 * 20 * groups
