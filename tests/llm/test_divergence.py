import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, term string, place int, value int"


def brute(rows, minimum, top):
    """rows: (text, lang, source)."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    counts, documents, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms(text)
        counts[lang, source].update(found)
        documents[lang].update(set(found))
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in documents[lang].items() if n >= minimum]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in names}
        n[None] = {t: sum(n[s][t] for s in names) for t in kept}
        total = {s: sum(n[s].values()) for s in n}
        p = {s: {t: 1 + 10**9 * (n[s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in n}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            words = [(p[None][t] - p[s][t], t.encode()) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)}
    return out


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


WORDS = "the The cat Über über straße ΣΑ x y z 日本 don't a-b dog".split(" ")


def random_rows(seed, n, sources, langs=("en", "de", None)):
    rng = np.random.default_rng(seed)
    names = [f"s{k}" if k else None for k in range(sources)]
    for k in range(n):
        words = rng.choice(WORDS, size=int(rng.integers(0, 12)))
        lang = langs[int(rng.integers(0, len(langs)))]
        yield k, " ".join(words) if len(words) else None, lang, names[int(sources * rng.random() ** 3)]


@pytest.mark.parametrize("block, shard_rows, held", [(256, 500_000, 300_000), (3, 4, 2)])
def test_equals_brute_force(spark, monkeypatch, block, shard_rows, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    rows = [*random_rows(1, 300, 8), (300, "cat", "only", "group"), (301, "", "empty", "a"), (302, None, "empty", "b")]
    rows += [rows[0]] * 40  # repeated rows count each
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(3)
    for minimum, top in ((5, 3), (1, 50), (10**6, 50)):
        assert got(divergence.audit(docs, minimum=minimum, top=top)) == brute([r[1:] for r in rows], minimum, top)


def test_empty_table_and_odd_texts(spark, odd_docs, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert got(divergence.audit(odd_docs, minimum=1)) == brute(rows, 1, 50)


def test_long_text(spark):
    text = "Lorem ipsum " * 500_000
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "lorem", "en", "b")], "doc_id bigint, text string, lang string, source string")
    assert got(divergence.audit(docs, minimum=1)) == brute([(text, "en", "a"), ("lorem", "en", "b")], 1, 50)


def test_shares_beyond_64_bits():
    total = 8 * 10**15
    counts = np.array([5, 10**9 + 7, 10**15 + 3, total], dtype=np.int64)
    assert divergence.share(counts, np.int64(total)).tolist() == [1 + 10**9 * int(c) // total for c in counts]
