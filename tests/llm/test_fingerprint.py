from hashlib import sha256

from lorekeep.llm import fingerprint as fp


def expected(texts):
    ids = sorted(texts)
    for k, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        yield i, len(text), sha256(edited.encode()).hexdigest(), fp.digest(text), fp.digest(edited), fp.digest(following)


def test_query_equals_brute_force(run, texts):
    rows = {r.doc_id: r for r in run("op1_quartile_digest")}
    assert len(rows) == len(texts)
    for i, n, sha, mark, edited, following in expected(texts):
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, mark, edited)
        assert r.near_edited == fp.likeness(mark, edited) and r.near_next == fp.likeness(mark, following)
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)


def test_counts_every_triplet():
    data = b"abcdefgh"
    assert fp.counts(data).sum() == len(fp.TRIPLETS) * len(data)
    assert fp.counts(b"").sum() == 0


def test_likeness_is_bounded_and_reflexive(texts):
    marks = [fp.digest(t) for t in list(texts.values())[:40]] + [fp.digest(None), fp.digest("a")]
    assert all(fp.likeness(a, a) == 1 for a in marks)
    assert all(0 <= fp.likeness(a, b) <= 1 and fp.likeness(a, b) == fp.likeness(b, a) for a in marks for b in marks)


def test_small_and_odd_tables(spark, odd_docs, no_docs):
    rows = fp.compare_with_successor(odd_docs.select("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    assert fp.compare_with_successor(no_docs).count() == 0
    one = spark.createDataFrame([(7, "abc")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in fp.compare_with_successor(one).collect()] == [(7, 1.0)]
    marks = fp.fingerprints(odd_docs).collect()
    assert {r.fingerprint for r in marks if r.doc_id is None} >= {fp.digest(None)}
