import pickle
import zlib

import duckdb
import numpy as np
import pytest

from lorekeep.llm import toxicity as tx


@pytest.fixture(scope="module")
def log_p(texts):
    counts = np.zeros(tx.CODES**3, dtype=int)
    for text in texts.values():
        c = tx.codes_of(f"  {text}  ").astype(int)
        np.add.at(counts, c[:-2] * tx.CODES**2 + c[1:-1] * tx.CODES + c[2:], 1)
    return tx.Language({k: n for k, n in enumerate(counts) if n}).log_p


def best_by_force(token, log_p):
    """Every path of the lattice."""
    paths, at = [("", 0.0)], 0
    while at < len(token):
        end = at + 1
        while end < len(token) and token[end] == token[at]:
            end += 1
        paths = [(w + o, s - cost) for w, s in paths for o, cost in tx.options(token[at], end - at)]
        at = end

    def total(word, s):
        a = b = tx.END
        for c in [*[tx.CODE.get(c, tx.OTHER) for c in word], tx.END]:
            s += float(log_p[a, b, c])
            a, b = b, c
        return s

    return max(total(*p) for p in paths), {w: total(w, s) for w, s in paths}


@pytest.mark.parametrize("token", ["1d10t", "t-h-e", "thhhe", "7h3", "@nd!!", "a.n.d", "1ng3*", "..", "ß3r"])
def test_viterbi_finds_the_best_path(token, log_p):
    best, all_paths = best_by_force(token, log_p)
    assert all_paths[tx.decode(token, log_p)] == pytest.approx(best, abs=1e-3)


def test_restores_hidden_words(log_p):
    assert "idiot" in tx.words_of("1d10t", log_p) and "trash" in tx.words_of("trrrash,", log_p)
    assert "loser" in {w for t in tx.tokens_of("you l o s e r now") for w in tx.words_of(t, log_p)}
    assert tx.restored_text("plain words, 2024 stay.", log_p) == "plain words, 2024 stay."
    assert tx.restored_text(None, log_p) is None and tx.restored_text("", log_p) == ""


def test_query_on_held_out_rows(spark):
    from lorekeep.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op3_noisy_channel"](spark, sf).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.97


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, None, 1), (1, None, 0), (2, 1, None), (None, 1, 1), (4, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    scored = tx.score(odd_docs, tx.fit(odd_docs, labels))
    assert scored.columns == [*odd_docs.columns, "score"] and all(0 <= r.score <= 1 for r in scored.collect())
    assert tx.score(no_docs, tx.fit(no_docs, labels)).count() == 0
    none = tx.fit(odd_docs, labels.where("false"))
    assert {r.score for r in tx.score(odd_docs, none).collect()} == {0.0}
    only = tx.fit(odd_docs, labels.where("toxic = 1"))
    assert {r.score for r in tx.score(odd_docs, only).collect()} == {1.0}
    assert tx.restore(odd_docs, none).count() == odd_docs.count()


@pytest.mark.parametrize("text", ["iiddiioott", "iidiot", "i d i o t", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "you_are_an_1d10t", "stupid/1d10t", "1d10t"])
def test_every_form_of_a_hidden_word_is_decoded(text, log_p):
    assert "idiot" in {w for t in tx.tokens_of(text) for w in tx.words_of(t, log_p)}


@pytest.mark.parametrize("token", ["455", "8!7(#"])
def test_tokens_of_signs_alone_are_decoded(token, log_p):
    assert tx.words_of(token, log_p) == (tx.decode(token, log_p),) and tx.decode(token, log_p).isalpha()


def test_options_of_a_run_are_made_once(log_p, monkeypatch):
    """Scoring looks up what a run may stand for; it does not make it anew for every token."""
    made, options = [], tx.options
    monkeypatch.setattr(tx, "options", lambda char, times: made.append((char, times)) or options(char, times))
    model = tx.Model(log_p, {"idiot": 3.0, "tras*": 2.5}, (0.0, 1.0, 0.0))
    tokens = [f"{a}1d10{b}" for a in ("", "x", "..", "ttttt") for b in ("t", "ttt", "t###", "tttttt")] + ["trrrash,", "plain"]
    found = [model.evidence_of_token(t) for t in tokens]
    assert found[0] == 3.0 and found[-2] == 2.5 and found[-1] == 0.0
    assert made and len(made) == len(set(made))
    assert len(pickle.dumps(model)) < 2 * log_p.nbytes  # tasks make the tables themselves


@pytest.mark.parametrize("text", ["a b", "a  b", "x y z.", "one a b", "a b c", "é\tü\nö!", "ab c d", ""])
def test_spaced_words_are_joined(text):
    joined = ["".join(m[0].split()) for m in tx.SPACED.finditer(text)]
    assert tx.tokens_of(text) == set(text.split()) | {w for j in joined if not j.isdigit() for w in (j, j[1:])}
