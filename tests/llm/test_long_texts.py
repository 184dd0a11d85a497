"""Texts of 5 MB next to short ones, through every operator that reads texts."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import fingerprint, ngram_join, packing, pii, repeats, toxicity, token_files
from lorekeep.llm.storage import new_folder

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(4)
    letters = rng.integers(97, 123, size=(900_000, 5), dtype=np.uint8)
    letters[:, 4] = np.where(rng.random(900_000) < 0.05, ord("."), letters[:, 4])
    spaced = np.column_stack([letters, np.full(900_000, 32, dtype=np.uint8)])
    text = spaced.tobytes().decode()
    assert len(text) > 5_000_000
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text), (2, long_text[:-600] + "the end is another"), (3, "short text"), (4, None), (5, "mail a.b@c.org")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fingerprints(spark, docs):
    marks = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert fingerprint.likeness(marks[1], marks[2]) > 0.9 > fingerprint.likeness(marks[1], marks[3])
    rows = {r.doc_id: r for r in fingerprint.compare_with_successor(docs).collect()}
    assert rows[1].fingerprint == marks[1] and rows[1].n_chars == 5_400_000


def test_near_groups(docs, long_text):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()}
    words = long_text.split()
    assert rows[1] == (len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}), 1)
    assert rows[2][1] == 1 and rows[3] == (1, 3) and rows[4] == (0, 4)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (5, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())


def test_repeated_passages(docs, long_text):
    rows = {r.doc_id: r for r in repeats.find(docs).collect()}
    shared = len(long_text) - 600
    assert (rows[1].n_bytes, rows[1].n_removed, rows[1].n_spans) == (len(long_text), shared, 1)
    assert (rows[2].n_removed, rows[2].n_spans) == (shared, 1) and rows[3].n_removed == 0


def test_tokens_and_packing(spark, docs, long_text):
    ids = Tokenizer.from_file(BYTE).encode(long_text, add_special_tokens=False).ids
    folder = new_folder(spark, "long")
    token_files.write(docs, folder, BYTE)
    rows = {r.doc_id: r for r in token_files.read_documents(spark, folder).collect()}
    assert rows[1].n_tokens == len(ids) + 1 and rows[4].n_tokens == 1
    pieces = [r for r in packing.pack(docs, BYTE).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == len(ids) + 1 == pieces[0].doc_tokens


def test_personal_data(docs):
    spans = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert spans[5] == ["email"] and spans[3] == []
