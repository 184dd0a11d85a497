import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from checksums import crc_of
from tokenizers import Tokenizer

from lorekeep.llm import packing, token_files
from lorekeep.llm.storage import new_folder
from lorekeep.llm.tokens import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path, texts):
    rng = random.Random(5)
    letters = "ab 'sS.\n  \t1é́Σß,!​"
    odd = ["", " ", "a  b", "don't I'M", "x<|endoftext|>y", "a <|startoftext|> b", "x <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", " <|endoftext|>. b", "a<|endoftext| >b", "İstanbul ΣΑΣ", "日本語 テキスト", "\tfoo\r\nbar", "ª µ º"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    mine, whole = PieceEncoder(path), plain(path)
    for text in [*odd, *list(texts.values())[:40]]:
        assert mine.ids(text).tolist() == whole(text)


def test_arrow_sequences_query(run, texts):
    rows = {r.doc_id: r for r in run("op7_arrow_sequences")}
    ids, start = plain(WORD), 0
    for i, text in sorted(texts.items()):
        expected = [*ids(text), 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(expected), crc_of(expected))
        start += len(expected)


def test_files_have_equal_sequences_and_masks(spark, odd_docs, no_docs, texts):
    folder = new_folder(spark, "test")
    rows = token_files.write(odd_docs, folder, WORD, length=8).collect()
    assert sum(r.documents for r in rows) == odd_docs.count()
    for r in rows:
        tokens = token_files.open_stream(folder, f"tokens-{r.block:06d}.arrows")
        found = [token_files.sequence(tokens, i) for i in range(r.sequences)]
        assert all(len(ids) == len(mask) == 8 for ids, mask in found)
        assert sum(mask.sum() for _, mask in found) == r.tokens
        assert all(not ids[~mask].any() for ids, mask in found)
        first = tokens.column("ids").chunk(0).values.to_numpy(zero_copy_only=True)
        assert np.shares_memory(found[0][0], first)
    back = token_files.read_documents(spark, folder).collect()
    assert sorted(r.n_tokens for r in back) == sorted(len(plain(WORD)(r.text)) + 1 for r in odd_docs.collect())
    empty = new_folder(spark, "test")
    token_files.write(no_docs, empty, WORD)
    assert token_files.read_documents(spark, empty).count() == 0


def check_pieces(rows, expected):
    """Every id in one piece, sequences gapless and within the capacity."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(expected)
    for i, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(expected[i])
            assert p.ids_crc32 == crc_of(expected[i][at : at + p.length])
            at += p.length
        assert at == len(expected[i])
    padded = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.CAPACITY
        padded += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert sorted(seqs) == list(range(len(seqs)))
    return padded / sum(map(len, expected.values()))


def test_packing_query(run, texts):
    ids = plain(BYTE)
    assert check_pieces(run("op10_harmonic_packing"), {i: [*ids(t), 1] for i, t in texts.items()}) < 0.02


def test_packing_odd_tables(spark, odd_docs, no_docs):
    assert packing.pack(no_docs, BYTE).count() == 0
    rows = packing.pack(odd_docs, BYTE, with_ids=True)
    held = packing.sequences(rows).collect()
    total = sum(len(plain(BYTE)(r.text)) + 1 for r in odd_docs.collect())
    assert sum(len(r.ids) for r in held) == 4 * total and max(len(r.ids) for r in held) <= 4 * packing.CAPACITY
    distinct = odd_docs.where("doc_id IS NOT NULL AND NOT text <=> 'another text with the same id'").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(distinct, BYTE).collect(), {r.doc_id: [*plain(BYTE)(r.text), 1] for r in distinct.collect()})


def test_classes():
    for n in range(1, packing.CAPACITY + 1):
        pieces = packing.cut(n, packing.CAPACITY)
        assert sum(k for k, _ in pieces) == n
        assert all(k <= w and (w - k) * packing.EMPTY_SHARE <= w for k, w in pieces)
