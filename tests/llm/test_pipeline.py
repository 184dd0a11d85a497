"""Each stage against its brute-force version, on its own input."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_groups
from test_pii import plainly
from test_tokens import check_pieces, plain

import corpus_pipeline
from lorekeep.llm import pii, toxicity
from lorekeep.llm.storage import staged
from lorekeep.llm.tables import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, kept = table(spark, sf_dir, "documents"), {}
    kept["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = staged(stage(spark, docs, sf_dir), "test")
    return kept


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    assert all(stages[n].columns == stages["input"].columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stages):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(stages["input"], table(spark, sf_dir, "labels"), fold != 0)
    score = lambda t: model.score(*toxicity.evidence(t, toxicity.Remembered(model.evidence_of_token)))
    assert set(rows(stages["toxicity"])) == {i for i, r in rows(stages["input"]).items() if score(r.text) < 0.5}


def test_one_document_of_each_group_stays(stages):
    given = rows(stages["toxicity"])
    expected = {c for _, _, c in brute_groups([(i, r.text) for i, r in sorted(given.items())])}
    kept = rows(stages["near_duplicates"])
    assert set(kept) == expected and all(kept[i] == given[i] for i in kept)


def test_personal_data_is_replaced(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["pii"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plainly(r.text) and r.n_chars == len(r.text)
        if not pii.spans_of(before[i].text, pii.THRESHOLD):
            assert r.text == before[i].text


def test_mixture_keeps_rows_and_spreads_sources(stages):
    assert rows(stages["mixing"]) == rows(stages["pii"])


def test_packed_ids_are_those_of_the_texts(stages):
    ids = plain(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"].collect()
    check_pieces(pieces, {i: [*ids(r.text), 1] for i, r in rows(stages["mixing"]).items()})
    assert all(len(p.ids) == 4 * p.length for p in pieces)


def test_odd_and_empty_tables_pass(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            docs = staged(out, "test")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert Counter(r.doc_id for r in packed.select("doc_id").distinct().collect()) == Counter({r.doc_id for r in docs.collect()})


def test_only_copies_go_from_repeated_and_null_ids(spark, sf_dir):
    long = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(long), " ".join([*long, "end"]), "a text of its own that nobody else has"
    given = [(1, a, "en"), (2, b, "en"), (2, c, "en"), (1, a, "de"), (1, a, "en"), (None, c + " at all times", "en"), (None, "something else again in five words", None)]
    given += [(None, None, "en"), (None, None, "en"), (7, "", "en"), (7, "", "en"), (7, " ", None)]
    df = spark.createDataFrame([(i, t, lang, None, 3) for i, t, lang in given], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.one_of_each_group(spark, df.repartition(3), sf_dir).select("doc_id", "text", "lang").collect()
    expected = Counter(given)
    del expected[(2, b, "en")]
    expected[(1, a, "en")] = 1
    assert Counter(map(tuple, left)) == expected


def test_sequence_ids_follow_the_mixture(spark, sf_dir):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so that the mixture has several files
    try:
        text = "repeat('word ', 150) AS text, NULL AS lang, if(id % 11 = 0, 'b', 'a') AS source, 750L AS n_chars"
        df = spark.sql(f"SELECT id AS doc_id, {text} FROM range(2200)")
        mixed = staged(corpus_pipeline.mix_sources(spark, df, sf_dir), "test")
        assert len(mixed.inputFiles()) > 1
        pieces = corpus_pipeline.pack_sequences(spark, mixed, sf_dir).select("sequence_id", "doc_id").collect()
    finally:
        spark.conf.unset(setting)
    n = max(p.sequence_id for p in pieces)
    share = lambda low, high: (lambda x: sum(x) / len(x))([p.doc_id % 11 == 0 for p in pieces if low * n <= p.sequence_id < high * n])
    # Root weights: b has 0.24 of the mixture until its 200 rows end, after 833 of 2200.
    assert 0.19 < share(0, 0.3) < 0.29 and share(0.5, 0.8) < 0.03
