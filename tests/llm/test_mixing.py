from fractions import Fraction
from itertools import islice

import pytest

from lorekeep.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, **{f"s{k}": 1 for k in range(60)}}, {None: 2, "x": 1}])
def test_less_than_one_block_deviation(weights):
    period = max(mixing.MIN_PERIOD, 4 * len(weights))
    quota = mixing.shares(weights, period)
    assert sum(quota.values()) == period
    got = dict.fromkeys(quota, 0)
    for t, (s, k) in enumerate(mixing.schedule(quota), 1):
        assert k == got[s]
        got[s] += 1
        assert all(abs(got[i] * period - t * quota[i]) < period for i in quota)


def test_query_keeps_rows_and_follows_the_schedule(run, texts):
    rows = sorted(run("op8_pfair_mix"), key=lambda r: (r.mix_slot, r.mix_offset))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    blocks = {}
    for r in rows:
        blocks.setdefault(r.mix_slot, []).append(r)
    for members in blocks.values():
        assert len({(m.source, m.mix_block) for m in members}) == 1
        assert [m.mix_offset for m in members] == list(range(len(members)))
    per_source = {}
    for slot in sorted(blocks):
        m = blocks[slot][0]
        assert m.mix_block == per_source.get(m.source, 0)
        per_source[m.source] = m.mix_block + 1


def test_odd_tables(odd_docs, no_docs):
    mixed = mixing.in_mixed_order(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0
    again = mixing.mix(mixing.mix(odd_docs))
    assert again.columns == [*odd_docs.columns, *mixing.PLACES] and again.count() == odd_docs.count()
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.0}, 10)
    with pytest.raises(Exception, match="no weight for source"):
        mixing.mix(odd_docs, {None: 1.0}).collect()


HOT = {"hot": 20.0, **{f"s{k}": 1.0 for k in range(40)}}


@pytest.mark.parametrize("weights", [HOT, {"a": 1000, **{f"s{k}": 1 for k in range(60)}}, {"a": 0.9999, "b": 0.0001}, {f"s{k}": 1 for k in range(20)}, {"a": 2**0.5, "b": 3**0.5, None: 0.1}])
def test_prefixes_of_many_periods_follow_the_weights(weights):
    total, got = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0)
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t, (s, k, slot) in enumerate(islice(mixing.slots(weights, dict.fromkeys(weights, 10**9)), 12 * mixing.MIN_PERIOD)):
        assert slot == t and k == got[s]
        got[s] += 1
        assert t % 7 or all(abs(n - (t + 1) * share[i]) < 1 for i, n in got.items())


def test_sources_that_run_out_leave_the_others_in_proportion():
    weights, blocks = {"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 40, "b": 3000, "c": 1500}
    found = list(mixing.slots(weights, blocks))
    assert [k for s, k, _ in found if s == "b"] == list(range(3000)) and len(found) == 4540
    assert all(k * 10 // weights[s] <= slot < -(-(k + 1) * 10 // weights[s]) for s, k, slot in found)


def test_placed_rows_follow_the_weights_over_the_whole_run(spark):
    df = spark.sql("SELECT id AS doc_id, if(id % 3 = 0, 'hot', concat('s', id % 41)) AS source FROM range(9000)")
    weights = {"hot": 20.5, **{f"s{k}": 1.0 for k in range(41)}}
    slots = {(r.source, r.mix_block, r.mix_slot) for r in mixing.mix(df, weights, block_rows=1).collect()}
    assert len(slots) == 9000 and len({t for *_, t in slots}) == 9000
    for s, k, t in slots:
        assert k * 61.5 // weights[s] <= t < -(-(k + 1) * 61.5 // weights[s])
