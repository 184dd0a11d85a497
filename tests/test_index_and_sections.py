"""Content search by way of an index, and the sections of a report by one pass."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import health as H
from lorekeep.operators import issues
from lorekeep.operators import search as X
from lorekeep.operators import sections as S
from lorekeep.registry.queries import QUERIES
from lorekeep.sources import fixtures as fx
from lorekeep.sources.fixtures import AS_OF, RUN

ITEMS = "hit_no INT, title STRING, id STRING, type STRING, owner STRING, modified BIGINT, tags ARRAY<STRING>, url STRING, snippet STRING, description STRING"
TEXTS = ["River bank", "a", "", None, "Straße der Ölmühle", "日本 \U0001f600 map", "aaaa", "x\ny", "100% _sure_", "RIVER " * 2000, "ri ver"]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, t, f"i{k}", "Feature Layer" if k % 2 else "Map", "o", k, ["tag", t] if t and k % 3 == 0 else None, "u", None, "Delta" if k % 4 == 0 else None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return X.write_postings(items, str(tmp_path_factory.mktemp("postings") / "grams"))


@pytest.mark.parametrize("query", ["river", "RIVER", "r", "ri", "er ", "straße", "ölm", "日本", "\U0001f600", "aaa", "aaaaa", "%", "_s", "delta", "a delta", "\ny", "tag", "zzz", "", "ver r", " ", "  ", "river ", " bank", "r b", "der ölm", "delta ", "e der ö", "x y"])
def test_indexed_search_equals_a_scan(items, index, query):
    for kind in (None, "Map"):
        expected = sorted(r.id for r in X.search_items(items, query, kind, None).collect())
        assert sorted(r.id for r in X.search_indexed(items, index, query, kind, None).collect()) == expected


def test_index_lists_an_item_once_per_word(index):
    assert index.groupBy("word", "id").count().filter("count > 1").isEmpty()
    assert index.filter("word LIKE '% %'").isEmpty()


def test_search_reads_the_index_first(items, index):
    """Content is only compared for items that the index names."""
    hits = X.search_indexed(items, index, "new river ban", None, None)
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,river)" in text and "StringEndsWith(word,new)" in text and "StringStartsWith(word,ban)" in text
    assert re.search(r"ReadSchema: struct<word:string,id:string>", text)
    assert re.search(r"Join \[id#\d+\], \[id#\d+\], LeftSemi", text)


def test_empty_index(spark, items, tmp_path):
    none = X.write_postings(items.limit(0), str(tmp_path / "none"))
    assert X.search_indexed(items, none, "river").isEmpty()


def test_postings_are_sorted_in_bounded_runs(items, index):
    """Rows of any number are sorted run by run in memory; nothing of a task's size is sorted by Spark, which would spill."""
    listed = items.select(X.words_held().alias("words"), "id").toArrow().combine_chunks().to_batches()
    expected = sorted((r.word, r.id) for r in X.postings(items).collect())
    assert sorted((r.word, r.id) for r in index.collect()) == expected
    for run_words in (1, 4, 7, 1000):
        found = [(w, i) for b in X.sorted_runs(run_words, 3)(iter([*listed, *listed])) for w, i in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(found) == sorted(expected * 2)
        falls = sum(a > b for a, b in zip(found, found[1:]))
        assert falls <= 2 * len(expected) // run_words + 2 * (run_words < 1000)
    assert all(b.num_rows <= 3 for b in X.sorted_runs(1000, 3)(iter(listed)))
    assert list(X.sorted_runs(5, 3)(iter([]))) == [] and list(X.sorted_runs(5, 3)(iter([listed[0].slice(0, 0)]))) == []


def test_sections_equal_the_single_lists(spark, sf_dir):
    items = fx.catalog_items(spark, sf_dir)
    health = H.classify_probes(fx.probe_results(spark, sf_dir), None, None)
    health = health.unionByName(health.filter("NOT ok"))  # repeated checks are rows each
    rows = S.section_rows(items, health, RUN, AS_OF)
    single = {
        "missing_tags": issues.missing_tags(items),
        "missing_description": issues.missing_description(items),
        "missing_extent": issues.missing_extent(items),
        "stale_items": issues.stale_items(items, AS_OF),
        "broken_services": H.broken_services(items, health, RUN),
        "owner_summary": issues.owner_summary(items, AS_OF, limit=None),
    }
    for name, expected in single.items():
        found = S.section(rows, name)
        assert found.columns == expected.columns
        assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str) != []
    assert S.section(rows, "owner_summary", 3).collect() == issues.owner_summary(items, AS_OF, limit=3).collect()
    assert S.section(rows, "totals").first().total_items == items.count()


def test_one_scan_of_items(spark, sf_dir):
    text = QUERIES["report_one_pass"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet.*orders\.parquet", text)) == 1


def test_sections_of_an_empty_catalog(spark, sf_dir):
    items = fx.catalog_items(spark, sf_dir).limit(0)
    health = H.classify_probes(fx.probe_results(spark, sf_dir), None, None)
    rows = S.section_rows(items, health, RUN, AS_OF)
    assert rows.isEmpty()
    summary = issues.run_summary(S.section(rows, "totals"), health.limit(0), health.limit(0), RUN).first()
    assert list(summary) == [0, 0, 0]


def test_null_owners_and_repeated_items(spark):
    schema = "item_id STRING, title STRING, owner STRING, modified_at TIMESTAMP_NTZ, tags_count INT, has_description BOOLEAN, has_extent BOOLEAN"
    old = dt.datetime(2000, 1, 1)
    items = spark.createDataFrame([("a", "A", None, old, 0, True, True), ("a", "A", None, old, 0, True, True), (None, "N", "o", None, 1, True, True)], schema)
    health = spark.createDataFrame([], "run_id STRING, item_id STRING, ok BOOLEAN, checked_url STRING, status_code INT, error_message STRING")
    rows = S.section_rows(items, health, "r", "2024-06-01 00:00:00")
    assert [tuple(r) for r in S.section(rows, "owner_summary", 9).collect()] == [(None, 2, 2, 0, 2), ("o", 1, 0, 0, 0)]
