import duckdb
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "one two three four five",
    "one two three four five",
    "Ünïcode ß 日本語 \U0001f600 text",
    "word " * 3000,
    "mail a.b@c.org, ip 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567.",
    "x" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, extra columns with clashing names."""
    rows = [(k if k != 3 else None, t, None if k % 2 else "en", None if k % 3 == 0 else "src0", None) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (4, "another text with the same id", "en", None, 3), (None, None, None, None, None)]
    extra = "shard int, spans string, block int, ids string, component_id string"
    return spark.createDataFrame([(*r, 1, "s", 2, "i", "c") for r in rows], f"{DOCS}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="session")
def run(spark, sf_dir):
    from lorekeep.llm.queries import QUERIES

    return lambda name: QUERIES[name](spark, sf_dir).collect()
