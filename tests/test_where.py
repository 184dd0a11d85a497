"""Users' predicates: what is accepted, what is refused, and that nothing refused is evaluated."""

import pytest

from lorekeep.functions.where import PredicateRefused, checked, refusal
from lorekeep.operators import layers as L
from lorekeep.operators import normalize as N

SCHEMA = "item_id STRING, name STRING, n INT, price DECIMAL(10,2), at TIMESTAMP_NTZ, ok BOOLEAN, tags ARRAY<STRING>, `odd name` INT"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([], SCHEMA)


ACCEPTED = [
    "1=1", "true", "ok", "NOT ok", "n = 1", "n <> 1", "n != 1", "n >= -1 AND n < +2 OR n <=> NULL", "n IN (1, 2, 3)", "n NOT IN (1)",
    "name LIKE 'a%'", "name NOT LIKE 'a\\_%' ESCAPE '\\\\'", "name ILIKE 'A%'", "n BETWEEN 1 AND 3", "n NOT BETWEEN 1 AND 3", "name IS NULL",
    "name IS NOT NULL", "ok IS NULL", "n + 1 - 2 * 3 / 4 % 5 > 0", "upper(name) = 'A'", "lower(trim(name)) = 'a'", "length(name) > 3",
    "substring(name, 1, 2) = 'ab'", "substr(name, 2) = 'b'", "trim(BOTH 'x' FROM name) = ''", "abs(n) > 1", "round(price, 1) > 1", "floor(price) = 1", "ceil(price) = 1",
    "coalesce(name, '') = ''", "name || 'x' = 'yx'", "concat(name, 'x') = 'x'", "price > 1.5", "at > TIMESTAMP_NTZ '2024-01-01 00:00:00'",
    "at >= '2024-01-01'", "CAST(n AS STRING) = '1'", "`odd name` = 1", "nullif(n, 0) = 1", "ifnull(n, 0) = 0", "NAME = 'x'", "n = 1 -- and so on",
]

REFUSED = {
    "reflect('java.lang.System', 'getProperty', 'user.home') = '/root'": "function reflect",
    "java_method('java.lang.Runtime', 'getRuntime') IS NULL": "function java_method",
    "REFLECT('a', 'b') IS NULL": "function reflect",
    "try_reflect('java.lang.System', 'getProperty', 'x') IS NULL": "function try_reflect",
    "n = 1 OR upper(reflect('java.lang.System', 'lineSeparator')) = 'X'": "function reflect",
    "schema_of_json(reflect('java.lang.System', 'getProperty', 'x')) = ''": "function schema_of_json",
    "system.builtin.reflect('a', 'b') = 'c'": "function system.builtin.reflect",
    "n IN (SELECT 1)": "subqueries",
    "(SELECT 1) = 1": "subqueries",
    "EXISTS (SELECT 1)": "subqueries",
    "n > (SELECT max(n) FROM range(3))": "subqueries",
    "exists(tags, t -> t = 'x')": "function exists",
    "transform(tags, t -> t) IS NULL": "function transform",
    "rand() > 0.5": "function rand",
    "uuid() = 'x'": "function uuid",
    "current_user() = 'x'": "function current_user",
    "current_date() > at": "function current_date",
    "count(*) > 1": "function count",
    "sum(n) OVER () > 1": "not allowed",
    "explode(tags) = 'x'": "function explode",
    "input_file_name() = ''": "function input_file_name",
    "secret = 1": "column secret is not known",
    "item_id.x = 1": "not",
    "tags[0] = 'x'": "not allowed",
    "n": "not true or false",
    "name || 'x'": "not true or false",
    "n = ": "cannot be read",
    "": "cannot be read",
    "n = 1; DROP TABLE x": "cannot be read",
    "n = 1) OR (1 = 1": "cannot be read",
    "tags = 1": "does not fit",
    "name RLIKE '(a+)+$'": "not allowed",
    ":p = 1": "not allowed",
    "CASE WHEN ok THEN true END": "not allowed",
}


@pytest.mark.parametrize("where", ACCEPTED)
def test_accepted(frame, where):
    assert refusal(frame, where) is None
    assert frame.filter(checked(frame, where)).isEmpty()


@pytest.mark.parametrize("where", list(REFUSED))
def test_refused(frame, where):
    assert REFUSED[where] in refusal(frame, where)
    with pytest.raises(PredicateRefused):
        checked(frame, where)


def test_refused_constants_are_not_evaluated(spark, frame):
    """Analysing some functions evaluates their arguments, so the text is refused before that."""
    spark._jvm.java.lang.System.clearProperty("lorekeep.seen")
    call = "reflect('java.lang.System', 'setProperty', 'lorekeep.seen', 'yes')"
    for where in (f"{call} = 'x'", f"from_json('1', {call}) IS NULL", f"schema_of_json({call}) = ''", f"{call} = 'x' AND false"):
        assert "not allowed" in refusal(frame, where)
    assert spark._jvm.java.lang.System.getProperty("lorekeep.seen") is None


def test_columns_can_be_restricted(frame):
    assert refusal(frame, "n = 1", ["n", "name"]) is None
    assert refusal(frame, "price > 1", ["n", "name"]) == "column price is not known"


def test_operators_check_their_predicates(spark):
    features = spark.createDataFrame([], "item_id STRING, layer_kind STRING, layer_index INT, feature_id INT, geometry STRING, measure DOUBLE")
    known = spark.createDataFrame([], "item_id STRING, item_type STRING, layer_kind STRING, layer_index INT, layer_name STRING, geometry_type STRING, error STRING")
    targets = spark.createDataFrame([], "reference STRING, kind STRING, service_url STRING, layer_index INT, resolved_id STRING")
    bad = "reflect('java.lang.System', 'lineSeparator') = 'x'"
    for use in (
        lambda: L.row_counts(features, known, bad),
        lambda: L.preview_features(features, bad),
        lambda: L.preview_status(features, known, targets, bad),
        lambda: N.scan_items(features, bad),
    ):
        with pytest.raises(PredicateRefused, match="reflect"):
            use()


def test_predicate_counts_of_one_kind_only(spark):
    features = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", None)], "item_id STRING, n INT")
    rows = L.predicate_counts(features, ["n > 1"]).collect()
    assert sorted((r.item_id, r.matching, r.accepted, r.reason) for r in rows) == [("a", 1, True, None), ("b", 1, True, None)]
    (row,) = L.predicate_counts(features, ["rand() > 0"]).collect()
    assert (row.where_no, row.accepted, row.reason, row.item_id, row.matching) == (0, False, "function rand is not allowed", None, None)
