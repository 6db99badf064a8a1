import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonb, jsonpath
from tidemark.plans.expr import call, col
from .fixtures import charts, ids


@pytest.fixture(scope="module")
def db(spark):
    return charts(spark)


NOTES = col("notes")


@pytest.mark.parametrize(
    "test,expected",
    [
        (NOTES.get("$.scale").eq("fine"), [1, 3]),
        (~NOTES.get("$.scale").eq("fine"), [2, 4, 5]),
        (NOTES.get("$.drawn.by").eq("Noor"), [1]),
        (NOTES.get("$.drawn").eq(None), [3]),
        (NOTES.get("$.drawn").exists(), [1, 2, 3]),
        (NOTES.get("$.drawn.by").exists(), [1, 2]),
        (NOTES.get("$.kinds[0]").eq("routes"), [2]),
        (NOTES.get("$['scale']").contains("in"), [1, 3]),
        (NOTES.get("$.kinds").contains("wre"), [1, 3]),
        (NOTES.get("$.kinds[*]").eq("walls"), [3]),
        (NOTES.get("$.kinds[1:]").eq("wrecks"), [1, 3]),
        (NOTES.get("$..by").eq("Iker"), [2]),
        (NOTES.get("$.nope").eq(None), []),
        (NOTES.get("$.kinds[-1]").exists(), []),
        (NOTES.get("$.scale").eq("fine") & NOTES.get("$.drawn.by").exists(), [1]),
        (call("JSONB_PATH_EQ", NOTES, "$.scale", "coarse"), [2]),
        (call("jsonb_exists", NOTES, "$.drawn.by"), [1, 2]),
        (call("jsonb_contains", NOTES, "$.scale", "oars"), [2]),
    ],
)
def test_paths(db, test, expected):
    assert ids(db.select("id").from_("charts").where(test).exec()) == expected


@pytest.mark.parametrize("value,text,expected", [(1, '{"a":1}', True), (1, '{"a":1.0}', True), (1, '{"a":"1"}', False), ("1", '{"a":1}', False), (True, '{"a":true}', True), (True, '{"a":1}', False), (1, '{"a":[1]}', False), (2.5, '{"a":2.5}', True)])
def test_scalars_compare_by_type(spark, value, text, expected):
    for path in ("$.a", "$..a"):
        assert spark.createDataFrame([(text,)], "t string").select(jsonpath.equals(F.col("t"), path, value)).first()[0] is expected


@pytest.mark.parametrize("path", ["a", "$.", "$[", "$[?(@.a ~ 1)]", "$[-1]", "$[x]"])
def test_invalid_paths_match_nothing(spark, path):
    row = spark.createDataFrame([('{"a":1}',)], "t string").select(jsonpath.exists(F.col("t"), path), jsonpath.equals(F.col("t"), path, 1)).first()
    assert tuple(row) == (False, False)


def test_evaluator():
    doc = json.loads('{"a":[{"n":1,"t":"x"},{"n":5},{"t":null}],"n":9}')
    run = lambda p: jsonpath.evaluate(doc, jsonpath.parse_path(p))
    assert run("$.a[?(@.n > 1)]") == [{"n": 5}]
    assert run("$.a[?(@.t)].n") == [1]
    assert run("$.a[?(@.t = null)]") == [{"t": None}]
    assert run("$.a[0:2].n") == [1, 5]
    assert sorted(run("$..n")) == [1, 5, 9]
    assert run("$.*")[1] == 9


OPS = [
    (lambda c: jsonb.field(c, "a"), '{"a":{"c":1,"b":2}}', '{"b":2,"c":1}'),
    (lambda c: jsonb.field_text(c, "a"), '{"a":null}', "null"),
    (lambda c: jsonb.field_text(c, "a"), '{"a":[1]}', None),
    (lambda c: jsonb.at_path(c, "a", "b"), '{"a":{"b":3}}', "3"),
    (lambda c: jsonb.contains(c, '{"a":[2]}'), '{"a":[1,2],"b":0}', True),
    (lambda c: jsonb.contained_by(c, "[1,2]"), "[2]", True),
    (lambda c: jsonb.has_key(c, "1"), "[5,6]", True),
    (lambda c: jsonb.has_key(c, "2"), "[5,6]", False),
    (lambda c: jsonb.has_any(c, "x", "a"), '{"a":1}', True),
    (lambda c: jsonb.has_all(c, "x", "a"), '{"a":1}', False),
    (lambda c: jsonb.concat(c, '{"a":2}'), '{"b":1,"a":1}', '{"a":2,"b":1}'),
    (lambda c: jsonb.concat(c, "3"), "[1]", "[1,3]"),
    (lambda c: jsonb.concat(c, "[3]"), "1", "[1,3]"),
    (lambda c: jsonb.concat(c, "2"), "1", "1"),
    (lambda c: jsonb.delete_keys(c, "a"), '{"a":1,"b":2}', '{"b":2}'),
    (lambda c: jsonb.delete_index(c, 5), "[1]", "[1]"),
    (lambda c: jsonb.delete_index(c, 0), "[1,2]", "[2]"),
    (lambda c: jsonb.field(c, "a"), "nonsense", None),
    (lambda c: jsonb.field(c, "a"), '{"a":null}', "null"),
    (lambda c: jsonb.field(c, "a"), '{"a":2.0}', "2"),
    (lambda c: jsonb.field(c, "a"), '{"a":2.5}', "2.5"),
    (lambda c: jsonb.field(c, "a"), '{"a":"x\\"y"}', '"x\\"y"'),
    (lambda c: jsonb.field(c, "a"), '{"a":NaN}', None),
    (lambda c: jsonb.field(c, "a"), "[1]", None),
    (lambda c: jsonb.field(c, "it's ?"), '{"it\'s ?":1}', "1"),
    (lambda c: jsonb.field_text(c, "a"), '{"a":"x\\"y"}', 'x"y'),
    (lambda c: jsonb.field_text(c, "a"), '{"a":true}', "true"),
    (lambda c: jsonb.field_text(c, "a"), '{"a":7.0}', "7"),
    (lambda c: jsonb.field_text(c, "b"), '{"a":1}', None),
    (lambda c: jsonb.at_path(c, "a", "b"), '{"a":1}', None),
    (lambda c: jsonb.has_key(c, "1"), '{"1":null}', True),
    (lambda c: jsonb.has_key(c, "a"), '"a"', False),
    (lambda c: jsonb.has_key(c, "it's"), '{"it\'s":1}', True),
    (lambda c: jsonb.has_any(c), "{}", False),
    (lambda c: jsonb.has_all(c, "a", "b"), '{"a":1,"b":null}', True),
    (lambda c: jsonb.contains(c, "1"), "Infinity", None),
    (lambda c: jsonb.delete_keys(c, "a"), '{"a":1,"a":2}', None),
    (lambda c: jsonb.has_key(c, "a"), None, None),
]


@pytest.mark.parametrize("make,text,expected", OPS, ids=range(len(OPS)))
def test_operators(spark, make, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0] == expected
