"""NULL rules, patterns and arithmetic, alone and under NOT and OR."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.predicates import java_pattern
from tidemark.plans.expr import Call, call, col, lit
from .fixtures import SAILORS, crew, ids


@pytest.fixture(scope="module")
def db(spark):
    return crew(spark)


def found(db, test):
    return ids(db.select("id").from_("sailors").where(test).exec())


PORT, YEARS, PAY = col("port"), col("years"), col("pay")
#: A condition, and what it means for a row's port (None where it has none), years and pay.
CASES = [
    (PORT.eq("Lisboa"), lambda p, y, m: p == "Lisboa"),
    (~PORT.eq("Lisboa"), lambda p, y, m: p is not None and p != "Lisboa"),
    (PORT.ne("Lisboa"), lambda p, y, m: p is not None and p != "Lisboa"),
    (PORT.is_null(), lambda p, y, m: p is None),
    (PORT.is_not_null(), lambda p, y, m: p is not None),
    (PORT.in_(["Lisboa", None]), lambda p, y, m: p in ("Lisboa", None)),
    (PORT.in_([]), lambda p, y, m: False),
    (PORT.not_in(["Lisboa"]), lambda p, y, m: p != "Lisboa"),
    (~PORT.in_(["Lisboa"]), lambda p, y, m: p != "Lisboa"),
    (~PORT.not_in(["Lisboa"]), lambda p, y, m: p == "Lisboa"),
    (PORT.like("B%"), lambda p, y, m: p in ("Bergen", "Bremen")),
    (PORT.like("_orto"), lambda p, y, m: p == "Porto"),
    (PORT.not_like("B%"), lambda p, y, m: p not in ("Bergen", "Bremen")),
    (~PORT.like("B%"), lambda p, y, m: p not in ("Bergen", "Bremen")),
    (PORT.match("e.*en"), lambda p, y, m: p in ("Bergen", "Bremen")),
    (PORT.not_match("^B"), lambda p, y, m: p not in ("Bergen", "Bremen")),
    (PORT.match("("), lambda p, y, m: False),
    (PORT.not_match("("), lambda p, y, m: True),
    (PORT.between("Bo", "Lz"), lambda p, y, m: p in ("Bremen", "Lisboa")),
    (PORT.not_between("Bo", "Lz"), lambda p, y, m: p not in ("Bremen", "Lisboa")),
    (~PORT.between("Bo", "Lz"), lambda p, y, m: p not in ("Bremen", "Lisboa")),
    (PORT.eq(None), lambda p, y, m: False),
    (PORT.eq("Lisboa") | PORT.eq(None), lambda p, y, m: p == "Lisboa"),
    (PORT.not_in(["Lisboa"]) & YEARS.gt(9), lambda p, y, m: p != "Lisboa" and y > 9),
    (PORT.gt("C") | YEARS.eq(4), lambda p, y, m: (p or "") > "C" or y == 4),
    (lit(True), lambda p, y, m: True),
    (YEARS.between(None, 9), lambda p, y, m: y <= 9),
    (PAY.gte(20.5) & PAY.lte(31.5), lambda p, y, m: 20.5 <= m <= 31.5),
]


@pytest.mark.parametrize("test,holds", CASES, ids=range(len(CASES)))
def test_filters(db, test, holds):
    assert found(db, test) == [i for i, _, years, _, pay, port in SAILORS if holds(port, years, pay)]


def test_where_calls_are_joined(db):
    assert ids(db.select("id").from_("sailors").where(YEARS.lt(10)).where(col("ashore").eq(True)).exec()) == [2, 6, 8]


@pytest.mark.parametrize(
    "pattern,text,expected",
    [
        ("a.c", "xa\ncx", True),
        ("^ab", "cab", False),
        ("a^b", "a^b", True),
        ("ab$", "ab\n", False),
        ("a$b", "a$b", True),
        ("a{2}", "a{2}", True),
        ("a{2}", "aa", False),
        ("(ab)+c", "ababc", True),
        ("a|b", "xb", True),
        (r"\d+", "a1", True),
        (r"\w", "é", False),
        (r"[a-c\d]x", "2x", True),
        ("[^a]", "a", False),
        ("[]a]", "]", True),
        (r"\.", "a", False),
    ],
)
def test_patterns(spark, pattern, text, expected):
    assert spark.range(1).select(F.lit(text).rlike(java_pattern(pattern))).first()[0] is expected


@pytest.mark.parametrize("pattern", ["(", ")", "*a", "a**", "[a", "\\"])
def test_invalid_patterns(pattern):
    assert java_pattern(pattern) is None


def test_like_has_no_escape(spark):
    from tidemark.functions import predicates

    row = spark.range(1).select(predicates.like(F.lit("a\\b"), "a\\%"), predicates.like(F.lit("a%"), "a\\%")).first()
    assert tuple(row) == (True, False)


def value(db, expression):
    return db.select((expression, "v")).from_("sailors").where(col("id").eq(1)).exec()[0]["v"]


LOW = YEARS - 2147483647 - 100  # the least integer, by overflow


@pytest.mark.parametrize(
    "expression,expected",
    [
        (YEARS + 1, 13),
        (YEARS - 30, -18),
        (YEARS * 2, 24),
        ((YEARS - 19) / 2, -3),
        (YEARS / 0, None),
        (YEARS % 7, 5),
        ((YEARS - 17) % 3, -2),
        (YEARS % 0, None),
        (PAY / 0, None),
        (PAY % 2, None),
        (YEARS * 2147483647, 2147483647),
        (YEARS * -2147483647, -2147483648),
        (YEARS + 2147483647, 2147483647),
        (LOW, -2147483648),
        (LOW / -1, 2147483647),
        (-LOW, 2147483647),
        (call("ABS", LOW), 2147483647),
        (call("ABS", col("name")), None),
        (col("id") * 9223372036854775807 * 3, 9223372036854775807),
        (col("id") / YEARS * 24, 2.0),
        (YEARS + 0.5, 12.5),
        (YEARS / 2.5, 4.8),
        (-YEARS, -12),
        (col("name") + 1, None),
        (-col("name"), None),
        (call("abs", YEARS - 30), 18),
        (call("UPPER", col("name")), "INES"),
        (call("lower", col("name")), "ines"),
        (call("LENGTH", lit("é")), 2),
        (call("coalesce", lit(None), PORT, "x"), "Lisboa"),
    ],
)
def test_scalars(db, expression, expected):
    assert value(db, expression) == expected


@pytest.mark.parametrize("name", ["nope", "JSONB_NOPE"])
def test_unknown_function(db, name):
    with pytest.raises(ValueError):
        value(db, Call(name, ()))
