"""Scalar functions and arithmetic that never raises.

Integer operations stay integers and go to the nearest bound where they overflow; a
division by zero is NULL; integer division cuts towards zero; a remainder needs integers
of one width; operations on two widths are on doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGERS = ("int", "bigint")
NUMBERS = (*INTEGERS, "double", "float")
BOUNDS = {"int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


def bound(kind: str, top: bool) -> Column:
    return F.lit(BOUNDS[kind][top]).cast(kind)


def _saturated(exact: Column, down: Column, kind: str, *operands: Column) -> Column:
    """``exact``, which is NULL on overflow; then the bound on that side, if no operand is NULL."""
    known = operands[0].isNotNull()
    for c in operands[1:]:
        known = known & c.isNotNull()
    return F.coalesce(exact, F.when(known, F.when(down, bound(kind, False)).otherwise(bound(kind, True))))


def arithmetic(op: str, left: Column, right: Column, left_type: str, right_type: str) -> tuple[Column, str]:
    """(column, Spark type) of ``left op right``; the types are Spark's simple names."""
    if left_type not in NUMBERS or right_type not in NUMBERS:
        return F.lit(None).cast("double"), "double"
    same = left_type == right_type and left_type in INTEGERS
    kind = left_type if same else "double"
    if op == "%":
        return (F.try_mod(left, right), kind) if same else (F.lit(None).cast("double"), "double")
    if not same:
        left, right = left.cast("double"), right.cast("double")
    if op == "/":
        return (_div(left, right, kind), kind) if same else (F.try_divide(left, right), kind)
    made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](left, right)
    if not same:
        return made, kind
    down = (left < 0) != (right < 0) if op == "*" else left < 0
    return _saturated(made, down, kind, left, right), kind


def _div(left: Column, right: Column, kind: str) -> Column:
    """Integer division; the least integer by -1 is the only one that overflows."""
    over = (left == bound(kind, False)) & (right == -1)
    divisor = F.when(over, F.lit(None)).otherwise(F.nullif(right, F.lit(0))).cast("bigint")
    return F.when(over, bound(kind, True)).otherwise(F.call_function("div", left.cast("bigint"), divisor).cast(kind))


def negate(c: Column, kind: str) -> Column:
    return F.when(c == bound(kind, False), bound(kind, True)).otherwise(F.try_subtract(F.lit(0).cast(kind), c)) if kind in INTEGERS else -c


def absolute(c: Column, kind: str) -> Column:
    if kind not in NUMBERS:
        return F.lit(None).cast("double")
    return F.when(c < 0, negate(c, kind)).otherwise(c) if kind in INTEGERS else F.abs(c)


def fitted(c: Column, kind: str, wanted: str) -> Column:
    """A value as a column of another type takes it: numbers go to the nearest bound and are
    cut towards zero, what cannot be read is NULL."""
    if kind == wanted:
        return c
    if wanted in INTEGERS and kind in NUMBERS:
        low, high = BOUNDS[wanted]
        if kind in ("double", "float"):  # NaN is no number: 0
            inside = F.when(F.isnan(c), F.lit(0)).when((c > low) & (c < high), c).otherwise(F.lit(None))
            return F.coalesce(inside.cast(wanted), F.when(c <= low, bound(wanted, False)).when(c >= high, bound(wanted, True)))
        return F.when(c < low, bound(wanted, False)).when(c > high, bound(wanted, True)).otherwise(c.try_cast(wanted))
    return c.try_cast(wanted)


#: Names are looked up without regard to case. Each makes a column of the arguments and their types.
FUNCTIONS: dict[str, tuple[Callable[[list[Column], list[str]], Column], Callable[[list[str]], str]]] = {
    "ABS": (lambda c, t: absolute(c[0], t[0]), lambda t: t[0] if t[0] in NUMBERS else "double"),
    "UPPER": (lambda c, t: F.upper(c[0]), lambda t: "string"),
    "LOWER": (lambda c, t: F.lower(c[0]), lambda t: "string"),
    "LENGTH": (lambda c, t: F.octet_length(c[0]), lambda t: "int"),  # bytes, not characters
    "COALESCE": (lambda c, t: F.coalesce(*c), lambda t: t[0]),
}


def function(name: str):
    try:
        return FUNCTIONS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown function {name}") from None
