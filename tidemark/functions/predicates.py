"""Predicates whose NULL rules differ from SQL's, as Column expressions.

BETWEEN, IN, LIKE and pattern matches are two-valued here: a NULL operand makes them
false and their negations true. Comparisons, AND, OR and NOT stay three-valued.
"""

from __future__ import annotations

import re
import warnings
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_null(value: Any) -> bool:
    return value is None


def between(c: Column, low: Any, high: Any) -> Column:
    """low <= c <= high, false where c is NULL. A NULL low bound lies below everything, a NULL high bound below every value."""
    if _is_null(high):
        return F.lit(False)
    upper = c <= high
    return F.coalesce(upper if _is_null(low) else (c >= low) & upper, F.lit(False))


def not_between(c: Column, low: Any, high: Any) -> Column:
    return ~between(c, low, high)


def in_list(c: Column, values: list) -> Column:
    """Membership, where a NULL element matches NULL."""
    known = [v for v in values if not _is_null(v)]
    found = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return found | c.isNull() if len(known) < len(values) else found


def not_in_list(c: Column, values: list) -> Column:
    return ~in_list(c, values)


def like(c: Column, pattern: str) -> Column:
    """% and _ only; a backslash stands for itself."""
    return F.coalesce(c.like(pattern.replace("\\", "\\\\")), F.lit(False))


def not_like(c: Column, pattern: str) -> Column:
    return ~like(c, pattern)


def java_pattern(pattern: str) -> str | None:
    """The small pattern language as a java.util.regex pattern; None if it is invalid.

    Known: literals, ``.`` (any character), ``* + ?``, groups, ``|``, classes with ranges,
    ``\\d \\w \\s`` (ASCII) and their negations. ``^`` anchors only as the first character
    and ``$`` only as the last; braces and anchors elsewhere are literals."""
    out, i, depth, n = ["(?s)"], 0, 0, len(pattern)
    atom = False  # something a quantifier could bind to
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                return None
            e = pattern[i + 1]
            control = {"n": "\\n", "t": "\\t", "r": "\\r"}
            out.append(f"\\{e}" if e in "dDwWsS" else control.get(e) or re.escape(e))
            i, atom = i + 2, True
            continue
        if c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            body = ["[^" if end > i + 1 else "["]
            first = True
            while end < n and (pattern[end] != "]" or first):
                if pattern[end] == "\\":
                    if end + 1 == n:
                        return None
                    e = pattern[end + 1]
                    body.append(f"\\{e}" if e in "dDwWsSntr" else f"\\{e}" if not e.isalnum() else e)
                    end += 1
                elif pattern[end] == "-":
                    body.append("-" if not first and end + 1 < n and pattern[end + 1] != "]" else "\\-")
                else:
                    body.append(f"\\{pattern[end]}" if pattern[end] in "[]&^~" else pattern[end])
                end, first = end + 1, False
            if end >= n:
                return None
            out.append("".join(body) + "]")
            i, atom = end + 1, True
            continue
        if c in "*+?":
            if not atom:
                return None
            out.append(c)
            atom = False  # a quantifier on a quantifier is an error
        elif c == "(":
            depth += 1
            out.append("(?:")
            atom = False
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
            out.append(")")
            atom = True
        elif c == "|":
            out.append("|")
            atom = False
        elif c == "^" and i == 0:
            out.append("\\A")
            atom = False
        elif c == "$" and i == n - 1:
            out.append("\\z")
            atom = False
        elif c == ".":
            out.append(".")
            atom = True
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
            atom = True
        i += 1
    if depth:
        return None
    translated = "".join(out)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(translated.replace("\\z", "\\Z"))
    except re.error:
        return None
    return translated


def matches(c: Column, pattern: str) -> Column:
    """Unanchored search; an invalid pattern matches nothing."""
    translated = java_pattern(pattern)
    return F.lit(False) if translated is None else F.coalesce(c.rlike(translated), F.lit(False))


def not_matches(c: Column, pattern: str) -> Column:
    return ~matches(c, pattern)
