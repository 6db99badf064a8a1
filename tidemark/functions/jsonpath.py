"""JSON paths over JSON text: parser, evaluator, and predicates as Columns.

Paths of fields and indexes run as built-in VARIANT extraction; slices, wildcards,
recursive descent and filters go through one Arrow-batched UDF.

Predicates are two-valued: NULL, text that is no JSON and missing paths are false.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_COMPARE = re.compile(r"==|!=|<=|>=|=|<|>")


class PathError(ValueError):
    pass


def parse_path(path: str) -> list[tuple]:
    """Steps: ("field", name), ("index", i), ("slice", a, b), ("all",), ("deep", name), ("where", fields, op, value)."""
    if not path.startswith("$"):
        raise PathError(path)
    steps, i = [], 1
    while i < len(path):
        if path.startswith("..", i):
            m = _FIELD.match(path, i + 2)
            if not m:
                raise PathError(path)
            steps.append(("deep", m[0]))
            i = m.end()
        elif path.startswith(".*", i):
            steps.append(("all",))
            i += 2
        elif path[i] == ".":
            m = _FIELD.match(path, i + 1)
            if not m:
                raise PathError(path)
            steps.append(("field", m[0]))
            i = m.end()
        elif path.startswith("[?(", i):
            end = path.find(")]", i)
            if end < 0:
                raise PathError(path)
            steps.append(_condition(path[i + 3 : end], path))
            i = end + 2
        elif path[i] == "[":
            end = path.find("]", i)
            inner = path[i + 1 : end].strip() if end > 0 else ""
            if not inner:
                raise PathError(path)
            if inner == "*":
                steps.append(("all",))
            elif inner[0] in "'\"" and inner[-1] == inner[0] and len(inner) > 1:
                steps.append(("field", inner[1:-1]))
            elif re.fullmatch(r"\d+", inner):
                steps.append(("index", int(inner)))
            elif m := re.fullmatch(r"(\d*)\s*:\s*(\d*)", inner):
                steps.append(("slice", int(m[1] or 0), int(m[2]) if m[2] else None))
            else:
                raise PathError(path)
            i = end + 1
        else:
            raise PathError(path)
    return steps


def _condition(text: str, path: str) -> tuple:
    m = _COMPARE.search(text)
    left = (text[: m.start()] if m else text).strip()
    if not left.startswith("@") or not re.fullmatch(r"@(?:\.[A-Za-z_][A-Za-z0-9_]*)*", left):
        raise PathError(path)
    fields = left[2:].split(".") if len(left) > 1 else []
    if not m:
        return ("where", fields, None, None)
    raw = text[m.end() :].strip()
    if raw[:1] in ("'", '"') and raw[-1:] == raw[:1] and len(raw) > 1:
        value: Any = raw[1:-1]
    elif raw in ("true", "false", "null"):
        value = {"true": True, "false": False, "null": None}[raw]
    elif _NUMBER.fullmatch(raw):
        value = float(raw)
    else:
        raise PathError(path)
    return ("where", fields, "==" if m[0] == "=" else m[0], value)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return type(a) is type(b) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=0, abs_tol=2.0**-52)
    return type(a) is type(b) and a == b


def _compare(a: Any, op: str, b: Any) -> bool:
    if op in ("==", "!="):
        return _same(a, b) == (op == "==")
    number = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    if not number and not (isinstance(a, str) and isinstance(b, str)):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _descend(value: Any, name: str, out: list) -> None:
    if isinstance(value, dict):
        if name in value:
            out.append(value[name])
        for child in value.values():
            _descend(child, name, out)
    elif isinstance(value, list):
        for child in value:
            _descend(child, name, out)


def evaluate(value: Any, steps: list[tuple]) -> list:
    """All values the path leads to, in document order (object members by key)."""
    found = [value]
    for step in steps:
        out: list = []
        for v in found:
            kind = step[0]
            if kind == "field":
                if isinstance(v, dict) and step[1] in v:
                    out.append(v[step[1]])
            elif kind == "index":
                if isinstance(v, list) and step[1] < len(v):
                    out.append(v[step[1]])
            elif kind == "slice":
                if isinstance(v, list):
                    out += v[step[1] : step[2]]
            elif kind == "all":
                out += v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
            elif kind == "deep":
                _descend(v, step[1], out)
            elif isinstance(v, list):
                for item in v:
                    inner = evaluate(item, [("field", f) for f in step[1]])
                    if inner and (step[2] is None or _compare(inner[0], step[2], step[3])):
                        out.append(item)
        found = out
    return found


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _members(pairs: list[tuple[str, Any]]) -> dict:
    """An object with its keys in order; like the built-in parser, one without repeated keys."""
    out = dict(sorted(pairs, key=lambda p: p[0]))
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def load(text: str | None) -> tuple[bool, Any]:
    """(is JSON, value) with object keys in order; what the built-in parser refuses is no JSON here either."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant, object_pairs_hook=_members)
    except (ValueError, RecursionError):
        return False, None


def dump(value: Any) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def simple(steps: list[tuple]) -> str | None:
    """The path for VARIANT extraction, where it has only fields and indexes."""
    out = "$"
    for step in steps:
        if step[0] == "field" and not re.search(r"['\"\\\]]", step[1]):
            out += f"['{step[1]}']"
        elif step[0] == "index":
            out += f"[{step[1]}]"
        else:
            return None
    return out


def query(c: Column, path: str) -> Column:
    """All matches of the path as an array of JSON texts; empty where nothing matches."""
    steps = parse_path(path)

    @F.pandas_udf("array<string>")
    def matches(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ok, value = load(t)
            out.append([dump(v) for v in evaluate(value, steps)] if ok else [])
        return pd.Series(out)

    return matches(c)


def _steps(path: str) -> list[tuple] | None:
    try:
        return parse_path(path)
    except PathError:
        return None


def _first_is(c: Column, steps: list[tuple], test) -> Column:
    """Whether the first match passes; the general, Arrow-batched way."""

    @F.pandas_udf("boolean")
    def first(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ok, value = load(t)
            found = evaluate(value, steps) if ok else []
            out.append(bool(found) and test(found[0]))
        return pd.Series(out, dtype=bool)

    return first(c)


def _variant(c: Column, path: str) -> Column:
    return F.variant_get(F.try_parse_json(c), path, "variant")


def exists(c: Column, path: str) -> Column:
    """Any match; a JSON null exists."""
    steps = _steps(path)
    if steps is None:
        return F.lit(False)
    plain = simple(steps)
    if plain is None:
        return _first_is(c, steps, lambda v: True)
    return F.coalesce(_variant(c, plain).isNotNull(), F.lit(False))


def equals(c: Column, path: str, value: Any) -> Column:
    """The first match equals the scalar; None matches a JSON null."""
    steps = _steps(path)
    if steps is None:
        return F.lit(False)
    plain = simple(steps)
    if plain is None:
        return _first_is(c, steps, lambda v: _same(v, value))
    v = _variant(c, plain)
    kind = F.schema_of_variant(v)
    if value is None:
        found = kind == "VOID"
    elif isinstance(value, bool):
        found = (kind == "BOOLEAN") & F.try_variant_get(v, "$", "boolean").eqNullSafe(F.lit(value))
    elif isinstance(value, (int, float)):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
        found = number & (F.abs(F.try_variant_get(v, "$", "double") - F.lit(float(value))) <= 2.0**-52)
    else:
        found = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(value)))
    return F.coalesce(found, F.lit(False))


def contains(c: Column, path: str, value: Any) -> Column:
    """For text: a substring of the first match's text (composites as JSON text); else as ``equals``."""
    if not isinstance(value, str):
        return equals(c, path, value)
    steps = _steps(path)
    if steps is None:
        return F.lit(False)
    plain = simple(steps)
    if plain is None:
        return _first_is(c, steps, lambda v: value in (v if isinstance(v, str) else dump(v)))
    v = _variant(c, plain)
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.coalesce(F.contains(text, F.lit(value)), F.lit(False))
