"""JSON document operators over JSON text columns.

The result is JSON text with keys in order, NULL where the input is NULL or no JSON.
Members, paths and key tests are built-in VARIANT extractions; containment, concatenation
and deletion, which Spark has no functions for, go through Arrow-batched UDFs.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonpath import _same, dump, load, simple


def _member(v: Column, *steps: str | int) -> Column | None:
    """What a VARIANT has under names and indexes (NULL if nothing, a JSON null if that), or
    None for a name that a built-in path cannot hold."""
    path = simple([("index" if isinstance(s, int) else "field", s) for s in steps])
    return None if path is None or any("?" in s for s in steps if isinstance(s, str)) else F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    """JSON text of a VARIANT; a whole number has no fraction."""
    kind, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    whole = (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (number == F.floor(number)) & (F.abs(number) < 2.0**53)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(F.to_json(v))


def field(c: Column, name: str) -> Column:
    """``->``: a member as JSON text."""
    return at_path(c, name)


def field_text(c: Column, name: str) -> Column:
    """``->>``: a scalar member as plain text; a JSON null is the text null, composites are NULL."""
    v = _member(F.try_parse_json(c), name)
    if v is None:

        def text(x: Any):
            if not isinstance(x, dict) or name not in x or isinstance(x[name], (dict, list)):
                return None
            return x[name] if isinstance(x[name], str) else dump(x[name])

        return _document(c, text)
    kind = F.schema_of_variant(v)
    composite = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(~composite, _text(v))


def at_path(c: Column, *names: str) -> Column:
    """``#>``: nested members as JSON text."""
    v = _member(F.try_parse_json(c), *names)
    if v is not None:
        return _text(v)

    def walk(x: Any):
        for name in names:
            if not isinstance(x, dict) or name not in x:
                return None
            x = x[name]
        return dump(x)

    return _document(c, walk)


def _inside(whole: Any, part: Any) -> bool:
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and _inside(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(_inside(w, p) for w in whole) for p in part)
    return not isinstance(whole, (dict, list)) and _same(whole, part)


def contains(c: Column, other: str | Column) -> Column:
    """``@>``: objects by members, arrays by elements, scalars by equality."""
    return _pairs(c, other, _inside, "boolean")


def contained_by(c: Column, other: str | Column) -> Column:
    """``<@``."""
    return _pairs(c, other, lambda a, b: _inside(b, a), "boolean")


def _has(v: Any, key: str) -> bool:
    if isinstance(v, dict):
        return key in v
    return isinstance(v, list) and key.isascii() and key.isdigit() and int(key) < len(v)


def _has_keys(c: Column, keys: tuple[str, ...], every: bool) -> Column:
    v, found = F.try_parse_json(c), F.lit(every)
    for key in keys:
        own = _member(v, key)
        if own is None or len(key) > 9:
            return _document(c, lambda x: (all if every else any)(_has(x, k) for k in keys), "boolean")
        here = own.isNotNull()
        if key.isascii() and key.isdigit():
            here = here | _member(v, int(key)).isNotNull()
        found = found & here if every else found | here
    return F.when(v.isNotNull(), found)


def has_key(c: Column, key: str) -> Column:
    """``?``: a member, or for arrays an index in range."""
    return _has_keys(c, (key,), True)


def has_any(c: Column, *keys: str) -> Column:
    """``?|``: one of the keys."""
    return _has_keys(c, keys, False)


def has_all(c: Column, *keys: str) -> Column:
    """``?&``: all of the keys."""
    return _has_keys(c, keys, True)


def _joined(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: (b if k in b else a)[k] for k in sorted({*a, *b})}
    if isinstance(a, list):
        return a + (b if isinstance(b, list) else [b])
    return [a, *b] if isinstance(b, list) else a


def concat(c: Column, other: str | Column) -> Column:
    """``||``: objects merge (the right wins), arrays join, scalars append or prepend; else the left stays."""
    return _pairs(c, other, lambda a, b: dump(_joined(a, b)), "string")


def delete_keys(c: Column, *keys: str) -> Column:
    """``-``: without members; anything but an object stays as it is."""
    return _document(c, lambda v: dump({k: x for k, x in v.items() if k not in keys} if isinstance(v, dict) else v))


def delete_index(c: Column, index: int) -> Column:
    """``-``: without an element; out of range or no array: unchanged."""
    return _document(c, lambda v: dump(v[:index] + v[index + 1 :] if isinstance(v, list) and 0 <= index < len(v) else v))


def _document(c: Column, f, kind: str = "string") -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ok, v = load(t)
            out.append(f(v) if ok else None)
        return pd.Series(out, dtype=object)

    return run(c)


def _pairs(c: Column, other: str | Column, f, kind: str) -> Column:
    @F.pandas_udf(kind)
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            (ok, a), (ok_b, b) = load(a), load(b)
            out.append(f(a, b) if ok and ok_b else None)
        return pd.Series(out, dtype=object)

    return run(c, F.lit(other) if isinstance(other, str) else other)
