"""Canonical JSON of nested values: sorted keys, no spaces, one spelling of each number; digests and rewrites of it.

Values are walked as they are parsed, in Arrow batches; keys are compared by code points, texts
are escaped only where JSON must, numbers keep integers whole and write others in the
shortest form that reads back the same. What is not strict JSON - a repeated key, NaN,
Infinity, a lone surrogate, text after the value - gives null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deeper values are refused rather than run out of stack.
DEPTH = 200


class _Strict(ValueError):
    pass


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Strict("repeated key")
    return out


def _refuse(name: str):
    raise _Strict(name)


def parse_strict(text: str | None):
    """(value, its canonical text) of strict JSON text, else None."""
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_refuse)
        if depth(value) > DEPTH:
            return None
        form = canonical(value)
        return None if form is None else (value, form)
    except (ValueError, TypeError, RecursionError):
        return None


def depth(value) -> int:
    """0 of a plain value, else 1 more than the deepest part; level by level, so that no stack grows."""
    level, n = [value], 0
    while level := [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())] or [None] * any(isinstance(v, dict | list) for v in level):
        n += 1
    return n


def canonical(value) -> str | None:
    try:
        out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        out.encode()
        return out
    except ValueError:
        return None


def _each(column: Column, make: Callable, kind: str = "string") -> Column:
    def run(s: pa.Array) -> pa.Array:
        out = []
        for x in s.to_pylist():
            got = parse_strict(x) if x is not None else None
            out.append(make(*got) if got else None)
        return pa.array(out, pa.string() if kind == "string" else pa.int64())

    return F.arrow_udf(run, kind)(column)


def canonical_text(column: Column) -> Column:
    """The canonical JSON of JSON text; null for null and for what is not strict JSON."""
    return _each(column, lambda _, text: text)


def value_digest(column: Column) -> Column:
    """sha256 of a JSON value: of a string its text, of any other value its canonical JSON."""

    return _each(column, lambda value, text: hashlib.sha256((value if isinstance(value, str) else text).encode()).hexdigest())


def replaced(column: Column, key: str, by: Column) -> Column:
    """Canonical JSON with the value of every member `key`, at any depth, replaced by the JSON text `by`; members inside a replaced value go with it."""

    def run(texts: pa.Array, new: pa.Array) -> pa.Array:
        def put(value, new):
            if isinstance(value, dict):
                return {k: new if k == key else put(v, new) for k, v in value.items()}
            return [put(v, new) for v in value] if isinstance(value, list) else value

        out = []
        for t, n in zip(texts.to_pylist(), new.to_pylist(), strict=True):
            a, b = parse_strict(t) if t is not None else None, parse_strict(n) if n is not None else None
            out.append(canonical(put(a[0], b[0])) if a and b else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(column, by)


def portable(column: Column, key: str, name: str, identities: Column) -> Column:
    """Canonical JSON in which local ids give way to identities: every object, at any depth, loses its member `key` and, where that is a whole number, gets `name` with the identity (JSON text) that the map column has for it. Null if one has none."""

    def run(texts: pa.Array, maps: pa.Array) -> pa.Array:
        def put(value, known: dict):
            if isinstance(value, dict):
                out = {k: put(v, known) for k, v in value.items() if k != key}
                if isinstance(i := value.get(key), int) and not isinstance(i, bool):
                    out[name] = known[i]
                return out
            return [put(v, known) for v in value] if isinstance(value, list) else value

        out = []
        for t, m in zip(texts.to_pylist(), maps.to_pylist(), strict=True):
            got = parse_strict(t) if t is not None else None
            try:
                out.append(canonical(put(got[0], {k: parse_strict(v)[0] for k, v in m or []})) if got else None)
            except (KeyError, TypeError):  # an id or identity that is not known
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(column, identities)


def without_own_hash(column: Column, field: str) -> Column:
    """sha256 of the canonical JSON of an object without its member `field`, as bundles hash themselves; null for other values."""

    def digest(value, _: str) -> str | None:
        return hashlib.sha256(canonical({k: v for k, v in value.items() if k != field}).encode()).hexdigest() if isinstance(value, dict) else None

    return _each(column, digest)


def members(column: Column) -> Column:
    """The names of all members of a JSON value, at any depth, each once, in order, joined by commas."""

    def names(value, _: str) -> str:
        found, level = set(), [value]
        while level:
            found.update(k for v in level if isinstance(v, dict) for k in v)
            level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        return ",".join(sorted(found))

    return _each(column, names)
