"""Strict JSON bundles: bounded size, no repeated keys, no non-finite numbers, hash-bound."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.values import canonical_json

MAX_BYTES = 25 * 1024 * 1024


class BadBundle(ValueError):
    """The file is not a bundle that may be read."""


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise BadBundle("repeated key")
    return out


def _constant(name):
    raise BadBundle(f"number {name}")


def load_strict(path: str, limit: int = MAX_BYTES):
    """The JSON value of a driver-side file."""
    if os.path.islink(path):
        raise BadBundle("symbolic link")
    with open(path, "rb") as f:
        raw = f.read(limit + 1)
    if len(raw) > limit:
        raise BadBundle("too large")
    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_constant)
    except UnicodeDecodeError as e:
        raise BadBundle("not UTF-8") from e
    except json.JSONDecodeError as e:
        raise BadBundle(str(e)) from e


def sealed(bundle: dict) -> dict:
    """The bundle with the hash of the rest of it."""
    body = {k: v for k, v in bundle.items() if k != "sha256"}
    return body | {"sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def check_seal(bundle: dict, keys: set[str]) -> dict:
    if set(bundle) != keys | {"sha256"}:
        raise BadBundle("keys")
    if sealed(bundle) != bundle:
        raise BadBundle("hash")
    return bundle


def write_atomic(path: str, bundle: dict, limit: int = MAX_BYTES) -> None:
    """Write to a temporary file beside the target, then rename."""
    raw = canonical_json(bundle).encode()
    if len(raw) > limit:
        raise BadBundle("too large")
    if os.path.islink(path):
        raise BadBundle("symbolic link")
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def export_tables(frames: dict[str, tuple[DataFrame, list[str]]], path: str, limit: int = 100_000) -> dict:
    """A sealed bundle of small tables, each sorted by its keys; more than `limit` rows are an error."""
    out: dict = {"version": 1}
    for name, (df, order) in frames.items():
        rows = df.orderBy(*order).limit(limit + 1).collect()  # bounded by the limit
        if len(rows) > limit:
            raise BadBundle(f"{name}: more than {limit} rows")
        out[name] = [{k: (v if v is None or isinstance(v, (bool, int, str)) else str(v)) for k, v in r.asDict().items()} for r in rows]
    out = sealed(out)
    write_atomic(path, out)
    return out


def import_tables(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    bundle = check_seal(load_strict(path), {"version", *schemas})
    return {name: spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in bundle[name]], schema) for name, schema in schemas.items()}
