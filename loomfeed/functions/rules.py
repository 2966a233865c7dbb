"""Gates for the fields of exchanged rows: each rule names what is wrong with a value, or is null."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import is_canonical_utc
from .text import normalize_language
from .udf import arrow

#: Whole numbers beyond this are no counts.
MOST = 10**15
# What a request's identifiers may hold.
TOKEN, IDEMPOTENCY = r"^[A-Za-z0-9_-]+$", r"^[A-Za-z0-9._:-]{1,200}$"


@arrow("boolean")
def composed(s: pa.Array) -> pa.Array:
    """Whether a text is in NFC."""
    import unicodedata

    return pa.array([x is None or unicodedata.is_normalized("NFC", x) for x in s.to_pylist()], pa.bool_())


def first_error(*rules: Column) -> Column:
    return F.coalesce(*rules)


def text(c: Column, name: str, most: int, empty: bool = False) -> Column:
    """A text in NFC without control characters, of at most so many characters."""
    out = F.when(c.isNull(), f"{name} is no text").when(c.rlike(r"[\x00-\x1F\x7F-\x9F]"), f"{name} has a control character")
    out = out.when((F.length(c) > most) | (F.lit(not empty) & (c == "")), f"{name} has a bad length")
    return out.when(c.rlike(r"[^\x00-\x7F]") & ~composed(c), f"{name} is not composed")


def digest(c: Column, name: str) -> Column:
    return first_error(text(c, name, 64), F.when(~c.rlike("^[0-9a-f]{64}$"), f"{name} is no digest"))


def time(c: Column, name: str) -> Column:
    return first_error(text(c, name, 32), F.when(~is_canonical_utc(c), f"{name} is no time"))


def language(c: Column, name: str) -> Column:
    return first_error(text(c, name, 32), F.when(~normalize_language(c).eqNullSafe(c), f"{name} is no language"))


def whole(c: Column, name: str, least: int = 0, most: int = MOST) -> Column:
    return F.when(c.isNull(), f"{name} is no number").when((c < least) | (c > most), f"{name} is out of range")


def one_of(c: Column, name: str, values: Sequence[str]) -> Column:
    return F.when(~F.coalesce(c.isin(*values), F.lit(False)), f"{name} is unknown")


def filled(c: Column, name: str) -> Column:
    """A text that is not blank and has no NUL."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{name} is empty").when(c.contains("\x00"), f"{name} has a NUL")


def hold_snapshot(key: Column, hold_class: Column, revision: Column) -> Column:
    """What is wrong with a snapshot of a hold."""
    return first_error(F.when(F.coalesce(key, F.lit("")) == "", "key is empty"), one_of(hold_class, "class", ("ambiguous", "paid_failure", "fallback_pending")), whole(revision, "revision", 1))


def provider_request(model: Column, instructions: Column, input_text: Column, effort: Column, schema_name: Column, schema: Column, tokens: Column, idempotency_key: Column) -> Column:
    """What is wrong with a request before it is sent; schema is JSON text."""
    return first_error(
        *[filled(c, n) for c, n in ((model, "model"), (instructions, "instructions"), (input_text, "input_text"), (effort, "reasoning_effort"), (schema_name, "schema_name"))],
        F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json(schema)).startswith("OBJECT"), F.lit(False)), "json_schema is no object"),
        whole(tokens, "max_output_tokens", 1),
        F.when(~F.coalesce(idempotency_key.rlike(IDEMPOTENCY), F.lit(False)), "idempotency_key is not allowed"),
        F.when((F.length(schema_name) > 64) | ~schema_name.rlike(TOKEN), "schema_name is not allowed"),
        F.when((F.length(effort) > 32) | ~effort.rlike(TOKEN), "reasoning_effort is not allowed"),
    )


def violations(df: DataFrame, *rules: Column) -> DataFrame:
    """Rows that break a rule, with the first in the order of rules as `error`."""
    return df.withColumn("error", first_error(*rules)).where("error IS NOT NULL")
