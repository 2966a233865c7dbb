"""Generated outputs: their fields, whether they are translations, whether they keep the contract, and what holds allow."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import seems_untranslated
from .udf import arrow

# CJK punctuation, kana, ideographs and Hangul.
CJK = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2F800}-\x{2FA1F}]"
_SHAPE = "title string, publisher_summary string, summary string, key_points array<string>"


def _some(c: Column) -> Column:
    """The text without white space at its ends, null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def payload(task: Column, title: Column, summary: Column, output: Column) -> Column:
    """struct(title, publisher_summary, summary, key_points): fields of the output if it is a JSON object, then the row's own; another output is an old summary."""
    is_object = output.rlike(r"^\s*\{")
    o = F.when(is_object, F.from_json(output, _SHAPE))
    translation, short = task == "translation", task == "summary"
    old = F.when(~is_object, _some(output))
    points = F.filter(F.transform(o["key_points"], _some), lambda p: p.isNotNull())
    return F.struct(
        F.coalesce(_some(o["title"]), _some(title)).alias("title"),
        F.coalesce(_some(o["publisher_summary"]), F.when(translation, F.coalesce(_some(o["summary"]), _some(summary)))).alias("publisher_summary"),
        F.coalesce(_some(o["summary"]), F.when(short, F.coalesce(_some(summary), old))).alias("summary"),
        F.coalesce(points, F.array().cast("array<string>")).alias("key_points"),
    )


def appears_translated(text: Column, language: Column) -> Column:
    """Short texts (10 UTF-16 units) and languages other than Chinese pass; others need CJK script."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.coalesce((units <= 10) | ~language.startswith("zh") | text.rlike(CJK), F.lit(True))


def valid_translation(fields: Column, language: Column) -> Column:
    """Whether a payload has a title or a publisher's summary and none of them is untranslated."""
    t, s = fields["title"], fields["publisher_summary"]
    return (t.isNotNull() | s.isNotNull()) & appears_translated(t, language) & appears_translated(s, language)


def translated_search_text(artifacts: Column) -> Column:
    """Titles and publisher's summaries of the translations in an array of structs (task, title, summary, output)."""
    own = F.filter(artifacts, lambda a: a["task"] == "translation")
    fields = F.transform(own, lambda a: payload(a["task"], a["title"], a["summary"], a["output"]))
    return F.filter(F.flatten(F.transform(fields, lambda p: F.array(p["title"], p["publisher_summary"]))), lambda x: x.isNotNull())


def artifact_untranslated(task: Column, language: Column, fields: Column, title: Column, summary: Column) -> Column:
    """Whether a translation gives back the article's own title or summary."""
    return F.coalesce((task == "translation") & (F.coalesce(seems_untranslated(title, fields["title"], language), F.lit(False)) | F.coalesce(seems_untranslated(summary, fields["publisher_summary"], language), F.lit(False))), F.lit(False))


# Fields of the two contracts with the most characters of their texts (0: not a text); those that may be empty; most key points.
CONTRACTS = {
    "summary": {"language": 32, "limitations": 800, "basis": 0, "key_points": 600, "summary": 2400},
    "translation": {"language": 32, "limitations": 800, "title": 1000, "publisher_summary": 6000},
}
MAY_BE_EMPTY = ("limitations", "publisher_summary")
MOST_POINTS = 6


@arrow("string")
def _composed(s: pa.Array) -> pa.Array:
    """NFC, which Spark has no function for."""
    return pa.array([unicodedata.normalize("NFC", x) if x is not None else None for x in s.to_pylist()], pa.string())


def _cleaned(value: Column) -> Column:
    """A text in NFC without controls but tab and line feed, and without white space at its ends."""
    plain = F.regexp_replace(value, r"[\x00-\x08\x0B-\x1F]", "")
    return F.regexp_replace(plain, r"^[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+$", "")


def _broken(kind: Column, text: Column, name: str, most: int) -> Column:
    """What is wrong with a cleaned text field, or null."""
    out = F.when(F.coalesce(kind, F.lit("")) != "STRING", f"{name} is no text")
    if name not in MAY_BE_EMPTY:
        out = out.when(text == "", f"{name} is empty")
    return out.when(F.length(text) > most, f"{name} is too long")


def checked_output(task: Column, text: Column, language: Column, scope: str = "metadata", fields: Sequence[str] = ("title", "publisher_summary"), empty_summary: bool = False) -> Column:
    """struct(error, readable): what is wrong with an answer by the contract of its task, or its readable text.

    The contract is a table of fields: an answer is a JSON object with exactly those, each a
    text within its limit; key points are a list of at most six texts. language must be the
    one asked for, basis the scope. Of a translation only `fields` may be there; null is the
    empty text for an article without a summary (empty_summary). Errors are named in
    the order of the table. Whether a translation is one is asked by artifact_untranslated().
    """
    v = F.try_parse_json(text)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)
    value = lambda name: _cleaned(_composed(F.when(kind(f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string"))))
    points = F.when(kind("$.key_points") == "ARRAY", F.try_variant_get(v, "$.key_points", "array<variant>"))
    point_kinds = F.transform(points, lambda p: F.regexp_extract(F.schema_of_variant(p), "^[A-Z]+", 0))
    # texts of a list are composed as one string, parted by a control character that cleaning takes out
    listed = F.transform(F.split(_composed(F.array_join(F.transform(points, lambda p: F.replace(F.coalesce(F.try_variant_get(p, "$", "string"), F.lit("")), F.lit("\x00"), F.lit(""))), "\x00")), "\x00"), _cleaned)
    listed = F.when(F.size(points) == 0, F.array().cast("array<string>")).otherwise(listed)

    def wrong(of: str) -> list[Column]:
        names = F.array_sort(F.map_keys(F.from_json(text, "map<string,string>")))
        out = [F.when(~F.coalesce(names == F.array(*map(F.lit, sorted(CONTRACTS[of]))), F.lit(False)), "keys differ from the contract")]
        for name, most in CONTRACTS[of].items():
            if name == "basis":
                out.append(F.when(~F.coalesce(F.try_variant_get(v, "$.basis", "string") == scope, F.lit(False)), "another basis"))
            elif name == "key_points":
                out.append(F.when(points.isNull() | (F.size(points) > MOST_POINTS), "key_points is no list of at most six"))
                out.append(F.when(F.exists(point_kinds, lambda k: k != "STRING"), "key_points is no text").when(F.exists(listed, lambda p: p == ""), "key_points is empty").when(F.exists(listed, lambda p: F.length(p) > most), "key_points is too long"))
            elif of == "translation" and name in ("title", "publisher_summary") and name not in fields:
                out.append(F.when(F.coalesce(kind(f"$.{name}"), F.lit("VOID")) != "VOID", f"{name} was not asked for"))
            else:
                broken = _broken(kind(f"$.{name}"), value(name), name, most)
                if name == "publisher_summary" and empty_summary:
                    broken = F.when(kind("$.publisher_summary") != "VOID", broken)
                out.append(broken)
            if name == "limitations":
                out.append(F.when(value("language") != language, "another language"))
        return out

    error = F.coalesce(
        F.when(v.isNull(), "no JSON"),
        F.when(~F.coalesce(task.isin(*CONTRACTS), F.lit(False)), F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))),
        F.when(~F.coalesce(kind("$") == "OBJECT", F.lit(False)), "keys differ from the contract"),
        *[F.when(task == of, F.coalesce(*wrong(of))) for of in CONTRACTS],
    )
    short = F.array_join(F.concat(F.array(value("summary")), F.transform(listed, lambda p: F.concat(F.lit("• "), p))), "\n")
    whole = F.concat_ws("\n\n", *[F.coalesce(value(n), F.lit("")) for n in ("title", "publisher_summary") if n in fields])
    return F.struct(error.alias("error"), F.when(error.isNull(), F.when(task == "summary", short).otherwise(whole)).alias("readable"))


def paid_retry_authorized(classes: Column) -> Column:
    """Whether there is a paid failure and nothing but those and pending fallbacks."""
    return F.coalesce(F.exists(classes, lambda c: c == "paid_failure") & F.forall(classes, lambda c: c.isin("paid_failure", "fallback_pending")), F.lit(False))


def may_settle(exact: Column, classes: Column, retry_paid: Column) -> Column:
    """Whether a final failure may take the place of a provisional hold: none is ambiguous, and an exact hold is a paid failure that is retried."""
    unclear = F.coalesce(F.exists(classes, lambda c: c == "ambiguous"), F.lit(False))
    return ~unclear & (exact.isNull() | (F.coalesce(retry_paid, F.lit(False)) & (exact == "paid_failure")))


def settled_by_success(hold_class: Column, task: Column, fields: Column, legacy_pair: Column) -> Column:
    """Whether a success clears a hold: one of an old pair only by a translation of both fields, an ambiguous one by any translation."""
    whole = (task == "translation") & (F.array_sort(F.array_distinct(fields)) == F.array(F.lit("publisher_summary"), F.lit("title")))
    own = hold_class.isin("fallback_pending", "paid_failure") | ((task == "translation") & (hold_class == "ambiguous"))
    return F.coalesce(F.when(F.coalesce(legacy_pair, F.lit(False)), whole).otherwise(own), F.lit(False))
