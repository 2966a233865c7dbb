"""Text functions: control characters, white space, tags, cuts, escapes and scripts."""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
_CONTROL_ALL = r"[\x00-\x1F\x7F-\x9F]"


def strip_controls(s: Column, keep_white: bool = True) -> Column:
    """A space for each control character; tab, line feed and carriage return stay on request."""
    return F.regexp_replace(s, _CONTROL if keep_white else _CONTROL_ALL, " ")


def collapse(s: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def output_text(s: Column) -> Column:
    """Null as '', controls and white space cleaned."""
    return collapse(strip_controls(F.coalesce(s, F.lit("")), keep_white=False))


def capped(s: Column, limit: int) -> Column:
    """At most limit characters of a collapsed text; a cut text ends with an ellipsis."""
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit(ELLIPSIS))).otherwise(s)


def markdown_escape(s: Column) -> Column:
    """A backslash before every ASCII punctuation character."""
    return F.regexp_replace(s, r"([!-/:-@\[-`{-~])", r"\\$1")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []

    def handle_data(self, data: str) -> None:
        self.runs.append(data)


def clean_one(s: str | None, limit: int | None = None, punctuation: bool = False) -> str:
    """Entities decoded, tags stripped, controls and white space cleaned, cut at the limit; null is empty."""
    if s is None:
        return ""
    p = _Text()
    p.feed(unescape(s))
    p.close()
    out = " ".join(re.sub(_CONTROL_ALL, " ", " ".join(p.runs)).split())
    if punctuation:
        out = re.sub(r"\s+([,.;:!?])", r"\1", out)
    return out[: limit - 1].rstrip() + ELLIPSIS if limit and len(out) > limit else out


def clean_text(limit: int | None = None, punctuation: bool = False):
    """A column function of clean_one()."""

    def run(s: pa.Array) -> pa.Array:
        return pa.array([clean_one(x, limit, punctuation) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def normalize_content(s: str) -> str:
    """NFC, one kind of line break, single spaces of any white space or control, at most one empty line."""
    s = re.sub("\r\n?|[\u2028\u2029]", "\n", unicodedata.normalize("NFC", s))
    s = re.sub(r"(?:[^\S\n]|[\x00-\x09\x0B-\x1F\x7F-\x9F])+", " ", s)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", s)).strip()


# Where a text may be cut.
CUTS = ("\n\n", "\n", " ", "。", "！", "？", ". ", "! ", "? ")


def truncate_one(s: str, limit: int) -> tuple[str, bool]:
    """At most `limit` characters with an ellipsis: cut at the last border of any kind that lies in the second half; a sentence keeps its mark."""
    if limit < 1:
        raise ValueError("limit")
    if len(s) <= limit:
        return s, False
    head = whole = s[: limit - 1]
    at = max(head.rfind(m) for m in CUTS)
    if at >= max(1, len(head) // 2):
        head = head[: at + (head[at] in ".!?。！？")]
    return (head.rstrip() or whole) + ELLIPSIS, True


def truncate_content(limit: int):
    """A column function of normalize_content() and truncate_one(): struct(text, truncated)."""
    kind = pa.struct([("text", pa.string()), ("truncated", pa.bool_())])

    def run(s: pa.Array) -> pa.Array:
        rows = [None if x is None else truncate_one(normalize_content(x), limit) for x in s.to_pylist()]
        return pa.array([None if r is None else {"text": r[0], "truncated": r[1]} for r in rows], kind)

    return F.arrow_udf(run, "struct<text:string,truncated:boolean>")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(s: Column, pattern: str) -> Column:
    """LIKE '%pattern%' that folds ASCII case only; % and _ in the pattern are wildcards."""
    return ascii_lower(s).like("%" + pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%")


def has_ideograph(s: Column) -> Column:
    return s.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]")


def seems_untranslated(source: Column, output: Column, language: Column) -> Column:
    """For Chinese targets: an output that repeats a source without ideographs, or has none itself and is over 10 characters."""
    same = F.lower(collapse(source)) == F.lower(collapse(output))
    return language.startswith("zh") & ~has_ideograph(source) & (same | (~has_ideograph(output) & (F.length(F.trim(output)) > 10)))


# Names of the supported languages.
LANGUAGE_ALIASES = {"en": "en", "en-us": "en", "en-gb": "en", "english": "en", "zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "zh-hans-cn": "zh-CN", "chinese": "zh-CN", "simplified-chinese": "zh-CN"}


def normalize_language(s: Column, strict: bool = True) -> Column:
    """The language of an alias, English for null and blank; of other names null, or English if not strict."""
    aliases = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    known = F.try_element_at(aliases, F.lower(F.replace(F.trim(s), F.lit("_"), F.lit("-"))))
    blank = F.coalesce(F.trim(s), F.lit("")) == ""
    return F.when(blank, "en").otherwise(known if strict else F.coalesce(known, F.lit("en")))


def resolve_language(option: Column, environment: Column, configured: Column) -> Column:
    """The first given of option, environment and configuration, as a language; English if none is."""
    given = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (option, environment, configured)))
    return normalize_language(given)
