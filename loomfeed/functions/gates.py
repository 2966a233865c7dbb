"""Checks and keys of URLs, times, holds and answers; built-in expressions but for hosts and charsets."""

from __future__ import annotations

import codecs
import ipaddress
from email.message import Message
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow
from .urls import host_key
from .values import ZONE

_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
# What stays unescaped in links, besides letters, digits and ".-_~"; slugs of sections that are no articles.
LINK_SAFE = ":/?#[]@!$&'()*+,;=%"
RESERVED_SLUGS = ("blog", "category", "news", "page", "tag", "topic")


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", "")


def percent_quoted(s: Column, safe: str = LINK_SAFE) -> Column:
    """The text with the UTF-8 bytes of all other characters as %XX: the built-in encoding, undone for what is safe, the percent sign last."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    keep = set(safe) | {"~"}
    for c in sorted(keep - {"%"}) + (["%"] if "%" in keep else []):
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out if "*" in keep else F.replace(out, F.lit("*"), F.lit("%2A"))


def safe_http_url(url: Column) -> Column:
    """The URL, percent-encoded where needed, without white space at its ends; '' for null, with any control character, another scheme, a user or password, or no host."""
    u = _bare(url)
    server = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)
    named = server.rlike(r"^(?::?@)?(?:\[[0-9A-Fa-f:.]+\]|[^\[\]@:]+)(?::[^@\[\]]*)?$")
    ok = ~u.rlike(r"[\x00-\x1F\x7F-\x9F]") & u.rlike(r"(?i)^https?://") & named
    return F.when(F.coalesce(ok, F.lit(False)), percent_quoted(u)).otherwise("")


def host_form_one(host: str | None) -> str | None:
    """A host as addresses and names are compared: IP addresses in their shortest form, names in lower-case ASCII, without a last dot; None if it is neither."""
    host = (host or "").rstrip(".")
    try:
        return str(ipaddress.ip_address(host))
    except ValueError:
        pass
    try:
        return (host.encode("idna").decode().lower() or None) if ":" not in host and "%" not in host else None
    except UnicodeError:
        return None


@arrow("string")
def host_form(host: pa.Array) -> pa.Array:
    """A column function of host_form_one()."""
    return pa.array([host_form_one(h) for h in host.to_pylist()], pa.string())


def allowed_host(value: Column) -> Column:
    """The form of a bare host from a list of allowed ones; null for anything with a path, port, user or zone."""
    v = F.regexp_replace(_bare(value), r"\.+$", "")
    v = F.when(v.rlike(r"^\[.*\]$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.when((v != "") & ~v.rlike(r"[/?#@\[\]\x00]"), host_form(v))


@arrow("boolean")
def public_address(address: pa.Array) -> pa.Array:
    """Whether an IP address is one of the public internet; that of an IPv4 address in IPv6 counts. Null for what is no address."""

    def one(a: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address(a.split("%")[0])
        except (ValueError, AttributeError):
            return None
        return (getattr(ip, "ipv4_mapped", None) or ip).is_global

    return pa.array([one(a) for a in address.to_pylist()], pa.bool_())


def fetch_url(url: Column) -> Column:
    """The form in which a page is fetched: http or https, host_form(), no port, no fragment, a path; null with control characters, a user, a zone, another port or no host."""
    u = F.regexp_replace(url, r"^ +", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    server = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    six = F.regexp_extract(server, r"^\[([0-9A-Fa-f:.]+)\](?::\d*)?$", 1)
    name = F.regexp_extract(server, r"^([^:\[\]@%]+)(?::\d*)?$", 1)
    port = F.nullif(F.regexp_extract(server, r":(\d+)$", 1), F.lit("")).try_cast("long")
    port = F.when(server.rlike(r"^\[[^\]]*\]$"), F.lit(None)).otherwise(port)
    form = host_form(F.when(six != "", F.when(six.contains(":"), six)).otherwise(name))
    form = F.when(form.contains(":"), F.concat(F.lit("["), form, F.lit("]"))).otherwise(form)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1)
    usual = F.when(scheme == "https", 443).when(scheme == "http", 80)
    ok = ~url.rlike(r"[\x00-\x1F]") & usual.isNotNull() & (port.isNull() | (port == 0) | (port == usual)) & form.isNotNull()
    return F.when(ok, F.concat(scheme, F.lit("://"), form, F.when(path == "", "/").otherwise(path), query))


def _segments(url: Column) -> Column:
    """Path segments that are not empty, percent-decoded before they are parted; escapes that are none stay."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "/"), lambda x: x != "")


def article_below(url: Column, prefix: Column) -> Column:
    """Whether a URL is one slug directly below the section's prefix: same host but for www., and no slug that names a section."""
    have, root = _segments(url), _segments(prefix)
    slug = F.lower(_bare(F.try_element_at(have, F.lit(-1))))
    ok = url.rlike(r"(?i)^https?://") & (host_key(url) == host_key(prefix)) & (F.size(have) == F.size(root) + 1) & (F.slice(have, F.lit(1), F.size(root)) == root) & (slug != "") & ~slug.isin(*RESERVED_SLUGS)
    return F.coalesce(ok, F.lit(False))


def section_root(url: Column, prefix: Column) -> Column:
    """Whether a URL is the section itself, but for www. and slashes at its end."""
    path = lambda c: F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    ok = url.rlike(r"(?i)^https?://") & (host_key(url) == host_key(prefix)) & (path(url) == path(prefix)) & ~url.rlike("[?#].")
    return F.coalesce(ok & (F.coalesce(prefix, F.lit("")) != ""), F.lit(False))


def import_allowed(url: Column, prefix: Column, hosts: Column) -> Column:
    """A source with a prefix takes its articles (article_below); one without takes URLs of its hosts, an array, www. aside."""
    own = F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))
    host = host_key(url)
    return F.when(F.coalesce(prefix, F.lit("")) != "", article_below(url, prefix)).otherwise(F.coalesce((host != "") & F.array_contains(own, host), F.lit(False)))


def english_url(url: Column, languages: list[str]) -> Column:
    """A URL without a language as its first path segment."""
    return F.regexp_replace(url, rf"^(https?://[^/]+)/(?:{'|'.join(languages)})(?=/|$)", "$1")


def is_canonical_utc(s: Column) -> Column:
    """Whether a text is a real time in the form yyyy-MM-ddTHH:mm:ssZ."""
    t = F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") == s, F.lit(False))


def due(last: Column, now: Column, hours: int) -> Column:
    """Whether the last time is missing or at least so many hours ago, to the microsecond."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last) >= hours * 3_600_000_000, F.lit(True))


def idempotency_key(job: Column, attempt: Column, key: Column) -> Column:
    return F.concat(F.lit("ar-"), job.cast("string"), F.lit("-g"), attempt.cast("string"), F.lit("-"), F.substring(key, 1, 20))


def tuple_key(*cols: Column) -> Column:
    """sha256 of the JSON list of texts; null counts as null."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array(*(F.coalesce(F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r'(["\\\\])', r"\\$1"), F.lit('"')), F.lit("null")) for c in cols)), ","), F.lit("]")), 256)


def portable_identity(source: Column, external: Column, url: Column, content: Column) -> Column:
    """What names an article on any machine."""
    return F.struct(source.alias("source"), external.alias("external_id"), url.alias("url"), content.alias("content_hash"))


def local_date(ts: Column, language: Column, zone: str = ZONE) -> Column:
    """The civil date of a time as readers of the language write it."""
    t = F.from_utc_timestamp(ts, zone)
    return F.when(language == "zh-CN", F.date_format(t, "yyyy年M月d日")).otherwise(F.date_format(t, "MMM d, yyyy"))


def first_artifact(artifacts: Column, task: str, language: str) -> Column:
    """The first element of an array of structs (task, language, ...) that is of the task and language, or null."""
    return F.get(F.filter(artifacts, lambda a: (a["task"] == task) & (a["language"] == language)), F.lit(0))


def search_text(*fields: Column) -> Column:
    """The fields that are not blank, joined by a space, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*(F.nullif(F.trim(f), F.lit("")) for f in fields)), lambda x: x.isNotNull()), " "))


def all_paid(classes: Column) -> Column:
    """Whether there are holds and all are paid failures."""
    return (F.size(classes) > 0) & F.forall(classes, lambda c: c == "paid_failure")


def matches_any_prefix(key: Column, known: Column, length: int = 12) -> Column:
    """Whether the first characters of a key are those of one of the known keys."""
    return F.exists(known, lambda k: F.substring(k, 1, length) == F.substring(key, 1, length))


def _at(answer: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(answer, path, kind)


def _kind(answer: Column, path: str) -> Column:
    """STRING, OBJECT, ARRAY, ... of the value at a path; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(_at(answer, path, "variant")), "^[A-Z]+", 0)


def _given(answer: Column, path: str) -> Column:
    """Whether a value is there and neither null, '', [] nor {}."""
    text = F.to_json(_at(answer, path, "variant"))
    return F.coalesce(~text.isin("null", '""', "[]", "{}"), F.lit(False))


def _spoken(answer: Column, path: str) -> Column:
    return F.coalesce((_kind(answer, path) == "STRING") & (_bare(_at(answer, path)) != ""), F.lit(False))


def completion_code(answer: Column, policy: Column, models: list[str], errors: list[str]) -> Column:
    """Why a chat completion (JSON text) cannot be used, or ok. Rules in order, the first that holds gives the code.

    policy: a code found before, or null. An error beside the choices is provider_error; one
    inside the only choice, if it is well formed and of a known type (`errors`), is that type.
    Then response_id, response_model (not one of `models`), response_object,
    response_choices (not one), response_choice; then a refusal, whatever the finish;
    finish_<reason> or finish_reason, response_message, response_role, tool_calls,
    thinking_output, thinking_tokens and no_output. JSON that cannot be read is response_json.
    """
    v = F.try_parse_json(answer)
    n = F.size(_at(v, "$.choices", "array<variant>"))
    one, message = "$.choices[0]", "$.choices[0].message"
    inner = F.exists(F.slice(F.coalesce(_at(v, "$.choices", "array<variant>"), F.array().cast("array<variant>")), 1, 8), lambda c: F.coalesce(~F.to_json(F.try_variant_get(c, "$.error", "variant")).isin("null", '""', "[]", "{}"), F.lit(False)))
    index, finish = _at(v, f"{one}.index", "long"), F.coalesce(_at(v, f"{one}.finish_reason"), F.lit(""))
    formed = (n == 1) & (F.coalesce(index, F.lit(0)) == 0) & (finish == "error") & (_kind(v, f"{one}.error") == "OBJECT")
    named = F.lower(_bare(_at(v, f"{one}.error.metadata.error_type")))
    typed = F.when(formed & named.isin(*errors), named).otherwise("provider_error")
    hit = lambda c: F.coalesce(c, F.lit(False))
    refused = F.coalesce(_kind(v, f"{message}.refusal"), F.lit("VOID"))
    rules = [
        (v.isNull(), F.lit("response_json")),
        (F.coalesce(policy, F.lit("")) != "", policy),
        (_given(v, "$.error"), F.lit("provider_error")),
        (inner, typed),
        (F.coalesce(_bare(_at(v, "$.id")), F.lit("")) == "", F.lit("response_id")),
        (~hit(_at(v, "$.model").isin(*models)), F.lit("response_model")),
        (~hit(_at(v, "$.object") == "chat.completion"), F.lit("response_object")),
        (~hit((_kind(v, "$.choices") == "ARRAY") & (n == 1)), F.lit("response_choices")),
        (~hit((_kind(v, one) == "OBJECT") & (index == 0)), F.lit("response_choice")),
        (hit(_kind(v, message) == "OBJECT") & (refused != "VOID") & ((refused != "STRING") | _spoken(v, f"{message}.refusal")), F.lit("refusal")),
        (finish != "stop", F.when(finish == "", "finish_reason").otherwise(F.concat(F.lit("finish_"), finish))),
        (~hit(_kind(v, message) == "OBJECT"), F.lit("response_message")),
        (~hit(_at(v, f"{message}.role") == "assistant"), F.lit("response_role")),
        (hit(~F.to_json(_at(v, f"{message}.tool_calls", "variant")).isin("null", "[]")), F.lit("tool_calls")),
        (_spoken(v, f"{message}.reasoning_content") | _spoken(v, f"{message}.reasoning"), F.lit("thinking_output")),
        (hit(~F.to_json(_at(v, f"{message}.reasoning_details", "variant")).isin("null", "[]", '""')), F.lit("thinking_output")),
        (hit(_at(v, "$.usage.completion_tokens_details.reasoning_tokens", "long") > 0), F.lit("thinking_tokens")),
        (~_spoken(v, f"{message}.content"), F.lit("no_output")),
    ]
    return F.coalesce(*[F.when(cond, code) for cond, code in rules], F.lit("ok"))


def redacted(s: Column, limit: int = 240) -> Column:
    """An error text for logs: tokens and keys masked, one line, at most limit characters."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?i)(bearer\s+|api[_-]?key[=:]\s*|sk-)[A-Za-z0-9._-]+", "$1***")
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, limit)


def retry_after(value: Column, most: int = 86_400) -> Column:
    """Whole seconds of a Retry-After header, at most `most`; null for anything else."""
    return F.when(F.trim(value).rlike(r"^\d{1,9}$"), F.least(F.trim(value).cast("long"), F.lit(most).cast("long")))


class _Declared(HTMLParser):
    """The first charset that a meta element declares, by its own attribute or in a content type."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and self.found is None:
            a = dict(attrs)
            self.found = a.get("charset") or (_parameter(a.get("content")) if (a.get("http-equiv") or "").lower() == "content-type" else None)


def _parameter(content_type: str | None) -> str | None:
    """The charset parameter of a content type."""
    if not content_type:
        return None
    m = Message()
    m["content-type"] = content_type
    return m.get_content_charset()


def charset_one(header: str | None, body: bytes | None) -> str:
    """The charset of a page: of its header, else its byte order mark, else a meta element in its first 4096 bytes; utf-8 if none is known."""
    body = body or b""
    declared = _Declared()
    declared.feed(body[:4096].decode("latin-1"))
    mark = next((name for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")) if body.startswith(bom)), None)
    for name in (_parameter(header), mark, declared.found):
        try:
            if name:
                return codecs.lookup(name.strip()).name
        except LookupError:
            continue
    return "utf-8"


@arrow("string")
def charset(header: pa.Array, body: pa.Array) -> pa.Array:
    """A column function of charset_one()."""
    return pa.array([charset_one(h, b) for h, b in zip(header.to_pylist(), body.to_pylist(), strict=True)], pa.string())
