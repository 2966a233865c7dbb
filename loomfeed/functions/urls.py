"""URL functions: canonical form, hosts and shape predicates."""

from __future__ import annotations

from html import unescape
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

# Query keys that identify a campaign or referrer, not a page.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
TRACKING_PREFIX = "utm_"


def canonical(raw: str | None, base: str = "") -> str | None:
    """The canonical form of one URL; None without a host.

    Joined to base, scheme and host in lower case, without user, default port, fragment
    and tracking keys; slashes of the path collapsed, none at its end but for the root;
    remaining query keys in their order, blank values kept.
    """
    if raw is None:
        return None
    try:
        p = urlsplit(urljoin(base, unescape(raw.strip())))
        host, port = p.hostname, p.port
    except ValueError:
        return None
    if not host:
        return None
    scheme = (p.scheme or "https").lower()
    if port and (scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    path = "/".join(["", *(s for s in p.path.split("/") if s)])
    if p.path.endswith("/") and not path:
        path = "/"
    keep = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith(TRACKING_PREFIX)]
    return urlunsplit((scheme, host, path or "/", "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in keep), ""))


@arrow("string")
def canonical_url(raw: pa.Array) -> pa.Array:
    """canonical() over a column; for any input."""
    return pa.array([canonical(x) for x in raw.to_pylist()], pa.string())


def canonical_url_sql(url: Column) -> Column:
    """The same for absolute http(s) URLs without user, port, entities or escapes in the query: built-in functions only."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    drop = "(?i)^(" + "|".join([*TRACKING, TRACKING_PREFIX + "[^=]*"]) + ")(=|$)"
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(drop))
    query = F.array_join(pairs, "&")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def host_key(url: Column) -> Column:
    """The lower-case host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != "")


def one_slug_below(url: Column, section: Column | str, reserved: tuple[str, ...] = ()) -> Column:
    """True for exactly one path segment below the section, unless it is a reserved word."""
    seg = path_segments(url)
    section = F.lit(section) if isinstance(section, str) else section
    return (F.size(seg) == 2) & (F.try_element_at(seg, F.lit(1)) == section) & ~F.coalesce(F.try_element_at(seg, F.lit(2)).isin(*reserved) if reserved else F.lit(False), F.lit(False))


def under_prefix(url: Column, prefix: str) -> Column:
    """The path is the prefix or continues it at a segment border."""
    path = F.concat(F.lit("/"), F.array_join(path_segments(url), "/"))
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")
