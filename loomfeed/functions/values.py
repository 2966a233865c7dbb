"""Hashes, canonical JSON, sizes, costs, backoff and civil days."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_one

ZONE = "America/Los_Angeles"


def stable_hash(*cols: Column) -> Column:
    """sha256 of the fields joined by the unit separator; null counts as ''."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no ASCII escapes; numbers that are not finite raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def token_estimate(*cols: Column, base: int = 2048) -> Column:
    """A bound on tokens: the bytes of the fields joined by line feeds, plus a constant."""
    return (F.octet_length(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in cols))) + base).cast("long")


def approximate_tokens(s: Column) -> Column:
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def cost_micros(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Millionths of a dollar at prices in dollars per million tokens, rounded up."""
    return F.ceil(tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)).cast("long")


def backoff_seconds(attempts: Column) -> Column:
    """60, 120, ... up to 60 * 2**8 seconds, six hours at most."""
    return F.least(F.lit(21600), F.lit(60) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(8)))).cast("long")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def civil_day(ts: Column, zone: str = ZONE) -> Column:
    """The date of a UTC timestamp in the zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_bounds(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC start and end of a civil day; days of 23 and 25 hours included."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def month_bounds(ts: Column, zone: str = ZONE) -> tuple[Column, Column]:
    month = F.trunc(civil_day(ts, zone), "month")
    return F.to_utc_timestamp(month.cast("timestamp"), zone), F.to_utc_timestamp(F.add_months(month, 1).cast("timestamp"), zone)


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def parse_when(s: Column, now: Column) -> Column:
    """A UTC timestamp from ISO, RFC 2822 or month-name dates; a date without a year is the latest not over 7 days ahead."""
    iso = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"))
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/M/d")
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, "^[A-Za-z]{3}, ", ""), " (GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss xx"))
    full = F.coalesce(iso, mail, *(F.try_to_timestamp(s, F.lit(f)) for f in forms))
    year = F.year(now).cast("string")

    def short(y: Column) -> Column:
        return F.coalesce(*(F.try_to_timestamp(F.concat(s, F.lit(", "), y), F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy")))

    this = short(year)
    return F.coalesce(full, F.when(this > now + F.expr("INTERVAL 7 DAYS"), short((F.year(now) - 1).cast("string"))).otherwise(this))


def clamp(n: int, low: int = 1, high: int = 1000) -> int:
    return max(low, min(n, high))


# Date forms with and without a year.
DATED = ("%B %d, %Y", "%b %d, %Y", "%Y-%m-%d", "%Y/%m/%d")
UNDATED = ("%B %d", "%b %d")


def parse_date(s: str | None, now: datetime | None = None) -> str | None:
    """UTC time to the second as ISO text, of mail dates, ISO and the forms above; without a year the latest not over 7 days ahead; null if none fits."""
    s = clean_one(s) if s else None
    if not s:
        return None
    now = now or datetime.now(UTC)

    def undated(form: str) -> datetime:
        got = datetime.strptime(f"{s} {now.year}", f"{form} %Y").replace(tzinfo=UTC)
        return got.replace(year=now.year - 1) if got > now + timedelta(days=7) else got

    readers = [parsedate_to_datetime, lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")), *(lambda x, f=f: datetime.strptime(x, f) for f in DATED), *(lambda _, f=f: undated(f) for f in UNDATED)]
    for read in readers:
        try:
            got = read(s)
        except (TypeError, ValueError, OverflowError):
            continue
        got = got if got.tzinfo else got.replace(tzinfo=UTC)
        return got.astimezone(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    return None


def parse_dates(now: datetime | None = None):
    """A column function of parse_date()."""

    def run(s: pa.Array) -> pa.Array:
        return pa.array([parse_date(x, now) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")
