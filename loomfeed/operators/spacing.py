"""When requests go out if each host is asked at most once in a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def spaced(requests: DataFrame, host: str, at: str, tie: str, gap: Column | int) -> DataFrame:
    """requests with start: a host's requests go in the order of (at, tie), each at its time or `gap` after the start before it, whichever is later.

    start of the i-th is gap * i plus the largest at - gap * j of the requests j <= i, so a
    running maximum gives all starts at once, and a host with a third of all rows is dealt
    out like any other. Times and the gap, which may differ by host, are whole numbers of one
    unit; rows with a null time get a null start and delay nobody.
    """
    wide = requests.withColumn("_gap", gap if isinstance(gap, Column) else F.lit(gap)).withColumn("_asks", F.when(F.col(at).isNotNull(), 1))
    order = [F.col(at).asc_nulls_last(), F.col(tie)]
    nth = running(wide, [host], order, {"_nth": ("sum", F.col("_asks"))})
    far = running(nth, [host], order, {"_most": ("max", F.col(at) - F.col("_gap") * F.col("_nth"))})
    start = F.when(F.col(at).isNotNull(), F.col("_most") + F.col("_gap") * F.col("_nth"))
    return far.withColumn("start", start.cast("long")).drop("_gap", "_asks", "_nth", "_most")


def retry_after(header: Column, now: Column, attempt: Column, jitter: Column) -> Column:
    """Seconds to wait before another try: those of a Retry-After header, or until its HTTP date, never below 0; without a usable header two to the power of the attempt and a share `jitter` (0 to 1) of a quarter second."""
    text = F.trim(header)
    seconds = text.try_cast("double")
    finite = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), " *(GMT|UTC)$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss xx"))
    until = F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6
    wait = F.coalesce(F.when(finite, seconds), until)
    return F.coalesce(F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0))), F.pow(F.lit(2.0), attempt) + jitter * 0.25)
