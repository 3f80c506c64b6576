"""Event time: text to epoch milliseconds, and epoch helpers for frames."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of the prefix timestamp of a log line.
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or (read as UTC) TIMESTAMP_NTZ."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_to_ntz(us: Column) -> Column:
    """Microseconds since the epoch back to TIMESTAMP_NTZ in UTC."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def java_format(fmt: str) -> tuple[str, bool]:
    """Spark spelling of a SimpleDateFormat pattern.

    Returns the format and whether a leading weekday name has to be cut off
    first (Spark prints weekdays but does not read them). A 12-hour ``hh``
    without an am/pm marker is read as a 24-hour field, and a zone letter takes
    every ISO offset length. Quoted literals stay as they are.
    """
    pieces = re.split(r"('(?:[^']|'')*')", fmt)
    weekday = bool(re.match(r"E+[,\s]*", fmt))
    if weekday:
        pieces[0] = re.sub(r"^E+[,\s]*", "", pieces[0])
    twelve = any("a" in p for p in pieces[0::2])
    for i in range(0, len(pieces), 2):
        part = pieces[i]
        if not twelve:
            part = re.sub("h+", lambda m: "H" * len(m.group()), part)
        part = re.sub("X+|Z+", "[XXX][XX][X]", part)
        pieces[i] = part
    return "".join(pieces), weekday


def parse_millis(text: Column, fmt: str, compat_hh: bool = False) -> Column:
    """Epoch milliseconds of ``text`` read with a SimpleDateFormat pattern, else NULL.

    ``compat_hh`` reproduces what a 12-hour ``hh`` plus a one-letter zone do to
    24-hour input: hour 12 counts as 0 and offset minutes are ignored.
    """
    spark_fmt, weekday = java_format(fmt)
    value = F.regexp_replace(text, r"\A\p{L}+[,\s]*", "") if weekday else text
    if spark_fmt.endswith("[XXX][XX][X]"):
        # The sections are optional one by one; some offset must be there.
        value = F.when(F.rlike(value, F.lit(r"(?:Z|[+-]\d{2}(?::?\d{2})?)\z")), value)
    millis = F.unix_millis(F.try_to_timestamp(value, F.lit(spark_fmt)))
    if not compat_hh:
        return millis
    hour_12 = F.regexp_extract(text, r"\A\d{4}-\d{2}-\d{2}T(\d{2})", 1) == "12"
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}\z", 1) == "-", -1).otherwise(1)
    offset_minutes = F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})\z", 1).try_cast("long")
    shift = F.when(hour_12, F.lit(-43_200_000)).otherwise(F.lit(0))
    return millis + shift + F.coalesce(offset_minutes * sign * 60_000, F.lit(0))


def event_time_millis(logts: Column, compat_hh: bool = False) -> Column:
    """``logts_timestamp``: the prefix timestamp of a line in epoch milliseconds."""
    slow = parse_millis(logts, EVENT_TIME_FORMAT.replace("ss", "ss[.SSSSSS][.SSS]"), compat_hh)
    if compat_hh:
        return slow
    # A cast reads the usual spellings many times faster than a pattern does; it
    # is only asked when an offset is there, since a zone must not be guessed.
    zoned = logts.endswith("Z") | F.rlike(F.right(logts, F.lit(6)), F.lit(r"\A[+-]\d{2}:\d{2}\z"))
    return F.coalesce(F.unix_millis(F.when(zoned, logts).try_cast("timestamp")), slow)


def event_time(millis: Column) -> Column:
    """Epoch milliseconds as a TIMESTAMP usable in watermarks."""
    return F.timestamp_millis(millis)
