"""Date and time functions (FN-D*). Session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Output patterns.
RFC822 = "EEE, dd MMM yyyy HH:mm:ss Z"
ISO = "yyyy-MM-dd'T'HH:mm:ssXXX"
DATE_FORMAT = "MMM d, yyyy"
TIME_FORMAT = "HH:mm"
MONTH_YEAR = "MMMM yyyy"
ARCHIVE_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"


def from_epoch(x) -> Column:
    """FN-D1: epoch seconds -> timestamp (zone-naive, UTC)."""
    return F.timestamp_seconds(_c(x)).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """FN-D2: ``end - start`` in seconds (double; negative kept)."""
    def micros(c):
        return F.unix_micros(_c(c).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def hms(seconds) -> Column:
    """FN-D2: seconds as ``[-]H:MM:SS`` text (hours may exceed 24)."""
    s = _c(seconds)
    whole = F.floor(F.abs(s)).cast("bigint")
    txt = F.format_string("%d:%02d:%02d", (whole / 3600).cast("bigint"),
                          ((whole % 3600) / 60).cast("bigint"), whole % 60)
    return F.when(s < 0, F.concat(F.lit("-"), txt)).otherwise(txt)


def fmt(ts, pattern: str) -> Column:
    """FN-D3: format by pattern (zone-aware patterns see UTC)."""
    return F.date_format(_c(ts).cast("timestamp"), pattern)


def event_range(start, end, all_day) -> Column:
    """FN-D4: ``start [time] [— [end date] [end time]]``; the end date is
    omitted on the same day, times are omitted for all-day events."""
    st, en, ad = _c(start), _c(end), F.coalesce(_c(all_day), F.lit(False))
    same_day = F.to_date(st) == F.to_date(en)
    parts = F.array(
        fmt(st, DATE_FORMAT),
        F.when(~ad, fmt(st, TIME_FORMAT)),
        F.when(en.isNotNull(), F.lit("&mdash;")),
        F.when(en.isNotNull() & ~same_day, fmt(en, DATE_FORMAT)),
        F.when(en.isNotNull() & ~ad, fmt(en, TIME_FORMAT)),
    )
    return F.array_join(parts, " ")


def parse_archive_time(x) -> Column:
    """FN-D5: parse ``EEE MMM dd HH:mm:ss Z yyyy``; Spark 3+ will not parse
    ``EEE``, so the weekday (first 4 characters) is dropped first."""
    return F.to_timestamp(F.substring(_c(x), 5, 1 << 20), "MMM dd HH:mm:ss Z yyyy").cast("timestamp_ntz")


def parse_loose_iso(x) -> Column:
    """FN-D6: ISO text with one-digit parts (``2022-7-7T9:00:00Z``)."""
    return _c(x).try_cast("timestamp").cast("timestamp_ntz")


def parse_utc_or_iso(x) -> Column:
    """FN-D7: ``yyyy-MM-dd HH:mm:ss`` read as UTC, else any ISO form."""
    return F.coalesce(F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss")),
                      _c(x).try_cast("timestamp")).cast("timestamp_ntz")


def epoch_seconds(ts) -> Column:
    """FN-D8: timestamp -> epoch seconds (UTC)."""
    return F.unix_timestamp(_c(ts).cast("timestamp"))
