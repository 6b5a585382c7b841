"""Event time, window identity and timestamp text."""
import re

from pyspark.sql import Column, functions as F

# Accepted message timestamp formats (first that parses wins), ISO output, window units.
EVENT_TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def parse_event_time(timestamp: Column) -> Column:
    """The message's own time, or NULL; wall-clock time is never substituted."""
    trimmed = F.trim(timestamp)
    # A failed parse costs an exception, so a format is tried on texts with its literals only (letters match in either case).
    timed = F.contains(trimmed, F.lit(":"))
    fits = (timed & F.contains(trimmed, F.lit(" ")), timed & F.contains(F.lower(trimmed), F.lit("t")), ~timed)
    return F.coalesce(*(F.when(fit, F.try_to_timestamp(trimmed, F.lit(fmt))) for fit, fmt in zip(fits, EVENT_TIME_FORMATS)))


def duration_to_seconds(duration: str) -> int:
    parts = duration.strip().lower().split()
    if len(parts) == 1:
        glued = re.match(r"([0-9]+)([a-z]+)$", parts[0])
        parts = list(glued.groups()) if glued else parts
    if len(parts) == 2 and parts[0].isdecimal():
        unit = parts[1].removesuffix("s")
        if unit in UNIT_SECONDS:
            return int(parts[0]) * UNIT_SECONDS[unit]
    raise ValueError(f"cannot read the duration {duration!r}; write it like '15 minutes' or '1 day'")


def window_id(window_start: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(window_start.cast("timestamp")) / F.lit(seconds)).cast("long")


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, ISO_FORMAT)


def normalise_ts(value: Column) -> Column:
    """Epoch seconds, ISO text with or without zone, or a bare date -> UTC timestamp (else NULL)."""
    text = F.trim(value.cast("string"))
    is_number = text.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    from_epoch = F.timestamp_micros((F.when(is_number, text).cast("double") * 1_000_000).cast("long"))
    return F.when(is_number, from_epoch).otherwise(F.try_to_timestamp(text))
