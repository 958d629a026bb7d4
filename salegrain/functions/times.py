"""Event times as ISO-8601 text, and fixed windows. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE_FIRST = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def iso_utc(ts: Column) -> Column:
    """Milliseconds, truncated, with a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text: Column) -> Column:
    """Timestamp of ISO-8601 text, without an offset UTC; null where it is none.

    A full date is asked for: a bare time or year would otherwise be cast to something.
    """
    return F.when(text.rlike(_DATE_FIRST), text.try_cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed window [start, start + seconds) aligned to the epoch."""
    micros = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(micros)))


def plus_seconds(ts: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(seconds * 1_000_000).cast("long"))


def aggregate_id(store: Column, start: Column) -> Column:
    """Stable key of a result: one row for each store and window."""
    return F.concat_ws("|", store, iso_utc(start))
