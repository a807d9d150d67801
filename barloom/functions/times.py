"""Time parsing: epoch milliseconds, ISO texts with a zero offset, and wall clocks of a zone. Results are epoch micro- or milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO-8601 date and time that carries a zero offset (fixed pattern).
ISO_UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-]00:?00)$"


def epoch_millis(text: Column) -> Column:
    """Milliseconds of an integer text; null for anything else."""
    return F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("long"))


def iso_utc(text: Column) -> Column:
    """Epoch microseconds of an ISO text; null if it is malformed or its offset is missing or not zero."""
    plain = F.regexp_replace(F.regexp_replace(text, "(Z|[+-]00:?00)$", ""), "T", " ")
    return F.when(text.rlike(ISO_UTC), F.unix_micros(F.try_to_timestamp(F.concat(plain, F.lit("+00:00")))))


def wall_clock(micros: Column, zone: str) -> tuple[Column, Column]:
    """(epoch microseconds, reject code) of a clock time, given as microseconds as if it were UTC, that was read in a zone.

    `nonexistent` times don't come back from UTC as they were; `ambiguous` ones are also shown by an instant an hour
    before or after. Both have no instant. The session's zone plays no part."""
    clock = F.timestamp_micros(micros)
    instant = F.to_utc_timestamp(clock, zone)
    shows = lambda hours: F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(instant) + hours * 3_600_000_000), zone) == clock
    code = F.when(~shows(0), "nonexistent").when(shows(1) | shows(-1), "ambiguous")
    return F.when(code.isNull(), F.unix_micros(instant)), code


def bar_start(t: Column, width: int, stamps_end: bool) -> Column:
    """Start of a bar whose source stamps its end (or its start)."""
    return t - width if stamps_end else t


def available_at(bar: Column, width: int, availability_lag: int = 0, decision_lag: int = 0) -> tuple[Column, Column]:
    """When a bar's values are known, and when a decision may use them."""
    known = bar + width + availability_lag
    return known, known + decision_lag
