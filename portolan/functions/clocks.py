"""Local clocks to UTC, with the two hours of the year that are ambiguous or missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall(day: Column, hhmm: Column, next_day: bool = True) -> Column:
    """A local date and clock as a zoneless moment; 2400 is the next day's start, or this day's (next_day=False)."""
    of_day = F.pmod(hhmm, F.lit(2400))
    shift = F.when((hhmm == 2400) & F.lit(next_day), 1).otherwise(0)
    minutes = F.floor(of_day / 100).cast("int") * 60 + F.pmod(of_day, F.lit(100)).cast("int")
    return F.date_add(day, shift).cast("timestamp") + F.make_dt_interval(mins=minutes)


def candidates(local: Column, zone: str | Column) -> Column:
    """All instants (in order) at which the zone's clocks show `local`: none in a gap, two in an overlap.

    Offsets within a day around are tried; an instant counts if it reads as `local` again.
    """
    around = [F.to_utc_timestamp(local + F.expr(f"interval {h} hours"), zone) - F.expr(f"interval {h} hours") for h in (-24, 24)]
    tried = F.array_distinct(F.array(*around, F.to_utc_timestamp(local, zone)))
    return F.array_sort(F.filter(tried, lambda t: F.from_utc_timestamp(t, zone) == local))


def to_utc_shifting(local: Column, zone: str | Column) -> Column:
    """UTC of a local moment: null if ambiguous, the first moment after the gap if it does not exist (gaps start on the hour)."""
    found = candidates(local, zone)
    old = F.to_utc_timestamp(local + F.expr("interval -24 hours"), zone) + F.expr("interval 24 hours")
    start = F.timestamp_micros(F.unix_micros(old) - (F.unix_micros(local) - F.unix_micros(F.date_trunc("hour", local))))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) == 0, start)


def to_utc_strict(local: Column, zone: str | Column) -> Column:
    """UTC of a local moment; null if it is ambiguous or does not exist."""
    found = candidates(local, zone)
    return F.when(F.size(found) == 1, found[0])


def departure_and_arrival(departure: Column, arrival: Column, minutes: Column, origin: Column, destination: Column) -> Column:
    """The one departure whose arrival, so many minutes later, shows the arrival clock; null if none or several do."""
    fitting = F.filter(candidates(departure, origin), lambda t: F.from_utc_timestamp(t + F.make_dt_interval(mins=minutes), destination) == arrival)
    return F.when(F.size(fitting) == 1, fitting[0])


def offset_minutes(instant: Column, zone: str | Column) -> Column:
    return ((F.unix_micros(F.from_utc_timestamp(instant, zone)) - F.unix_micros(instant)) / 60_000_000).cast("int")
