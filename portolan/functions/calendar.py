"""Calendar features of a date or a local clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of the given period."""
    angle = 2 * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def in_holiday_window(day: Column, days: int = 2) -> Column:
    """Within so many days of 1 January, 4 July, 25 December or the fourth Thursday of November of the same year."""
    year = F.year(day)
    november = F.make_date(year, F.lit(11), F.lit(1))
    fourth_thursday = F.date_add(F.next_day(F.date_sub(november, 1), "Thu"), 21)
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in ((1, 1), (7, 4), (12, 25))]
    near = F.lit(False)
    for holiday in [*fixed, fourth_thursday]:
        near = near | (F.abs(F.datediff(day, holiday)) <= days)
    return near


def valid_clock(hhmm: Column) -> Column:
    """A clock as hours and minutes in one number, 0 to 2400."""
    return hhmm.between(0, 2400) & (F.pmod(hhmm, F.lit(100)) < 60)


def half_hour(hhmm: Column) -> Column:
    """The half hour of the day, 0 to 47; 2400 is the first of the same day."""
    of_day = F.pmod(hhmm, F.lit(2400))
    return F.floor(of_day / 100).cast("int") * 2 + F.floor(F.pmod(of_day, F.lit(100)) / 30).cast("int")


def season(month: Column, latitude: Column) -> Column:
    """The season of a month; south of the equator the opposite one."""
    names = ("winter", "spring", "summer", "autumn")
    quarter = F.floor(F.pmod(month, F.lit(12)) / 3)
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(quarter + F.when(latitude < 0, 2).otherwise(0), F.lit(4)) + 1).cast("int"))
