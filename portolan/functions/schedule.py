"""The whole feature vector of a published schedule, without anything that is known later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.calendar import cycle
from portolan.functions.geo import bearing, great_circle, turn_of_radians, unit_vector

#: The regions that have a place of their own in the vector; all others are `other`.
REGIONS = ("africa", "asia", "europe", "middle_east", "north_america", "oceania", "south_america", "other")


def region_token(name: Column) -> Column:
    """Lower case, blanks and hyphens as single underscores; `other` if that is none of REGIONS."""
    token = F.regexp_replace(F.lower(F.trim(F.translate(name, "-", " "))), r"\s+", "_")
    return F.when(token.isin(*REGIONS), token).otherwise("other")


def schedule_vector() -> dict[str, Column]:
    """Name -> feature, 46 in all, of rows with departure, arrival (instants), and for either end _lat, _lon, _offset (minutes), _country and _region, and aircraft.

    Years divisible by four have 366 days.
    """
    c = F.col
    local = lambda t, offset: F.timestamp_micros(F.unix_micros(t) + c(offset).cast("long") * 60_000_000)
    clock = lambda t: F.hour(t) + F.minute(t) / 60
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    leaves, lands = local("departure", "origin_offset"), local("arrival", "destination_offset")
    minutes = (F.unix_micros("arrival") - F.unix_micros("departure")) / 60_000_000
    ends = (c("origin_lat"), c("origin_lon"), c("destination_lat"), c("destination_lon"))
    km, angle = great_circle(*ends, turn=turn_of_radians), bearing(*ends, turn=turn_of_radians)
    days = F.when(F.year(leaves) % 4 == 0, 366.0).otherwise(365.0)
    out: dict[str, Column] = {}
    circles = {"month": (F.month(leaves), 12), "weekday": (F.weekday(leaves) + 1, 7), "year_day": (F.dayofyear(leaves) / days, 1), "origin_departure_hour": (clock(leaves), 24), "destination_arrival_hour": (clock(lands), 24), "utc_departure_hour": (clock("departure"), 24)}
    for name, (value, period) in circles.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, period)
    out |= {"is_origin_weekend": flag(F.weekday(leaves) >= 5), "scheduled_duration_minutes": minutes, "scheduled_duration_log1p": F.log1p(minutes), "great_circle_distance_km": km, "great_circle_distance_log1p": F.log1p(km), "bearing_sin": F.sin(angle), "bearing_cos": F.cos(angle)}
    out |= {"timezone_change_hours": (c("destination_offset") - c("origin_offset")) / 60, "same_country": flag(c("origin_country") == c("destination_country")), "same_region": flag(F.lower("origin_region") == F.lower("destination_region")), "is_international": flag(c("origin_country") != c("destination_country"))}
    for end, lat, lon in (("origin", *ends[:2]), ("destination", *ends[2:])):
        out |= {f"{end}_ecef_{axis}": value for axis, value in zip("xyz", unit_vector(lat, lon))}
    out["aircraft_family_missing"] = c("aircraft").isNull().cast("double")
    for region in REGIONS:
        out |= {f"{end}_region_{region}": flag(region_token(c(f"{end}_region")) == region) for end in ("origin", "destination")}
    return out
