"""Flags over weather measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From which wind and gust (m/s) on, below which sight (km) and ceiling (m) weather is adverse.
WIND, GUST, SIGHT, CEILING = 15.0, 20.0, 5.0, 305.0


def adverse(temperature: Column, wind: Column, gust: Column, rain: Column, sight: Column, ceiling: Column) -> Column:
    """Strong wind or gusts, rain, little sight, a low ceiling, or frost with rain; null where every measure is missing."""
    tests = [wind >= WIND, gust >= GUST, rain > 0, sight < SIGHT, ceiling < CEILING, (temperature <= 0) & (rain > 0)]
    any_of = F.lit(False)
    for test in tests:
        any_of = any_of | F.coalesce(test, F.lit(False))
    return F.when(F.coalesce(temperature, wind, gust, rain, sight, ceiling).isNotNull(), any_of)
