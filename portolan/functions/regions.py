"""The region of a country by rules over its statistical classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions that are taken over under a name of their own.
DIRECT = {"Africa": "Africa", "Europe": "Europe", "Asia": "Asia", "Oceania": "Oceania"}


def derived_region(code: Column, region: Column, subregion: Column, between: Column, overrides: dict[str, str], western_asia: list[str], long_code: Column, number: Column, country: Column) -> Column:
    """struct(region, reason): a region, or the first reason why there is none. The continent without a region needs all its codes and its name.

    overrides maps the codes of the Middle East to the subregion that each must still have; western_asia lists the
    codes that are known in Western Asia. Both are policies and given by the caller.
    """
    expected = F.lit(None).cast("string")
    for name, where in overrides.items():
        expected = F.when(code == name, where).otherwise(expected)
    direct = F.lit(None).cast("string")
    for name, taken in DIRECT.items():
        direct = F.when(region == name, taken).otherwise(direct)
    southern = F.coalesce(subregion == "South America", F.lit(False)) | F.coalesce(between == "South America", F.lit(False))
    bare = region.isNull() & subregion.isNull() & between.isNull()
    cases = [
        (F.coalesce(subregion == "Western Asia", F.lit(False)) & ~code.isin(western_asia), None, "unknown_western_asia"),
        (expected.isNotNull() & ~expected.eqNullSafe(subregion), None, "override_conflict"),
        (expected.isNotNull(), "Middle East", None),
        (direct.isNotNull(), direct, None),
        (F.coalesce(region == "Americas", F.lit(False)), F.when(southern, "South America").otherwise("North America"), None),
        (F.coalesce((code == "AQ") & (long_code == "ATA") & (number == "010") & (country == "Antarctica"), F.lit(False)) & bare, "Other", None),
        (region.isNull(), None, "no_region"),
    ]
    out = F.struct(F.lit(None).cast("string").alias("region"), F.lit("unknown_region").alias("reason"))
    for test, value, reason in reversed(cases):
        value = value if isinstance(value, Column) else F.lit(value).cast("string")
        out = F.when(test, F.struct(value.alias("region"), F.lit(reason).cast("string").alias("reason"))).otherwise(out)
    return out
