"""Splits by time and by region, as one column: no row is read twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chronological(at: Column, known_at: Column | None, ends: dict[str, int]) -> Column:
    """The first window that ends after `at`; purged_immature if the outcome is not known before that window's end."""
    split, cutoff = F.lit("excluded_after_test"), F.lit(None).cast("long")
    for name, end in reversed(ends.items()):
        split, cutoff = F.when(at < end, name).otherwise(split), F.when(at < end, F.lit(end)).otherwise(cutoff)
    return split if known_at is None else F.when(known_at >= cutoff, "purged_immature").otherwise(split)


def holdout(regions: Column, held_out: Column, at: Column, known_at: Column, start: int) -> Column:
    """Rows that touch a held-out region are tested from `start` on and never fitted; others are fitted before it."""
    touches = F.arrays_overlap(regions, held_out)
    fitted = F.when(known_at >= start, "purged_immature").otherwise("training")
    return F.when((at < start) & ~touches, fitted).when((at >= start) & touches, "holdout_test").otherwise("excluded")
