"""Probabilities: logistic functions, intervals, isotonic projection, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def sigmoid(x: Column) -> Column:
    """Logistic function, without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def platt(score: Column, slope: float, intercept: float) -> Column:
    return sigmoid(F.lit(slope) * score + F.lit(intercept))


def laplace(late: Column, n: Column) -> Column:
    """Percentage with one success and one failure added, half up to a tenth; null without cases."""
    return F.when(n > 0, half_up((late + 1) / (n + 2) * 100, 1))


def wilson(late: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval in percent, half up to a tenth; null without cases."""
    p, z2 = late / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(n > 0, half_up(low * 100, 1)), F.when(n > 0, half_up(high * 100, 1))


def confidence(n: Column, low: Column, high: Column, least: int = 5) -> Column:
    width = F.coalesce(high, F.lit(100.0)) - F.coalesce(low, F.lit(0.0))
    return F.when(n < least, "insufficient").when((n < 20) | (width > 35), "limited").when((n < 50) | (width > 20), "moderate").otherwise("strong")


def nonincreasing(*values: Column) -> list[Column]:
    """The nearest non-increasing sequence (least squares) to two or three values.

    Value i becomes the smallest, over starts a <= i, of the largest mean of a to b over ends b >= i.
    """
    def mean(a: int, b: int) -> Column:
        return sum(values[a + 1 : b + 1], values[a]) / (b - a + 1)

    out = []
    for i in range(len(values)):
        highest = [F.greatest(*(mean(a, b) for b in range(i, len(values)))) if i < len(values) - 1 else mean(a, i) for a in range(i + 1)]
        out.append(F.least(*highest) if len(highest) > 1 else highest[0])
    return out


def risk_level(p: Column) -> Column:
    return F.when(p < 0.16, "lower").when(p < 0.28, "moderate").otherwise("higher")


def support(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 100, "1-99").when(n < 1000, "100-999").otherwise("1000+")
