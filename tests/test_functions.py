"""Expressions on cases that the tables lack: nulls, ties, edges, known values."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from portolan.functions import calendar, clocks, geo, scores, text


def column(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_intervals_of_known_samples(spark):
    got = column(spark, [(4, 6), (3, 6), (2, 6), (0, 5), (5, 5), (0, 0)], "late int, n int", scores.laplace(F.col("late"), F.col("n")))
    assert [x for x, in got] == [62.5, 50.0, 37.5, 14.3, 85.7, None]
    low, high = scores.wilson(F.col("late"), F.col("n"))
    rows = column(spark, [(4, 6), (0, 0)], "late int, n int", low, high, scores.confidence(F.col("n"), low, high))
    assert rows[0] == (30.0, 90.3, "limited") and rows[1] == (None, None, "insufficient")


@pytest.mark.parametrize("values", [(0.5, 0.4, 0.3), (0.1, 0.2, 0.3), (0.3, 0.1, 0.2), (0.1, 0.4, 0.1), (0.2, 0.2, 0.9), (0.5, 0.0, 0.5)])
def test_projection_equals_pooling(spark, values):
    blocks = []
    for v in values:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    want = [v for v, n in blocks for _ in range(n)]
    (got,) = column(spark, [values], "a double, b double, c double", *scores.nonincreasing(F.col("a"), F.col("b"), F.col("c")))
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got, want))


def test_sigmoid_does_not_overflow(spark):
    got = column(spark, [(1000.0,), (-1000.0,), (0.0,), (None,)], "x double", scores.sigmoid(F.col("x")))
    assert [x for x, in got] == [1.0, 0.0, 0.5, None]


def test_clocks_of_a_year(spark):
    at = lambda *x: datetime.datetime(*x)
    rows = [(at(2024, 3, 10, 2, 30),), (at(2024, 11, 3, 1, 30),), (at(2024, 7, 1, 12, 0),), (at(2024, 3, 10, 3, 0),), (None,)]
    zone = "America/New_York"
    shifted, strict = clocks.to_utc_shifting(F.col("l"), zone), clocks.to_utc_strict(F.col("l"), zone)
    got = column(spark, rows, "l timestamp", F.date_format(shifted, "dd HH:mm"), F.date_format(strict, "dd HH:mm"), F.size(clocks.candidates(F.col("l"), zone)))
    assert got[:4] == [("10 07:00", None, 0), (None, None, 2), ("01 16:00", "01 16:00", 1), ("10 07:00", "10 07:00", 1)] and got[4][:2] == (None, None)


def test_departure_is_the_one_that_fits_the_arrival(spark):
    at = lambda *x: datetime.datetime(*x)
    rows = [(at(2024, 11, 3, 1, 30), at(2024, 11, 3, 2, 30), 60), (at(2024, 11, 3, 1, 30), at(2024, 11, 3, 1, 30), 60), (at(2024, 6, 1, 8, 0), at(2024, 6, 1, 9, 0), 90)]
    got = column(spark, rows, "d timestamp, a timestamp, m int", F.date_format(clocks.departure_and_arrival(F.col("d"), F.col("a"), F.col("m"), F.lit("America/New_York"), F.lit("America/New_York")), "HH:mm"))
    assert [x for x, in got] == ["06:30", "05:30", None]


def test_clock_numbers(spark):
    got = column(spark, [(0,), (59,), (60,), (2359,), (2400,), (2401,), (-1,), (None,)], "x int", calendar.valid_clock(F.col("x")), calendar.half_hour(F.col("x")))
    assert [v for v, _ in got] == [True, True, False, True, True, False, False, None] and got[3][1] == 47 and got[4][1] == 0
    day = F.lit("2024-01-31").cast("date")
    walls = column(spark, [(2400,), (130,)], "x int", F.date_format(clocks.wall(day, F.col("x")), "MM-dd HH:mm"), F.date_format(clocks.wall(day, F.col("x"), False), "MM-dd HH:mm"))
    assert walls == [("02-01 00:00", "01-31 00:00"), ("01-31 01:30", "01-31 01:30")]


def test_holidays_stay_in_their_year(spark):
    days = ["2024-11-26", "2024-11-25", "2024-12-30", "2025-01-03", "2025-01-04", "2024-07-02"]
    got = column(spark, [(d,) for d in days], "d string", calendar.in_holiday_window(F.col("d").cast("date")))
    assert [x for x, in got] == [True, False, False, True, False, True]


def test_text_that_cannot_be_read_is_null(spark):
    rows = [("PT2H5M",), ("P1DT1M",), ("PT0M",), ("P",), ("2h",), (None,), ("PT5M7.5S",)]
    assert [x for x, in column(spark, rows, "x string", text.duration_minutes(F.col("x")))] == [125, 1441, None, None, None, None, 5]
    money = [("12.34", "USD"), ("12.345", "USD"), ("12.340", "usd"), ("5", "JPY"), ("5.1", "JPY"), ("1.234", "KWD"), ("012", "USD"), ("1", "XX"), (None, "USD")]
    assert [x for x, in column(spark, money, "a string, c string", text.minor_units(F.col("a"), F.col("c")))] == [1234, None, 1234, 5, None, 1234, None, None, None]
    assert [x for x, in column(spark, [("Ñandú É  x!",), ("--",), (None,)], "x string", text.header_key(F.col("x")))] == ["nandu_e_x", "", None]
    assert [x for x, in column(spark, [("abc/1,ABC/1 , xyz/22",), ("bad,ABC/1",), ("ABC/1,bad,XYZ/1",), (None,), (" ",)], "x string", F.array_join(text.codes(F.col("x")), "|"))] == ["ABC/1|XYZ/22", "", "ABC/1", "", ""]
    assert [x for x, in column(spark, [(" 5.00 ",), ("5.5",), ("",), ("x",), (None,), ("1e2",)], "x string", text.integral(F.col("x")))] == [5, None, None, None, None, 100]


def test_distance_of_antipodes_and_of_nothing(spark):
    (row,) = column(spark, [(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double", geo.great_circle(*map(F.col, "abcd")), geo.great_circle(F.col("a"), F.col("b"), F.col("a"), F.col("b")))
    assert math.isclose(row[0], math.pi * geo.RADIUS_KM) and row[1] == 0


def test_keys_of_other_scripts_and_forms(spark):
    import unicodedata

    words = ["Straße ﬁn №5", "ＦＵＬＬ width", "Ａ１", "ǅungla", "İstanbul", "x²", "Ωmega Ñ", "한국", "été", None]
    got = column(spark, [(w,) for w in words], "x string", text.header_key(F.col("x")), text.category(F.col("x")))
    for w, (key, category) in zip(words, got):
        if w is None:
            assert key is None and category == "__MISSING__"
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).casefold()
        assert key == re.sub("[^a-z0-9]+", "_", plain).strip("_")
        assert category == " ".join(unicodedata.normalize("NFKC", w).upper().split())


def test_durations_built_from_their_parts(spark):
    """Each text is written from days, hours, minutes and seconds whose sum in minutes is known; faulty ones are listed."""
    rng, cases = random.Random(4), [("P", None), ("PT", None), ("P1H", None), ("PT1D", None), ("T1H", None), ("PT1M2H", None), (" PT1H", None), ("P-1D", None), ("P1D1D", None), ("PT.5S", None), ("PT5.S", None), ("P1DT", 1440), ("1D", None), ("", None), (None, None)]
    for _ in range(500):
        days, hours, minutes, seconds = (rng.choice([None, 0, rng.randrange(1, 99)]) for _ in range(4))
        clock = "".join(f"{n}{u}" for n, u in ((hours, "H"), (minutes, "M")) if n is not None) + (f"{seconds}{rng.choice(['', '.5', '.25'])}S" if seconds is not None else "")
        whole = (f"{days}D" if days is not None else "") + (f"T{clock}" if clock else "")
        cases.append((f"P{whole}", 1440 * (days or 0) + 60 * (hours or 0) + (minutes or 0) or None))
    got = column(spark, [(t,) for t, _ in cases], "x string", text.duration_minutes(F.col("x")))
    assert [g for g, in got] == [want for _, want in cases]


def test_amounts_built_from_their_parts(spark):
    """Each text is written from a whole number and digits behind the point; what is finer than a hundredth has no minor units."""
    rng, cases = random.Random(5), [(t, None) for t in ("00", "01", "1.", ".5", "-1", "+1", "1e3", "1.2.3", "1,5", "", None)]
    for _ in range(400):
        whole, digits = rng.choice([0, rng.randrange(10), rng.randrange(10**6)]), [rng.choice([0, 0, rng.randrange(10)]) for _ in range(rng.randrange(5))]
        hundredths = (digits + [0, 0])[:2]
        value = None if any(digits[2:]) else 100 * whole + 10 * hundredths[0] + hundredths[1]
        cases.append((f"{whole}" + ("." + "".join(map(str, digits)) if digits else ""), value))
    got = column(spark, [(a,) for a, _ in cases], "x string", text.minor_units(F.col("x"), F.lit("USD")))
    assert [g for g, in got] == [want for _, want in cases]
