"""Keys, codes, numbers and money read from text. What can't be read is null."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column, form: str) -> Column:
    """The text in a Unicode normal form (NFC, NFD, NFKC, NFKD); no built-in function has them, so Python does it, once for each distinct text of a batch."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        known = {x: unicodedata.normalize(form, x) for x in pc.unique(batch).to_pylist() if x is not None and not x.isascii()}
        return pa.array([known.get(x, x) for x in batch.to_pylist()], pa.string()) if known else batch.cast(pa.string())

    return run(text)


def unmarked(text: Column) -> Column:
    """Letters of all scripts by their compatible decomposition, without marks; sharp s as two letters."""
    return F.replace(F.regexp_replace(normalized(text, "NFKD"), r"\p{M}+", ""), F.lit("ß"), F.lit("ss"))


def header_key(text: Column) -> Column:
    """Lower-case letters and digits of a heading, joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.replace(unmarked(text), F.lit("ẞ"), F.lit("ss"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def search_text(text: Column) -> Column:
    """Unmarked lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(unmarked(text), F.lit("ẞ"), F.lit("ss"))), "[^a-z0-9]+", " "))


def category(text: Column, missing: str = "__MISSING__") -> Column:
    """Compatible characters, upper case, single spaces; null and blank are one category."""
    plain = F.upper(F.trim(F.regexp_replace(normalized(text, "NFKC"), r"\s+", " ")))
    return F.when(plain.isNull() | (plain == ""), missing).otherwise(plain)


def feature_token(value: Column) -> Column:
    """A readable start and a hash that keeps different values apart."""
    slug = header_key(value)
    return F.concat_ws("_", F.substring(F.when(slug == "", "value").otherwise(slug), 1, 48), F.substring(F.sha2(value, 256), 1, 10))


def record_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def codes(text: Column, pattern: str = "^[A-Z0-9]{3}/[A-Z0-9]{1,6}$") -> Column:
    """The distinct codes of a comma-separated list up to the first entry that is none, in order; empty for a blank text."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    bad = F.array_position(F.transform(items, lambda x: x.rlike(pattern)), False)
    return F.array_distinct(F.slice(items, F.lit(1), F.when(bad == 0, F.size(items)).otherwise(bad - 1).cast("int")))


def _digits_only(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def duration_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration of days, hours and minutes; seconds are dropped, zero is null.

    The text is taken apart at its unit letters, each at most once and in order; what is left must be numbers.
    """
    body, time = F.substring_index(F.substring(text, 2, 1 << 30), "T", 1), F.when(F.contains(text, F.lit("T")), F.substring_index(text, "T", -1)).otherwise("")
    minutes, valid = F.lit(0).cast("long"), F.startswith(text, F.lit("P")) & (F.size(F.split(text, "T")) <= 2)
    rest = {"D": body, "H": time, "M": None, "S": None}
    after = None
    for unit, worth in (("D", 1440), ("H", 60), ("M", 1), ("S", 0)):
        part = rest[unit] if rest[unit] is not None else after
        has = F.contains(part, F.lit(unit))
        number = F.when(has, F.substring_index(part, unit, 1)).otherwise("0")
        after = F.when(has, F.substring(part, F.length(F.substring_index(part, unit, 1)) + 2, F.lit(1 << 30))).otherwise(part)
        if unit == "S":  # seconds may have a fraction
            whole, fraction = F.substring_index(number, ".", 1), F.when(F.contains(number, F.lit(".")), F.substring(number, F.length(F.substring_index(number, ".", 1)) + 2, F.lit(1 << 30))).otherwise("0")
            valid = valid & _digits_only(whole) & _digits_only(fraction) & (after == "")
        else:
            valid = valid & _digits_only(number)
            minutes = minutes + F.coalesce(number.try_cast("long"), F.lit(0)) * worth
            if unit == "D":
                valid = valid & (after == "")
    return F.when(valid & (minutes > 0), minutes)


#: Currencies without and with three decimals; all others have two.
NO_DECIMALS = ("BIF", "CLP", "DJF", "GNF", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DECIMALS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")


def decimals(currency: Column) -> Column:
    code = F.upper(currency)
    return F.when(code.rlike("^[A-Z]{3}$"), F.when(code.isin(*NO_DECIMALS), 0).when(code.isin(*THREE_DECIMALS), 3).otherwise(2))


def minor_units(amount: Column, currency: Column) -> Column:
    """An amount in text as whole minor units; null if it is no plain amount or finer than its currency."""
    places = decimals(currency)
    whole = F.substring_index(amount, ".", 1)
    fraction = F.when(F.contains(amount, F.lit(".")), F.substring(amount, F.length(whole) + 2, F.lit(1 << 30))).otherwise("0")
    plain = _digits_only(whole) & _digits_only(fraction) & ((F.length(whole) == 1) | ~F.startswith(whole, F.lit("0")))
    value = F.when(plain, amount.try_cast("decimal(30,9)"))
    scaled = value * F.when(places == 0, 1).when(places == 2, 100).when(places == 3, 1000)
    return F.when((scaled == F.floor(scaled)) & (scaled <= 9007199254740991), scaled.cast("long"))


def money_text(units: Column, currency: Column) -> Column:
    """Whole minor units as text with the currency's decimals."""
    places = decimals(currency)
    digits = F.lpad(units.cast("string"), F.greatest(F.length(units.cast("string")), places + 1), F.lit("0"))
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - places), F.substring(digits, F.length(digits) - places + 1, places)
    return F.when(units >= 0, F.when(places == 0, head).otherwise(F.concat_ws(".", head, tail)))


def integral(text: Column) -> Column:
    """A whole number written in any decimal way, else null."""
    value = F.trim(text).try_cast("decimal(38,9)")
    return F.when(value == F.floor(value), value.try_cast("long"))


def epoch_instant(number: Column) -> Column:
    """Seconds or, from ten thousand million on, milliseconds since 1970 as a timestamp of 2000 to 2100, else null."""
    millis = F.when(number < 10_000_000_000, number * 1000).otherwise(number)
    at = F.timestamp_millis(F.floor(millis).cast("long"))
    return F.when(millis.between(946684800000, 4133980799999), at)


def observed_delay(stated: Column, scheduled: Column, actual: Column) -> Column:
    """The stated delay if a whole number within a day, else the difference of the two moments in minutes within a day."""
    usable = F.when((stated == F.floor(stated)) & stated.between(-1440, 1440), stated.cast("double"))
    difference = (F.unix_micros(actual) - F.unix_micros(scheduled)) / 60_000_000
    return F.coalesce(usable, F.when(difference.between(-1440, 1440), difference))
