"""Offers of a provider, from captured JSON to one row: nested slices and segments in array functions, with no exploding and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.text import minor_units
from portolan.operators.validation import first_reason

_CARRIER = "struct<code:string,name:string>"
_SLICE = f"struct<segments:array<struct<origin:string,destination:string,departure:string,arrival:string,number:string,carrier:{_CARRIER},operator:{_CARRIER}>>>"
#: What is read of an offer; anything else in it is passed over, and a value of another kind is null.
SCHEMA = f"price struct<amount:string,currency:string>, cabin string, self_transfer boolean, outbound {_SLICE}, inbound {_SLICE}"


def _segments(leg: str) -> Column:
    return F.coalesce(F.col(f"{leg}.segments"), F.array().cast(_SLICE[len("struct<segments:") : -1]))


def _sound(segment: Column) -> Column:
    """Whether a segment has all that it must have: codes, times in order, a carrier's name and a number."""
    start, end = segment["departure"].try_cast("timestamp"), segment["arrival"].try_cast("timestamp")
    return F.coalesce(
        segment["origin"].rlike("^[A-Z]{3}$") & segment["destination"].rlike("^[A-Z]{3}$") & (segment["origin"] != segment["destination"]) & (start < end)
        & (F.trim(segment["carrier"]["name"]) != "") & (F.trim(segment["number"]) != ""), F.lit(False),
    )


def _airlines(segments: Column) -> Column:
    """Carriers and operators in the order in which they are first met; one is told from another by code and name."""
    both = F.flatten(F.transform(segments, lambda s: F.array(s["carrier"], s["operator"])))
    named = F.filter(both, lambda a: F.coalesce(F.trim(a["name"]) != "", F.lit(False)))
    return F.array_distinct(F.transform(named, lambda a: F.struct(F.coalesce(a["code"], F.lit("")).alias("code"), a["name"].alias("name"))))


def _identity(leg: str, number: int) -> Column:
    rows = F.transform(_segments(leg), lambda s: F.concat_ws(":", s["origin"], s["destination"], F.coalesce(s["carrier"]["code"], F.lit("")), s["number"], s["departure"], s["arrival"]))
    return F.concat_ws("|", F.lit(f"slice-{number}"), F.get(_segments(leg), F.lit(0))["origin"], F.element_at(_segments(leg), -1)["destination"], F.array_join(rows, "|"))


def normalized(raw: DataFrame, document: str) -> DataFrame:
    """raw with reject_reason, currency, amount, minor_units, connections, airlines (code and name, first seen first) and identity.

    raw has the JSON text `document` and what was asked for: want_origin, want_destination, want_departure, want_return (dates, the
    last one null for one way) and want_cabin. An offer is taken whole or not at all: one faulty segment rejects it. A rejected offer
    has nulls in place of the rest. Text that is no JSON, and null, are rejected as `document`. Minor units are null where the
    amount has more digits than its currency.
    """
    names = [f"c{i}" for i in range(len(raw.columns))]
    of = {c: F.col(n) for n, c in zip(names, raw.columns)}
    parsed = raw.toDF(*names).withColumn("o_", F.from_json(of[document], SCHEMA)).select(*names, *[F.col(f"o_.{c}").alias(c) for c in ("price", "cabin", "self_transfer", "outbound", "inbound")])
    out, back, returns = _segments("outbound"), _segments("inbound"), of["want_return"].isNotNull()
    first, last = lambda s: F.get(s, F.lit(0)), lambda s: F.element_at(s, -1)
    day = lambda s: F.to_date(F.substring(s["departure"], 1, 10))
    meets = lambda s, a, b, d: (first(s)["origin"] == a) & (last(s)["destination"] == b) & (day(first(s)) == d)
    amount = F.col("price.amount")
    rules = [
        ("document", F.coalesce(F.size("outbound.segments") >= 0, F.lit(False)) | F.col("price").isNotNull()),
        ("self_transfer", ~F.coalesce("self_transfer", F.lit(False))),
        ("price", amount.rlike(r"^\d+(\.\d+)?$") & (amount.try_cast("decimal(28,6)") > 0) & F.col("price.currency").rlike("^[A-Z]{3}$")),
        ("cabin", F.coalesce(F.col("cabin"), of["want_cabin"]) == of["want_cabin"]),
        ("return", returns == F.col("inbound").isNotNull()),
        ("segment", (F.size(out) > 0) & F.forall(out, _sound) & (~returns | ((F.size(back) > 0) & F.forall(back, _sound)))),
        ("itinerary", meets(out, of["want_origin"], of["want_destination"], of["want_departure"]) & (~returns | F.coalesce(meets(back, of["want_destination"], of["want_origin"], of["want_return"]), F.lit(False)))),
    ]
    good = F.col("reject_reason").isNull()
    every = F.concat(out, back)
    told = {
        "currency": F.col("price.currency"), "amount": amount, "minor_units": minor_units(amount, F.col("price.currency")),
        "connections": F.size(out) - 1 + F.when(returns, F.size(back) - 1).otherwise(0), "airlines": _airlines(every), "identity": F.concat_ws("||", _identity("outbound", 1), F.when(returns, _identity("inbound", 2))),
    }
    done = parsed.withColumn("reject_reason", first_reason(rules))
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, raw.columns)], "reject_reason", *[F.when(good, v).alias(k) for k, v in told.items()])
