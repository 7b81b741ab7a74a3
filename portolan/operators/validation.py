"""Row checks: every row is accepted or gets the first reason against it, and the counts must add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks; a rule that can't be decided counts as broken."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def audited(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("reject_reason", first_reason(rules))


def accounting(checked: DataFrame, *by: str) -> DataFrame:
    """by..., reason (`accepted` if none), n."""
    return checked.groupBy(*by, F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def code(value: Column) -> Column:
    """Upper case without spaces."""
    return F.upper(F.regexp_replace(value, r"\s+", ""))


#: Other names of the statuses.
STATUS_NAMES = {"arrived": "landed", "completed": "landed", "canceled": "cancelled", "cancelled": "cancelled", "diverted": "diverted", "landed": "landed", "scheduled": "scheduled"}


def status(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(value)))


def canonical_rules() -> list[tuple[str, Column]]:
    """Rules of a trip with carrier, number, origin, destination, departure, arrival, status, latitude, longitude, offset."""
    hours = (F.unix_micros("arrival") - F.unix_micros("departure")) / 3_600_000_000
    airport = lambda c: F.col(c).rlike("^([A-Z]{3}|[A-Z0-9]{4})$")
    return [
        ("carrier", F.col("carrier").rlike("^[A-Z0-9]{2,3}$")), ("number", F.col("number").rlike("^[A-Z0-9]{1,6}$")), ("origin", airport("origin")), ("destination", airport("destination")), ("same_ends", F.col("origin") != F.col("destination")),
        ("duration", (hours > 0) & (hours <= 36)), ("status", F.col("status").isNotNull()), ("coordinates", F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)), ("offset", F.col("offset_minutes").between(-840, 840)),
    ]


def outcome_rules() -> list[tuple[str, Column]]:
    """Rules of a trip's actual times and of when its plan and outcome were seen; a time that is missing breaks none.

    Columns: status, departure, offset_minutes, service_date, actual_departure, actual_arrival, outcome_seen. The first rules are on what can't
    stand beside the status, the last one is the day of the departure by its own clock.
    """
    after = lambda a, b: F.coalesce(F.col(a) >= F.col(b), F.lit(True))
    none = lambda c: F.col(c).isNull()
    local_day = F.to_date(F.timestamp_micros(F.unix_micros("departure") + F.col("offset_minutes").cast("long") * 60_000_000))
    return [
        ("actual_order", after("actual_arrival", "actual_departure")), ("arrival_of_none", ~F.col("status").isin("cancelled", "scheduled") | none("actual_arrival")), ("outcome_of_none", (F.col("status") != "scheduled") | none("outcome_seen")),
        ("landed_early", (F.col("status") != "landed") | after("outcome_seen", "actual_arrival")), ("diverted_early", (F.col("status") != "diverted") | after("outcome_seen", "actual_departure")), ("service_date", F.col("service_date") == local_day),
    ]


def write_accounted(checked: DataFrame, path: str, excluded: Column | None = None, least_accepted: float = 0.0) -> dict[str, int]:
    """Write audited rows once, apart by `disposition` (accepted, excluded, rejected), and return how many were read and had each fate.

    The counts are taken by the writing pass itself. ValueError, after the write, if they don't add up to the rows read or too small a share of those not
    excluded was accepted; the table then has no _ACCOUNTED mark. `excluded` marks accepted rows that are left out on purpose.
    """
    left_out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    fate = F.when(F.col("reject_reason").isNotNull(), "rejected").when(left_out, "excluded").otherwise("accepted")
    seen = Observation()
    counts = [F.count("*").alias("read"), *[F.count_if(F.col("disposition") == f).alias(f) for f in ("accepted", "excluded", "rejected")]]
    checked.withColumn("disposition", fate).observe(seen, *counts).write.partitionBy("disposition").parquet(path)
    told = dict(seen.get)
    if told["read"] != told["accepted"] + told["excluded"] + told["rejected"]:
        raise ValueError(f"rows are not accounted for: {told}")
    if told["accepted"] < least_accepted * (told["read"] - told["excluded"]):
        raise ValueError(f"too few rows were accepted: {told}")
    spark = checked.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_ACCOUNTED")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    return told
