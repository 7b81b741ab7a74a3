"""Tables as the operators expect them, and the views that carry them onto the input tables.

Timestamps without a zone are taken as UTC and NaN as NULL: a comparison with NaN is true in Spark, but a missing
value must never satisfy a condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.nanvl(c, F.lit(None).cast(k)).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()])


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips from a customer's nation to a supplier's, late if shipped after the order date."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    )
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderdate", "l_shipdate",
        F.concat("l_returnflag", "l_linestatus").alias("carrier"),
        F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"),
        F.concat_ws("_", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string")).alias("route"),
        F.month("o_orderdate").alias("month"), (F.col("l_shipdate") > F.col("o_orderdate")).cast("int").alias("late"),
        F.col("l_quantity").alias("duration"), F.col("l_extendedprice").alias("distance"),
    )


SHIPMENTS = """
shipments AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderdate, l_shipdate, l_returnflag || l_linestatus AS carrier,
  c_nationkey AS origin, s_nationkey AS destination, c_nationkey::VARCHAR || '_' || s_nationkey::VARCHAR AS route,
  month(o_orderdate)::INTEGER AS month, CASE WHEN l_shipdate > o_orderdate THEN 1 ELSE 0 END AS late, l_quantity AS duration, l_extendedprice AS distance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trips with a time of prediction and a later time at which the outcome is known."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") == "signup", "diverted").otherwise("landed")
    at = F.unix_micros("ts")
    return e.select(
        F.col("event_id").alias("record_id"), at.alias("pred_us"), (at + F.floor(F.col("value") * 60) * 1_000_000 + 1_000_000).alias("outcome_us"),
        status.alias("status"), F.when(status == "landed", F.col("value")).alias("delay"), (F.col("user_id") % 8).alias("carrier"),
        (F.col("user_id") % 12).alias("origin"), ((F.col("user_id") + 1 + F.col("event_id") % 11) % 12).alias("destination"), "ts",
    )


LEGS = """
legs AS (SELECT event_id AS record_id, epoch_us(ts) AS pred_us, epoch_us(ts) + floor(value * 60)::BIGINT * 1000000 + 1000000 AS outcome_us,
  CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'signup' THEN 'diverted' ELSE 'landed' END AS status,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS delay, user_id % 8 AS carrier, user_id % 12 AS origin,
  (user_id + 1 + event_id % 11) % 12 AS destination, ts FROM events)
"""


def schedules_and_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return lines.filter("l_linestatus = 'O'").drop("l_linestatus"), lines.filter("l_linestatus = 'F'").drop("l_linestatus")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored cases: a score from the value, a label, and a slice."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("value") / (F.col("value") + 50)).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("user_id") % 6).alias("slice"), "event_type", "ts")


SCORES = """
scores AS (SELECT event_id, value / (value + 50) AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, user_id % 6 AS slice, event_type, ts FROM events)
"""
