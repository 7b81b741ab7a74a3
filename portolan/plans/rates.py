"""Rates, samples, splits and vocabularies over the shipment and leg views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.operators import rates as op
from portolan.plans.registry import query
from portolan.sources.tables import LEGS, SHIPMENTS, legs, shipments, table

#: How many rows a group needs before its own rate outweighs the common one.
STRENGTHS = {"carrier": 500.0, "origin": 500.0, "destination": 500.0, "route": 150.0}
_K = "CASE level WHEN 'route' THEN 150.0 ELSE 500.0 END"
_KEYS = """
keyed AS (SELECT 'carrier' AS level, carrier AS key, month, late FROM shipments UNION ALL SELECT 'origin', origin::VARCHAR, month, late FROM shipments
  UNION ALL SELECT 'destination', destination::VARCHAR, month, late FROM shipments UNION ALL SELECT 'route', route, month, late FROM shipments)
"""


@query(f"""WITH {SHIPMENTS}, {_KEYS}, g AS (SELECT avg(late::DOUBLE) AS prior FROM shipments),
a AS (SELECT level, key, count(*) AS n, sum(late)::BIGINT AS pos FROM keyed GROUP BY ALL)
SELECT level, key, n, pos, (pos + {_K} * prior) / (n + {_K}) AS rate FROM a, g""")
def smoothed_rate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.smoothed(shipments(spark, sf_dir), STRENGTHS, "late")


@query(f"""WITH {SHIPMENTS}, {_KEYS}, own AS (SELECT level, key, month, count(*) AS n, sum(late) AS pos FROM keyed GROUP BY ALL),
f AS (SELECT month, count(*) AS n, sum(late) AS pos FROM shipments GROUP BY month),
p AS (SELECT month, ((SELECT sum(pos) FROM f) - pos)::DOUBLE / ((SELECT sum(n) FROM f) - n) AS prior FROM f),
o AS (SELECT o.level, o.key, o.month, (t.n - o.n)::BIGINT AS n_other, (t.pos - o.pos)::BIGINT AS pos_other FROM own o
  JOIN (SELECT level, key, sum(n) AS n, sum(pos) AS pos FROM own GROUP BY ALL) t USING (level, key))
SELECT level, key, month, n_other, pos_other, (pos_other + {_K} * prior) / (n_other + {_K}) AS rate FROM o JOIN p USING (month)""")
def out_of_fold_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.out_of_fold(shipments(spark, sf_dir), STRENGTHS, "late", "month")


_BANK = "origin || '|' || isodow(o_orderdate) || '|' || (l_orderkey % 48)"


@query(f"""WITH {SHIPMENTS}, b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, route, carrier || '|' || route AS carrier_route, {_BANK} AS bank FROM shipments),
r AS (SELECT route, count(*) AS n FROM b WHERE l_orderkey % 2 = 0 GROUP BY ALL), c AS (SELECT carrier_route, count(*) AS n FROM b WHERE l_orderkey % 2 = 0 GROUP BY ALL),
k AS (SELECT bank, count(*) AS n FROM b WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(1 + coalesce(r.n, 0)) AS route_log, ln(1 + coalesce(c.n, 0)) AS carrier_route_log, ln(1 + coalesce(k.n, 0)) AS bank_log
FROM b LEFT JOIN r USING (route) LEFT JOIN c USING (carrier_route) LEFT JOIN k USING (bank)""")
def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a row's route, carrier on it, and origin by weekday and half hour were met in the fitting half."""
    rows = shipments(spark, sf_dir)
    bank = F.concat_ws("|", F.col("origin").cast("string"), (F.weekday("o_orderdate") + 1).cast("string"), (F.col("l_orderkey") % 48).cast("string"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "route", F.concat_ws("|", "carrier", "route").alias("carrier_route"), bank.alias("bank"))
    fitted = rows.filter("l_orderkey % 2 = 0")
    for key in ("route", "carrier_route", "bank"):
        counts = fitted.groupBy(key).agg(F.count("*").alias(f"n_{key}"))
        rows = rows.join(counts, key, "left").withColumn(f"{key}_log", F.log1p(F.coalesce(f"n_{key}", F.lit(0))))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "route_log", "carrier_route_log", "bank_log")


@query(f"""WITH {SHIPMENTS}, p AS (SELECT origin, destination, carrier, count(*) AS n, sum(duration) AS d, sum(distance) AS m FROM shipments GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY n DESC, carrier) AS nth FROM p)
SELECT row_number() OVER (ORDER BY n DESC, origin, destination) AS rank, origin, destination, carrier, n, round_even(d / n, 2) AS mean_duration, round_even(m / n, 2) AS mean_distance
FROM r WHERE nth = 1 QUALIFY rank <= 18""")
def route_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 busiest routes, each by its busiest carrier."""
    profiles = shipments(spark, sf_dir).groupBy("origin", "destination", "carrier").agg(F.count("*").alias("n"), F.sum("duration").alias("d"), F.sum("distance").alias("m"))
    best = profiles.withColumn("nth", F.row_number().over(Window.partitionBy("origin", "destination").orderBy(F.col("n").desc(), "carrier"))).filter("nth = 1")
    top = best.orderBy(F.col("n").desc(), "origin", "destination").limit(18)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "origin", "destination")))
    return ranked.select("rank", "origin", "destination", "carrier", "n", F.bround(F.col("d") / F.col("n"), 2).alias("mean_duration"), F.bround(F.col("m") / F.col("n"), 2).alias("mean_distance"))


@query("""WITH f AS (SELECT month(o_orderdate)::INTEGER AS month, o_orderkey, o_totalprice, md5(o_orderkey::VARCHAR) AS h FROM orders),
m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT month FROM f)),
r AS (SELECT month, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY month ORDER BY h) AS place FROM f)
SELECT month, o_orderkey, o_totalprice, place FROM r JOIN m USING (month) WHERE place <= 1000 // c + CASE WHEN i < 1000 % c THEN 1 ELSE 0 END""")
def bounded_month_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), "o_orderkey", "o_totalprice")
    return op.bounded_sample(rows, "month", F.col("o_orderkey"), 1000).select("month", "o_orderkey", "o_totalprice", F.col("place").cast("long").alias("place"))


@query(f"""WITH {SHIPMENTS}, g AS (SELECT avg(late::DOUBLE) AS prior FROM shipments WHERE month <= 9), r AS (SELECT route, (sum(late) + 150 * any_value(prior)) / (count(*) + 150) AS rate FROM shipments, g WHERE month <= 9 GROUP BY route)
SELECT month, count(*) AS n, count(r.rate) AS n_known, sum(coalesce(r.rate, prior)) AS rate_sum FROM shipments LEFT JOIN r USING (route), g WHERE month > 9 GROUP BY month""")
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later months looked up in the frozen rates of earlier ones; unknown routes get the common rate."""
    rows = shipments(spark, sf_dir)
    early = rows.filter("month <= 9")
    prior = early.agg(F.avg(F.col("late").cast("double")).alias("prior"))
    known = early.groupBy("route").agg(F.sum("late").alias("pos"), F.count("*").alias("n_route")).join(F.broadcast(prior)).select("route", op.shrunk(F.col("pos"), F.col("n_route"), F.col("prior"), F.lit(150.0)).alias("rate"))
    later = rows.filter("month > 9").join(known, "route", "left").join(F.broadcast(prior))
    return later.groupBy("month").agg(F.count("*").alias("n"), F.count("rate").alias("n_known"), F.sum(F.coalesce("rate", "prior")).alias("rate_sum"))


@query(f"""WITH {LEGS}, c AS (SELECT *, CASE WHEN pred_us < 1705276800000000 THEN 1705276800000000 WHEN pred_us < 1705708800000000 THEN 1705708800000000
  WHEN pred_us < 1706140800000000 THEN 1706140800000000 WHEN pred_us < 1706572800000000 THEN 1706572800000000 END AS cutoff FROM legs)
SELECT record_id, CASE WHEN outcome_us >= cutoff THEN 'purged_immature' WHEN cutoff = 1705276800000000 THEN 'train' WHEN cutoff = 1705708800000000 THEN 'tune'
  WHEN cutoff = 1706140800000000 THEN 'calibration' WHEN cutoff = 1706572800000000 THEN 'test' ELSE 'excluded_after_test' END AS split FROM c""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.operators.splits import chronological

    ends = {"train": 1705276800000000, "tune": 1705708800000000, "calibration": 1706140800000000, "test": 1706572800000000}
    return legs(spark, sf_dir).select("record_id", chronological(F.col("pred_us"), F.col("outcome_us"), ends).alias("split"))


@query(f"""WITH {LEGS}, c AS (SELECT *, CASE WHEN pred_us < 1705276800000000 THEN 'train' WHEN pred_us < 1705708800000000 THEN 'tune'
  WHEN pred_us < 1706140800000000 THEN 'calibration' WHEN pred_us < 1706572800000000 THEN 'test' ELSE 'excluded_after_test' END AS split FROM legs)
SELECT split, count(*) AS n, min(pred_us) AS first_us, max(outcome_us) AS last_us, min(outcome_us) > (SELECT max(pred_us) FROM c WHERE split <> 'excluded_after_test') AS retrospective FROM c GROUP BY split""")
def retrospective_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No purge; instead it is told whether every outcome came to be known after the last prediction."""
    from portolan.operators.splits import chronological

    ends = {"train": 1705276800000000, "tune": 1705708800000000, "calibration": 1706140800000000, "test": 1706572800000000}
    rows = legs(spark, sf_dir).withColumn("split", chronological(F.col("pred_us"), None, ends))
    last = rows.filter("split <> 'excluded_after_test'").agg(F.max("pred_us").alias("last_pred"))
    groups = rows.groupBy("split").agg(F.count("*").alias("n"), F.min("pred_us").alias("first_us"), F.max("outcome_us").alias("last_us"), F.min("outcome_us").alias("first_outcome"))
    return groups.join(F.broadcast(last)).select("split", "n", "first_us", "last_us", (F.col("first_outcome") > F.col("last_pred")).alias("retrospective"))


@query(f"""WITH {LEGS} SELECT record_id, CASE WHEN pred_us < 1706140800000000 AND origin NOT IN (2, 5) AND destination NOT IN (2, 5)
  THEN CASE WHEN outcome_us >= 1706140800000000 THEN 'purged_immature' ELSE 'training' END
  WHEN pred_us >= 1706140800000000 AND (origin IN (2, 5) OR destination IN (2, 5)) THEN 'holdout_test' ELSE 'excluded' END AS split FROM legs""")
def region_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.operators.splits import holdout

    return legs(spark, sf_dir).select("record_id", holdout(F.array("origin", "destination"), F.array(F.lit(2), F.lit(5)).cast("array<bigint>"), F.col("pred_us"), F.col("outcome_us"), 1706140800000000).alias("split"))


@query(f"""WITH {SHIPMENTS} SELECT CASE WHEN month <= 9 THEN 'train' WHEN month <= 11 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(late)::BIGINT AS pos, avg(late::DOUBLE) AS rate FROM shipments GROUP BY 1""")
def month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("month") <= 9, "train").when(F.col("month") <= 11, "validation").otherwise("test")
    return shipments(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("late").alias("pos"), F.avg(F.col("late").cast("double")).alias("rate"))


_FIELDS = "UNION ALL".join(f" SELECT '{f}' AS field, {f}::VARCHAR AS value, {c} AS cap FROM part " for f, c in (("p_brand", 16), ("p_type", 64), ("p_size", 20)))


@query(f"""WITH k AS ({_FIELDS}), g AS (SELECT field, value, any_value(cap) AS cap, count(*) AS n FROM k GROUP BY ALL)
SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS rank FROM g QUALIFY rank <= cap""")
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked_vocabulary(table(spark, sf_dir, "part"), {"p_brand": 16, "p_type": 64, "p_size": 20})


@query("""WITH g AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
v AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS slot FROM g QUALIFY slot <= 16), t AS (SELECT count(*) AS total FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(slot, 0) AS slot, CASE WHEN slot IS NULL THEN 1 ELSE 0 END AS unknown, ln(1 + coalesce(n, 0)) AS log_count, coalesce(n, 0)::DOUBLE / total AS frequency FROM part LEFT JOIN v ON p_brand = value, t""")
def category_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot slot (0: unknown), log count and frequency from the vocabulary of the fitting half."""
    parts = table(spark, sf_dir, "part")
    fitted = parts.filter("p_partkey % 2 = 0")
    words = op.ranked_vocabulary(fitted, {"p_brand": 16}).select(F.col("value").alias("p_brand"), F.col("n").alias("n_value"), F.col("rank").alias("place"))  # 16 rows
    total = fitted.agg(F.count("*").alias("total"))
    joined = parts.select("p_partkey", "p_brand").join(F.broadcast(words), "p_brand", "left").join(F.broadcast(total))
    n = F.coalesce("n_value", F.lit(0))
    return joined.select("p_partkey", F.coalesce("place", F.lit(0)).alias("slot"), F.col("place").isNull().cast("int").alias("unknown"), F.log1p(n).alias("log_count"), (n / F.col("total")).alias("frequency"))


_FIELDS5 = {"p_brand": 16, "p_type": 3, "p_size": 20, "p_first": 5, "p_last": 64}
_PARTS5 = "t AS (SELECT p_partkey, p_size <= 30 AS fitted, p_brand, p_type, p_size::VARCHAR AS p_size, split_part(p_name, ' ', 1) AS p_first, CASE WHEN p_size % 9 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS p_last FROM part)"


@query(f"""WITH {_PARTS5}, k AS ({" UNION ALL ".join(f"SELECT p_partkey, fitted, {i} AS f, {c} AS value, {cap} AS cap FROM t" for i, (c, cap) in enumerate(_FIELDS5.items()))}),
g AS (SELECT f, value, any_value(cap) AS cap, count(*) AS n FROM k WHERE fitted GROUP BY ALL), v AS (SELECT f, value, n, row_number() OVER (PARTITION BY f ORDER BY n DESC, value) AS rank FROM g WHERE value IS NOT NULL QUALIFY rank <= cap),
w AS (SELECT f, count(*) AS known FROM v GROUP BY f), b AS (SELECT f, known, (sum(known + 3) OVER (ORDER BY f) - known - 3) AS base FROM w), m AS (SELECT count(*) AS total FROM t WHERE fitted),
x AS (SELECT p_partkey, base, known, rank, n, total FROM k JOIN b USING (f) LEFT JOIN v ON k.f = v.f AND k.value = v.value, m)
SELECT p_partkey, (CASE WHEN rank IS NULL THEN base + known ELSE base + rank - 1 END)::INTEGER AS place, 1.0::DOUBLE AS value FROM x UNION ALL SELECT p_partkey, (base + known + 1)::INTEGER, ln(1 + n) FROM x WHERE rank IS NOT NULL UNION ALL SELECT p_partkey, (base + known + 2)::INTEGER, n::DOUBLE / total FROM x WHERE rank IS NOT NULL""")
def sparse_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each part's sparse vector over five fields, by a vocabulary of the parts up to size 30."""
    from portolan.operators.categories import encoded, vocabulary
    from portolan.operators.running import settled

    first, last = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"), first.alias("p_first"), F.when(F.col("p_size") % 9 != 0, last).alias("p_last"))
    words = settled(vocabulary(parts.filter(F.col("p_size").cast("int") <= 30), _FIELDS5), "categories")  # at most as many rows as the caps add up to
    vectors = encoded(parts, words, list(_FIELDS5))
    return vectors.select("p_partkey", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")).select("p_partkey", F.col("e.indices").alias("place"), F.col("e.values").alias("value"))
