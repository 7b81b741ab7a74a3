"""Joins with full accounting, membership, alignment and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.operators import matching as op
from portolan.plans.registry import query
from portolan.sources.tables import LEGS, SHIPMENTS, legs, schedules_and_outcomes, shipments, table

_MATCH = """k AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (l_linestatus = 'O') AS n_left, count(*) FILTER (l_linestatus = 'F') AS n_right FROM lineitem GROUP BY ALL),
i AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS any_left, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS any_right FROM lineitem GROUP BY ALL),
m AS (SELECT l_orderkey, l_linenumber, n_left, n_right, CASE WHEN n_left > 1 OR n_right > 1 THEN 'ambiguous' WHEN n_left = 0 OR n_right = 0 THEN 'unmatched' ELSE 'matched' END AS disposition,
CASE WHEN n_left > 1 AND n_right > 1 THEN 'several_on_both_sides' WHEN n_left > 1 THEN 'several_schedule' WHEN n_right > 1 THEN 'several_outcome' WHEN n_left = 0 AND any_left = 0 OR n_right = 0 AND any_right = 0 THEN 'no_identity' WHEN n_left = 0 OR n_right = 0 THEN 'key_differs' END AS reason
FROM k JOIN i USING (l_orderkey)), d AS (SELECT m.*, CASE l_linestatus WHEN 'O' THEN 'schedule' ELSE 'outcome' END AS side FROM lineitem JOIN m USING (l_orderkey, l_linenumber))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedules, outcomes = schedules_and_outcomes(spark, sf_dir)
    return op.exact_match(schedules, outcomes, ["l_orderkey", "l_linenumber"], ["l_orderkey"], ("schedule", "outcome"))


@query(f"WITH {_MATCH} SELECT l_orderkey, l_linenumber, side, disposition, reason, n_left, n_right FROM d")
def exact_one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("l_orderkey", "l_linenumber", "side", "disposition", "reason", "n_left", "n_right")


@query(f"WITH {_MATCH} SELECT side, disposition, coalesce(reason, 'none') AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM d GROUP BY 1, 2, 3")
def join_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each side met each fate, and their share of all."""
    groups = _matched(spark, sf_dir).groupBy("side", "disposition", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))
    return groups.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


@query(f"WITH {_MATCH}, e AS (SELECT DISTINCT side, reason, l_orderkey, l_linenumber FROM d WHERE reason IS NOT NULL) SELECT side, reason, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY side, reason ORDER BY l_orderkey, l_linenumber)::INTEGER AS example FROM e QUALIFY example <= 5")
def reason_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five keys of each reason, from keys alone; no task sorts more than a bound lets through."""
    schedules, outcomes = schedules_and_outcomes(spark, sf_dir)
    told = op.told_keys(schedules, outcomes, ["l_orderkey", "l_linenumber"], ["l_orderkey"], ("schedule", "outcome")).filter("reason is not null")
    sides = F.array_compact(F.array(F.when(F.col("n_left") > 0, "schedule"), F.when(F.col("n_right") > 0, "outcome")))
    rows = told.select(F.explode(sides).alias("side"), "reason", "l_orderkey", "l_linenumber")
    return op.first_of_each(rows, ["side", "reason"], ["l_orderkey", "l_linenumber"], 5, "example")


@query(f"""WITH {LEGS}, t AS (SELECT * FROM legs WHERE pred_us < 1704153600000000), r AS (SELECT *, origin || '_' || destination AS route FROM legs), u AS (SELECT DISTINCT origin || '_' || destination AS route FROM t)
SELECT record_id, carrier NOT IN (SELECT carrier FROM t) AS new_carrier, origin NOT IN (SELECT origin FROM t) AS new_origin, destination NOT IN (SELECT destination FROM t) AS new_destination, route NOT IN (SELECT route FROM u) AS new_route FROM r WHERE pred_us >= 1704153600000000""")
def cold_start_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a later trip's carrier, ends or route were never met on the first day."""
    rows = legs(spark, sf_dir).withColumn("route", F.concat_ws("_", F.col("origin").cast("string"), F.col("destination").cast("string")))
    start = 1704153600000000
    fields = ["carrier", "origin", "destination", "route"]
    return op.unseen(rows.filter(F.col("pred_us") >= start), rows.filter(F.col("pred_us") < start), fields).select("record_id", *[f"new_{f}" for f in fields])


@query("""WITH b AS (SELECT p_brand || '/' || (p_size % 10) AS code, p_partkey FROM part) SELECT code, count(*) AS n, min(p_partkey) AS first_key, count(*) > 1 AS collision FROM b GROUP BY code""")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code to key, and whether the code is ambiguous."""
    code = F.concat_ws("/", "p_brand", (F.col("p_size") % 10).cast("string"))
    return table(spark, sf_dir, "part").groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), (F.count("*") > 1).alias("collision"))


@query("""WITH a AS (SELECT c_name AS n, c_custkey AS k, c_nationkey AS x FROM customer), b AS (SELECT replace(s_name, 'Supplier', 'Customer') AS n, s_suppkey AS k, s_nationkey AS x FROM supplier),
j AS (SELECT a.n, a.k AS customer, b.k AS supplier, a.x, count(*) OVER (PARTITION BY a.n) AS ca, count(*) OVER (PARTITION BY b.n) AS cb FROM a JOIN b ON a.n = b.n) SELECT customer, supplier FROM j WHERE ca = 1 AND cb = 1""")
def unambiguous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join of two catalogues by name, only where the name is single on both sides."""
    left = table(spark, sf_dir, "customer").groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").alias("customer"), F.count("*").alias("n_l"))
    right = table(spark, sf_dir, "supplier").groupBy(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name")).agg(F.min("s_suppkey").alias("supplier"), F.count("*").alias("n_r"))
    return left.join(right, "name").filter("n_l = 1 and n_r = 1").select("customer", "supplier")


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
AND o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200)""")
def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated EXISTS, NOT EXISTS and a limited IN as semi, anti and left joins."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    richest = table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(200).select(F.col("c_custkey").alias("o_custkey"))
    kept = orders.join(richest, "o_custkey", "left_semi").join(lines.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    returned = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("returned", F.lit(True))
    return kept.join(returned, "o_orderkey", "left").select("o_orderkey", F.coalesce("returned", F.lit(False)).alias("returned"))


@query("""WITH s AS (SELECT DISTINCT ts::DATE AS snapshot FROM events), d AS (SELECT ts::DATE AS day, event_id FROM events WHERE event_type = 'purchase')
SELECT day, count(*) AS n, any_value(s.snapshot) AS snapshot FROM d LEFT JOIN s ON s.snapshot = d.day - 8 GROUP BY day""")
def snapshot_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each service day with the snapshot of eight days before, if there is one."""
    e = table(spark, sf_dir, "events")
    snapshots = e.select(F.to_date("ts").alias("snapshot")).distinct()
    days = e.filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(snapshots, F.col("snapshot") == F.date_sub("day", 8), "left").select("day", "n", "snapshot")


@query("""WITH m AS (SELECT * FROM orders WHERE date_trunc('month', o_orderdate) IN (DATE '1996-05-01', DATE '1996-06-01')) SELECT o_orderkey, month(o_orderdate)::INTEGER AS source_month FROM m WHERE date_trunc('month', o_orderdate + INTERVAL 9 HOUR) = DATE '1996-06-01'""")
def outcome_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target month in UTC read from its own source month and the one before, then filtered; the range reaches the scan."""
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.lit("1996-05-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp")))
    return rows.filter(F.trunc(F.col("o_orderdate") + F.expr("interval 9 hours"), "month") == F.lit("1996-06-01").cast("date")).select("o_orderkey", F.month("o_orderdate").alias("source_month"))


_UNIVERSE = "u AS (SELECT m AS month, c AS carrier FROM (SELECT unnest(generate_series(1, 12))::INTEGER AS m), (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO', 'XX']) AS c))"


@query(f"""WITH {SHIPMENTS}, {_UNIVERSE}, g AS (SELECT month, carrier, grouping(month, carrier) AS gid, count(*) AS n, sum(late)::BIGINT AS pos FROM shipments GROUP BY GROUPING SETS ((month, carrier), (month), (carrier), ())),
a AS (SELECT 'cell' AS scope, u.month, u.carrier, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos FROM u LEFT JOIN g ON g.gid = 0 AND g.month = u.month AND g.carrier = u.carrier)
SELECT * FROM a UNION ALL SELECT CASE gid WHEN 1 THEN 'month' WHEN 2 THEN 'carrier' ELSE 'total' END, month, carrier, n, pos FROM g WHERE gid > 0""")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by month and carrier, by each, and in all; cells without rows are filled with zeros."""
    rows = shipments(spark, sf_dir)
    sets = rows.groupingSets([["month", "carrier"], ["month"], ["carrier"], []], "month", "carrier").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum("late").alias("pos"))
    universe = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.explode(F.array(*map(F.lit, ["AF", "AO", "NF", "NO", "RF", "RO", "XX"]))).alias("carrier"))
    cells = universe.join(sets.filter("gid = 0").drop("gid"), ["month", "carrier"], "left").select(F.lit("cell").alias("scope"), "month", "carrier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    scope = F.when(F.col("gid") == 1, "month").when(F.col("gid") == 2, "carrier").otherwise("total")
    return cells.unionByName(sets.filter("gid > 0").select(scope.alias("scope"), "month", "carrier", "n", "pos"))


@query("""WITH b AS (SELECT event_type, event_id // 100000 AS block, count(*) AS n, sha256(string_agg(lpad(event_id::VARCHAR, 12, '0'), chr(10) ORDER BY lpad(event_id::VARCHAR, 12, '0'))) AS d FROM events GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY event_type""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over a group's sorted ids, one a line, whatever order the rows come in.

    Ids are hashed in blocks of a range first, then the blocks' digests in order, so that no task holds a group.
    """
    ids = table(spark, sf_dir, "events").select("event_type", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.floor(F.col("event_id") / 100_000).alias("block"))
    digest = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    blocks = ids.groupBy("event_type", "block").agg(F.count("*").alias("n"), digest(F.sort_array(F.collect_list("id"))).alias("d"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("block", "d"))), lambda x: x["d"])
    return blocks.groupBy("event_type").agg(F.sum("n").alias("n"), digest(in_order).alias("digest"))


@query(f"""WITH {SHIPMENTS}, m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM shipments), g AS (SELECT m, coalesce(lag(m) OVER (ORDER BY m) = (m - INTERVAL 1 MONTH)::DATE, true) AS ok FROM m)
SELECT origin % 6 AS region, count(*) AS n, count(*) >= 100 AS enough_rows, avg(CASE WHEN distance > 20000 THEN 1.0 ELSE 0 END)::DOUBLE AS complete, avg(CASE WHEN distance > 20000 THEN 1.0 ELSE 0 END) >= 0.9 AS complete_enough,
(SELECT count(*) FROM m) >= 24 AND (SELECT bool_and(ok) FROM g) AS months_enough FROM shipments GROUP BY 1""")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's gates: enough rows, complete enough, and 24 months without a gap."""
    from portolan.operators.temporal import consecutive_months

    rows = shipments(spark, sf_dir)
    months = consecutive_months(rows.select(F.trunc("o_orderdate", "month").alias("m")).distinct(), "m").agg(((F.count("*") >= 24) & F.bool_and("consecutive")).alias("months_enough"))
    full = F.avg((F.col("distance") > 20000).cast("double"))
    groups = rows.groupBy((F.col("origin") % 6).alias("region")).agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("enough_rows"), full.alias("complete"), (full >= 0.9).alias("complete_enough"))
    return groups.join(F.broadcast(months))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS n_facts FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(f"""WITH {SHIPMENTS}, p AS (SELECT CASE WHEN month <= 9 THEN 'train' ELSE 'test' END AS split, late = 1 AS a, l_shipdate > o_orderdate AS b, carrier LIKE 'R%' AS c FROM shipments)
SELECT split, count(*) FILTER (a IS DISTINCT FROM b) = 0 AS a_is_b, count(*) FILTER (a IS DISTINCT FROM c) = 0 AS a_is_c, count(*) FILTER (b IS DISTINCT FROM c) = 0 AS b_is_c FROM p GROUP BY split""")
def target_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are the same on every row of a split."""
    rows = shipments(spark, sf_dir).select(F.when(F.col("month") <= 9, "train").otherwise("test").alias("split"), (F.col("late") == 1).alias("a"), (F.col("l_shipdate") > F.col("o_orderdate")).alias("b"), F.col("carrier").startswith("R").alias("c"))
    same = lambda x, y: (F.count_if(~F.col(x).eqNullSafe(F.col(y))) == 0).alias(f"{x}_is_{y}")
    return rows.groupBy("split").agg(same("a", "b"), same("a", "c"), same("b", "c"))


@query(f"""WITH {LEGS} SELECT carrier, count(*) AS n, count(*) FILTER (delay IS NOT NULL) AS with_delay, count(*) FILTER (outcome_us - pred_us <= 1800000000) AS within_half_hour, count(*) FILTER (status IN ('landed', 'cancelled', 'diverted')) AS terminal,
count(*) FILTER (delay >= 15) AS late_15, count(*) FILTER (delay >= 30) AS late_30, count(*) FILTER (delay >= 60) AS late_60, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status <> 'landed') AS disrupted,
count(*) FILTER (delay >= 15) >= count(*) FILTER (delay >= 30) AND count(*) FILTER (delay >= 30) >= count(*) FILTER (delay >= 60) AS monotone FROM legs GROUP BY carrier""")
def operational_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is observed of each carrier, and its delays by threshold, which must not rise."""
    late = {t: F.count_if(F.col("delay") >= t) for t in (15, 30, 60)}
    return legs(spark, sf_dir).groupBy("carrier").agg(
        F.count("*").alias("n"), F.count("delay").alias("with_delay"), F.count_if(F.col("outcome_us") - F.col("pred_us") <= 1_800_000_000).alias("within_half_hour"), F.count_if(F.col("status").isin("landed", "cancelled", "diverted")).alias("terminal"),
        *[x.alias(f"late_{t}") for t, x in late.items()], F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.count_if(F.col("status") != "landed").alias("disrupted"), ((late[15] >= late[30]) & (late[30] >= late[60])).alias("monotone"),
    )


@query("""WITH a AS (SELECT o_orderdate::DATE AS day, date_diff('day', l_shipdate::DATE, o_orderdate::DATE) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT day, count(*) AS n, min(age)::INTEGER AS min_age, max(age)::INTEGER AS max_age, count(*) FILTER (age >= 7) AS eligible, count(*) FILTER (age < 7) AS too_recent, min(age) FILTER (age >= 7)::INTEGER AS youngest_eligible FROM a GROUP BY day""")
def schedule_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old schedules were on each service day, and how many were old enough."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.to_date("o_orderdate").alias("day"), F.datediff(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("age"))
    old = F.col("age") >= 7
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.count_if(old).alias("eligible"), F.count_if(~old).alias("too_recent"), F.min(F.when(old, F.col("age"))).alias("youngest_eligible"))


@query("""WITH u AS (SELECT unnest(['winter', 'spring', 'summer', 'autumn']) AS season), g AS (SELECT CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS s, user_id % 2 = 0 AS north FROM events),
h AS (SELECT CASE WHEN north THEN s ELSE CASE s WHEN 'winter' THEN 'summer' WHEN 'spring' THEN 'autumn' WHEN 'summer' THEN 'winter' ELSE 'spring' END END AS season FROM g)
SELECT season, count(h.season) AS n, count(h.season) > 0 AS covered FROM u LEFT JOIN h USING (season) GROUP BY season""")
def season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from portolan.functions.calendar import season

    found = table(spark, sf_dir, "events").groupBy(season(F.month("ts"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)).alias("season")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ["winter", "spring", "summer", "autumn"]))).alias("season"))
    return every.join(found, "season", "left").select("season", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


@query("""WITH d AS (SELECT ts + to_days((user_id * 11 % 800)::INTEGER) AS t, user_id % 2 = 0 AS north FROM events), p AS (SELECT CASE WHEN year(t) = 2024 THEN 'train' ELSE 'later' END AS part, strftime(t, '%Y-%m') AS month, CASE WHEN month(t) IN (12, 1, 2) THEN 'winter' WHEN month(t) <= 5 THEN 'spring' WHEN month(t) <= 8 THEN 'summer' ELSE 'autumn' END AS s, north FROM d),
q AS (SELECT part, month, CASE WHEN north THEN s ELSE CASE s WHEN 'winter' THEN 'summer' WHEN 'spring' THEN 'autumn' WHEN 'summer' THEN 'winter' ELSE 'spring' END END AS season FROM p), u AS (SELECT part, unnest(['summer', 'autumn', 'winter', 'spring']) AS season FROM (SELECT DISTINCT part FROM q))
SELECT part, 'month' AS kind, month AS name, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT u.part, 'season', u.season, count(q.season) FROM u LEFT JOIN q ON u.part = q.part AND u.season = q.season GROUP BY ALL""")
def month_and_season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part by month and by the season at their place; a season that a part lacks counts 0. One pass over the rows."""
    from portolan.functions.calendar import season

    at = F.timestamp_micros(F.unix_micros("ts") + (F.col("user_id") * 11 % 800).cast("long") * 86_400_000_000)
    rows = table(spark, sf_dir, "events").select(at.alias("t"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("latitude"))
    rows = rows.select(F.when(F.year("t") == 2024, "train").otherwise("later").alias("part"), F.date_format("t", "yyyy-MM").alias("month"), season(F.month("t"), F.col("latitude")).alias("season"))
    cells = rows.groupBy("part", "month", "season").agg(F.count("*").alias("n"))  # few: all else is on these
    kinds = F.array(F.struct(F.lit("month").alias("kind"), F.col("month").alias("name")), F.struct(F.lit("season").alias("kind"), F.col("season").alias("name")))
    counted = cells.select("part", F.explode(kinds).alias("k"), "n").select("part", "k.kind", "k.name", "n")
    none = cells.select("part", F.lit("season").alias("kind"), F.explode(F.array(*map(F.lit, ("summer", "autumn", "winter", "spring")))).alias("name"), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(none).groupBy("part", "kind", "name").agg(F.sum("n").alias("n"))


@query("""WITH s AS (SELECT c_custkey, 'K' || (c_custkey % 90) AS icao, CASE WHEN c_custkey % 3 = 0 THEN 'USW' ELSE 'USC' END || lpad((c_custkey * 37 % 1000)::VARCHAR, 5, '0') AS station, CASE c_custkey % 5 WHEN 0 THEN 'CITY AIRPORT' WHEN 1 THEN 'FIELD AP' WHEN 2 THEN 'MAP ROOM' ELSE c_mktsegment END AS name FROM customer),
a AS (SELECT 'K' || s_suppkey % 110 AS icao, count(*) AS n_suppliers FROM supplier GROUP BY ALL)
SELECT a.icao, n_suppliers, station, name FROM a LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY icao ORDER BY starts_with(station, 'USW') DESC, (contains(name, 'AIRPORT') OR contains(name, ' AP')) DESC, station, c_custkey) = 1) s ON a.icao = s.icao""")
def station_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each wanted place the station of its code that is preferred: first-order ones, then those at an airport, then by id; places without any keep nulls."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "CITY AIRPORT").when(k % 5 == 1, "FIELD AP").when(k % 5 == 2, "MAP ROOM").otherwise(F.col("c_mktsegment"))
    station = F.concat(F.when(k % 3 == 0, "USW").otherwise("USC"), F.lpad((k * 37 % 1000).cast("string"), 5, "0"))
    stations = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("K"), (k % 90).cast("string")).alias("icao"), station.alias("station"), name.alias("name"))
    wanted = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("K"), (F.col("s_suppkey") % 110).cast("string")).alias("icao")).agg(F.count("*").alias("n_suppliers"))
    order = F.struct(~F.startswith("station", F.lit("USW")), ~(F.contains("name", F.lit("AIRPORT")) | F.contains("name", F.lit(" AP"))), "station", "c_custkey")
    best = stations.groupBy("icao").agg(F.min_by(F.struct("station", "name"), order).alias("s"))  # a minimum, aggregated before the shuffle
    return wanted.join(best, "icao", "left").select("icao", "n_suppliers", "s.station", "s.name")


@query("""SELECT r_name AS name FROM region EXCEPT SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9500""")
def missing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected names that have no row."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 9500").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"))
    return regions.join(rich, "r_regionkey", "left_anti").select(F.col("r_name").alias("name"))


@query("""WITH u AS (SELECT s_name AS name, s_nationkey AS nation, 'a' AS source FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT s_name, (s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END)::INTEGER, 'b' FROM supplier WHERE s_suppkey % 3 > 0)
SELECT name, count(*) AS n_sources, min(nation) AS nation, count(DISTINCT nation) > 1 AS conflict FROM u GROUP BY name""")
def merged_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues in one, with the names on which they disagree."""
    s = table(spark, sf_dir, "supplier")
    a = s.filter("s_suppkey % 3 < 2").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = s.filter("s_suppkey % 3 > 0").select(F.col("s_name").alias("name"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)).alias("nation"))
    return a.unionByName(b).groupBy("name").agg(F.count("*").alias("n_sources"), F.min("nation").alias("nation"), (F.count_distinct("nation") > 1).alias("conflict"))
