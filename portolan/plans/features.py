"""Calendar, clock and geography features, labels and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions import calendar, clocks, geo
from portolan.functions.schedule import REGIONS, schedule_vector
from portolan.operators.zones import located
from portolan.plans.registry import query
from portolan.sources.tables import LEGS, legs, table


@query("""SELECT o_orderkey, sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos, sin(2 * pi() * isodow(o_orderdate) / 7) AS weekday_sin, cos(2 * pi() * isodow(o_orderdate) / 7) AS weekday_cos,
sin(2 * pi() * day(o_orderdate) / 31) AS day_sin, cos(2 * pi() * day(o_orderdate) / 31) AS day_cos, sin(2 * pi() * (o_orderkey % 24) / 24) AS hour_sin, cos(2 * pi() * (o_orderkey % 24) / 24) AS hour_cos, (o_orderkey % 60) / 60::DOUBLE AS minute, isodow(o_orderdate) >= 6 AS weekend FROM orders""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, hour = F.col("o_orderdate"), F.col("o_orderkey") % 24
    out, weekday = [], F.weekday(day) + 1
    for name, value, period in (("month", F.month(day), 12), ("weekday", weekday, 7), ("day", F.dayofmonth(day), 31), ("hour", hour, 24)):
        sine, cosine = calendar.cycle(value, period)
        out += [sine.alias(f"{name}_sin"), cosine.alias(f"{name}_cos")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *out, ((F.col("o_orderkey") % 60) / 60).alias("minute"), (weekday >= 6).alias("weekend"))


_POINTS = "p AS (SELECT s_suppkey, ((s_suppkey * 37) % 160 - 80)::DOUBLE AS a, ((s_suppkey * 53) % 340 - 170)::DOUBLE AS b, ((s_nationkey * 29) % 140 - 70)::DOUBLE AS c, ((s_nationkey * 71) % 300 - 150)::DOUBLE AS d FROM supplier)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 37) % 160 - 80).cast("double").alias("a"), ((k * 53) % 340 - 170).cast("double").alias("b"), ((n * 29) % 140 - 70).cast("double").alias("c"), ((n * 71) % 300 - 150).cast("double").alias("d"))


@query(f"""WITH {_POINTS}, q AS (SELECT *, asin(sin(radians(a)) * cos(50 / 6371.0088::DOUBLE) + cos(radians(a)) * sin(50 / 6371.0088::DOUBLE) * cos(radians(45))) AS e FROM p)
SELECT s_suppkey, 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2))) AS km,
atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b))) AS bearing, cos(radians(a)) * cos(radians(b)) AS x, cos(radians(a)) * sin(radians(b)) AS y, sin(radians(a)) AS z, degrees(e) AS to_lat,
((degrees(radians(b) + atan2(sin(radians(45)) * sin(50 / 6371.0088::DOUBLE) * cos(radians(a)), cos(50 / 6371.0088::DOUBLE) - sin(radians(a)) * sin(e))) + 540) % 360) - 180 AS to_lon FROM q""")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing between two points, the first as a unit vector, and the point 50 km to its north-east."""
    a, b, c, d = (F.col(x) for x in "abcd")
    x, y, z = geo.unit_vector(a, b)
    lat, lon = geo.destination(a, b, F.lit(45.0), F.lit(50.0))
    out = _points(spark, sf_dir).select("s_suppkey", geo.great_circle(a, b, c, d).alias("km"), geo.bearing(a, b, c, d).alias("bearing"), x.alias("x"), y.alias("y"), z.alias("z"), lat.alias("to_lat"), lon.alias("to_lon"))
    return out


@query("""WITH f AS (SELECT event_id, ts, ts + to_minutes(((user_id % 5) - 2) * 60 + 30) AS l, ts + to_minutes((60 + event_id % 300)) AS arr, user_id FROM events)
SELECT event_id, sin(2 * pi() * dayofyear(l) / CASE WHEN year(l) % 4 = 0 THEN 366 ELSE 365 END) AS year_day_sin, cos(2 * pi() * (hour(l) + minute(l) / 60.0::DOUBLE) / 24) AS hour_cos, CASE WHEN isodow(l) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend, (60 + event_id % 300)::DOUBLE AS minutes, ln(1 + 60 + event_id % 300) AS minutes_log,
sin(2 * pi() * (hour(arr) + minute(arr) / 60.0::DOUBLE) / 24) AS arrival_sin, CASE WHEN user_id % 3 = event_id % 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS same_region, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS region_0, CASE WHEN user_id % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS region_1, CASE WHEN user_id % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS region_2 FROM f""")
def schedule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a published schedule alone; leap years are those divisible by four."""
    e = table(spark, sf_dir, "events")
    minutes = F.lit(60) + F.col("event_id") % 300
    local = F.timestamp_micros(F.unix_micros("ts") + (((F.col("user_id") % 5) - 2) * 60 + 30) * 60_000_000)
    arrival = F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000)
    clock = lambda t: F.hour(t) + F.minute(t) / 60
    days = F.when(F.year(local) % 4 == 0, 366).otherwise(365)
    flag = lambda x: x.cast("double")
    regions = [flag(F.col("user_id") % 3 == r).alias(f"region_{r}") for r in range(3)]
    return e.select("event_id", F.sin(2 * F.pi() * F.dayofyear(local) / days).alias("year_day_sin"), calendar.cycle(clock(local), 24)[1].alias("hour_cos"), flag(F.weekday(local) >= 5).alias("weekend"), minutes.cast("double").alias("minutes"), F.log1p(minutes).alias("minutes_log"), calendar.cycle(clock(arrival), 24)[0].alias("arrival_sin"), flag(F.col("user_id") % 3 == F.col("event_id") % 3).alias("same_region"), *regions)


@query(f"""WITH {LEGS} SELECT record_id, delay >= 15 AS late_15, delay >= 30 AS late_30, delay >= 60 AS late_60, status = 'cancelled' AS cancelled, status IN ('cancelled', 'diverted') AS disrupted FROM legs""")
def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay labels only for trips that arrived; cancelled and disrupted for all."""
    late = [(F.col("delay") >= t).alias(f"late_{t}") for t in (15, 30, 60)]
    return legs(spark, sf_dir).select("record_id", *late, (F.col("status") == "cancelled").alias("cancelled"), F.col("status").isin("cancelled", "diverted").alias("disrupted"))


@query("""WITH r AS (SELECT event_id, event_type, value, (event_id % 2600)::INTEGER AS hhmm, value BETWEEN 1 AND 80 AS ranged FROM events),
c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'cancelled' WHEN NOT (hhmm BETWEEN 0 AND 2400 AND hhmm % 100 < 60) THEN 'invalid_clock' WHEN NOT ranged THEN 'out_of_range' END AS reject_reason, CASE WHEN hhmm BETWEEN 0 AND 2400 AND hhmm % 100 < 60 THEN ((hhmm % 2400) // 100) * 2 + (hhmm % 100) // 30 END AS half_hour, CASE WHEN event_type <> 'click' AND value BETWEEN 2 AND 60 THEN value END AS reading FROM r)
SELECT event_id, reject_reason, half_hour, reading FROM c""")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the first reason to reject it, its half hour, and its reading unless its quality code or range is bad."""
    hhmm = (F.col("event_id") % 2600).cast("int")
    clock = calendar.valid_clock(hhmm)
    reason = F.when(F.col("event_type") == "error", "cancelled").when(~clock, "invalid_clock").when(~F.col("value").between(1, 80), "out_of_range")
    reading = F.when((F.col("event_type") != "click") & F.col("value").between(2, 60), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reject_reason"), F.when(clock, calendar.half_hour(hhmm)).alias("half_hour"), reading.alias("reading"))


@query("""WITH w AS (SELECT event_id, DATE '2024-03-09' + (event_id % 4)::INTEGER AS d, (event_id % 24) * 60 + (event_id * 7) % 60 AS m FROM events), l AS (SELECT event_id, d + to_minutes(m) AS l FROM w)
SELECT event_id, CASE WHEN l >= TIMESTAMP '2024-03-10 02:00' AND l < TIMESTAMP '2024-03-10 03:00' THEN NULL ELSE epoch_us(timezone('UTC', timezone('America/New_York', l))) END AS strict_us,
CASE WHEN l >= TIMESTAMP '2024-03-10 02:00' AND l < TIMESTAMP '2024-03-10 03:00' THEN epoch_us(TIMESTAMP '2024-03-10 07:00') ELSE epoch_us(timezone('UTC', timezone('America/New_York', l))) END AS shifted_us,
CASE WHEN l >= TIMESTAMP '2024-03-10 02:00' THEN -240 ELSE -300 END AS offset_after FROM l""")
def local_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local clocks around the hour that spring skips: refused or moved to its end, and the offset then."""
    day = F.date_add(F.lit("2024-03-09").cast("date"), (F.col("event_id") % 4).cast("int"))
    hhmm = ((F.col("event_id") % 24) * 100 + (F.col("event_id") * 7) % 60).cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", clocks.wall(day, hhmm).alias("l"))
    shifted = clocks.to_utc_shifting(F.col("l"), "America/New_York")
    return rows.select("event_id", F.unix_micros(clocks.to_utc_strict(F.col("l"), "America/New_York")).alias("strict_us"), F.unix_micros(shifted).alias("shifted_us"), clocks.offset_minutes(shifted, "America/New_York").alias("offset_after"))


#: Two neighbouring boxes and a third that overlaps the second, as (latitude, longitude) corners.
BOXES = [("west", [(-80, -170), (-80, 0), (80, 0), (80, -170)]), ("east", [(-80, 0), (-80, 170), (80, 170), (80, 0)]), ("far_east", [(0, 100), (0, 170), (80, 170), (80, 100)])]


@query("""WITH p AS (SELECT s_suppkey, ((s_suppkey * 37) % 160 - 80)::DOUBLE AS a, ((s_suppkey * 53) % 340 - 170)::DOUBLE AS b FROM supplier)
SELECT s_suppkey, CASE WHEN abs(a) > 79 OR abs(b) > 169 OR b = 0 OR (a = 0 AND b >= 100) OR (b = 100 AND a > 0) THEN NULL WHEN a > 0 AND b > 100 THEN NULL WHEN b < 0 THEN 'west' ELSE 'east' END AS zone FROM p""")
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that holds a point and a ring around it; none near a border or where boxes overlap."""
    rows = _points(spark, sf_dir).select("s_suppkey", "a", "b")
    boxes = spark.createDataFrame([(name, [[(float(b), float(a)) for a, b in ring]]) for name, ring in BOXES], "zone string, rings array<array<array<double>>>")
    return located(rows, boxes, "a", "b", size=8.0, band=8.0).select("s_suppkey", "zone")


#: A zone for each nation: a hexagon around its place with a hole of the same form in every second one; neighbours overlap.
_ZONES = """z AS (SELECT n_nationkey AS k, (n_nationkey % 5) * 60 - 120.0::DOUBLE AS x, (n_nationkey // 5) * 28 - 56.0::DOUBLE AS y, 26 + (n_nationkey * 7) % 13 + 0.25::DOUBLE AS w, 11 + (n_nationkey * 3) % 7 + 0.125::DOUBLE AS h FROM nation),
t AS (SELECT k, x, y, w, h, unnest([{'r': 1.0, 'i': 0}, {'r': 1.0, 'i': 1}, {'r': 1.0, 'i': 2}, {'r': 1.0, 'i': 3}, {'r': 1.0, 'i': 4}, {'r': 1.0, 'i': 5}, {'r': 0.5, 'i': 0}, {'r': 0.5, 'i': 1}, {'r': 0.5, 'i': 2}, {'r': 0.5, 'i': 3}, {'r': 0.5, 'i': 4}, {'r': 0.5, 'i': 5}]) AS c FROM z),
e AS (SELECT 'zone ' || k AS zone, x + w * c.r * [1.0, 0.5, -0.5, -1.0, -0.5, 0.5, 1.0][c.i + 1] AS x1, y + h * c.r * [0.0, 1.0, 1.0, 0.0, -1.0, -1.0, 0.0][c.i + 1] AS y1, x + w * c.r * [1.0, 0.5, -0.5, -1.0, -0.5, 0.5, 1.0][c.i + 2] AS x2, y + h * c.r * [0.0, 1.0, 1.0, 0.0, -1.0, -1.0, 0.0][c.i + 2] AS y2 FROM t WHERE c.r = 1 OR k % 2 = 0)"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = (n % 5) * 60 - 120.0, F.floor(n / 5) * 28 - 56.0
    w, h = 26 + (n * 7) % 13 + 0.25, 11 + (n * 3) % 7 + 0.125
    ring = lambda r: F.array(*[F.array((x + w * r * a).cast("double"), (y + h * r * b).cast("double")) for a, b in ((1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0))])
    rings = F.when(n % 2 == 0, F.array(ring(1.0), ring(0.5))).otherwise(F.array(ring(1.0)))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("zone "), n.cast("string")).alias("zone"), rings.alias("rings"))


@query(f"""WITH {_ZONES}, p AS (SELECT c_custkey, ((c_custkey * 104729) % 16000) / 100.0::DOUBLE - 80 AS a, ((c_custkey * 7919) % 36000) / 100.0::DOUBLE - 180 AS o FROM customer),
g AS (SELECT *, unnest([NULL, 0, 45, 90, 135, 180, 225, 270, 315]) AS b FROM p), s AS (SELECT *, radians(a) AS ra, radians(b::DOUBLE) AS rb, 80 / 6371.0088::DOUBLE AS d FROM g),
l AS (SELECT *, asin(sin(ra) * cos(d) + cos(ra) * sin(d) * cos(rb)) AS la FROM s),
q AS (SELECT c_custkey, b IS NULL AS home, CASE WHEN b IS NULL THEN a ELSE degrees(la) END AS y, CASE WHEN b IS NULL THEN o ELSE fmod(degrees(radians(o) + atan2(sin(rb) * sin(d) * cos(ra), cos(d) - sin(ra) * sin(la))) + 540, 360) - 180 END AS x FROM l),
i AS (SELECT c_custkey, home, x, y, zone FROM q, e GROUP BY ALL HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1),
n AS (SELECT q.c_custkey, q.home, count(i.zone) AS n, min(i.zone) AS zone FROM q LEFT JOIN i ON q.c_custkey = i.c_custkey AND q.home = i.home AND q.x = i.x AND q.y = i.y GROUP BY q.c_custkey, q.home, q.x, q.y),
f AS (SELECT c_custkey, max(n) FILTER (home) AS h, max(zone) FILTER (home) AS zone, bool_and(n = 1) AND min(zone) = max(zone) AS one FROM n GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN h = 1 AND one THEN zone END AS zone, CASE WHEN h = 0 THEN 'outside' WHEN h > 1 THEN 'overlap' WHEN one THEN 'resolved' ELSE 'near_border' END AS disposition FROM f""")
def zone_cover_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each customer's place and of a ring of 80 km around it, by a grid over the zones; the SQL tests every point against every edge."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", ((k * 104729) % 16000 / 100.0 - 80).alias("a"), ((k * 7919) % 36000 / 100.0 - 180).alias("o"))
    return located(points, _zones(spark, sf_dir), "a", "o", guard_km=80.0, size=4.0, band=0.5).select("c_custkey", "zone", "disposition")


_CANONICAL = """c AS (SELECT event_id, CASE event_id % 17 WHEN 0 THEN ' l h ' WHEN 1 THEN 'TOOLONG' ELSE 'LH' END AS carrier, CASE event_id % 19 WHEN 0 THEN '' ELSE (event_id % 1000)::VARCHAR END AS number, 'A' || chr((65 + user_id % 26)::INTEGER) || 'X' AS origin, 'A' || chr((65 + (user_id * 3) % 26)::INTEGER) || 'X' AS destination, ts AS departure, ts + to_minutes(CASE event_id % 23 WHEN 0 THEN 0 WHEN 1 THEN 2161 ELSE 60 + event_id % 300 END) AS arrival,
CASE event_type WHEN 'view' THEN 'Arrived' WHEN 'click' THEN ' canceled' WHEN 'signup' THEN 'delayed' ELSE 'landed' END AS status, (event_id % 191) - 95.0 AS latitude, (event_id % 361) - 180.0 AS longitude, CASE event_id % 29 WHEN 0 THEN 900 ELSE 60 END AS offset_minutes FROM events),
n AS (SELECT *, upper(replace(carrier, ' ', '')) AS k, CASE lower(trim(status)) WHEN 'arrived' THEN 'landed' WHEN 'canceled' THEN 'cancelled' WHEN 'landed' THEN 'landed' END AS s, date_diff('microsecond', departure, arrival) / 3600000000.0 AS h FROM c)"""


@query(f"""WITH {_CANONICAL} SELECT event_id, s AS status, CASE WHEN NOT regexp_full_match(k, '[A-Z0-9]{{2,3}}') THEN 'carrier' WHEN NOT regexp_full_match(number, '[A-Z0-9]{{1,6}}') THEN 'number' WHEN origin = destination THEN 'same_ends' WHEN NOT (h > 0 AND h <= 36) THEN 'duration' WHEN s IS NULL THEN 'status' WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'coordinates' WHEN NOT offset_minutes BETWEEN -840 AND 840 THEN 'offset' END AS reject_reason,
md5(k || '|' || number || '|' || origin || '|' || destination || '|' || epoch_us(departure)) AS leg_key FROM n""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows normalised, keyed and checked rule by rule."""
    from portolan.operators import validation as v

    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    letter = lambda n: F.concat(F.lit("A"), F.char(n + 65), F.lit("X"))
    minutes = F.when(k % 23 == 0, 0).when(k % 23 == 1, 2161).otherwise(F.lit(60) + k % 300)
    raw_status = F.when(F.col("event_type") == "view", "Arrived").when(F.col("event_type") == "click", " canceled").when(F.col("event_type") == "signup", "delayed").otherwise("landed")
    rows = e.select(
        "event_id", v.code(F.when(k % 17 == 0, " l h ").when(k % 17 == 1, "TOOLONG").otherwise("LH")).alias("carrier"), F.when(k % 19 == 0, "").otherwise((k % 1000).cast("string")).alias("number"), letter(u % 26).alias("origin"), letter((u * 3) % 26).alias("destination"),
        F.col("ts").alias("departure"), F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000).alias("arrival"), v.status(raw_status).alias("status"), (k % 191 - 95).cast("double").alias("latitude"), (k % 361 - 180).cast("double").alias("longitude"), F.when(k % 29 == 0, 900).otherwise(60).alias("offset_minutes"),
    )
    key = F.md5(F.concat_ws("|", "carrier", "number", "origin", "destination", F.unix_micros("departure").cast("string")))
    return v.audited(rows, v.canonical_rules()).select("event_id", "status", "reject_reason", key.alias("leg_key"))


@query(f"""WITH {_POINTS}, l AS (SELECT s_suppkey AS id, a AS lat, b AS lon, s_suppkey % 25 AS country, 'K' || (s_suppkey % 40) AS code FROM p), r AS (SELECT id, lat + CASE WHEN id % 5 = 0 THEN 0.03 WHEN id % 7 = 0 THEN 0.2 ELSE 0.001 END AS lat2, lon AS lon2, CASE WHEN id % 11 = 0 THEN 99 ELSE country END AS country2 FROM l WHERE id % 6 > 0),
j AS (SELECT l.*, lat2, country2, 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2))) AS km, count(*) OVER (PARTITION BY code) AS n FROM l LEFT JOIN r USING (id))
SELECT id, CASE WHEN lat2 IS NULL THEN 'no_reference' WHEN country <> country2 THEN 'country_differs' WHEN km > 5 THEN 'too_far' WHEN km > 1 THEN 'near_only' WHEN n > 2 THEN 'code_not_unique' ELSE 'accepted' END AS disposition, km FROM j""")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registries merged by exact code, with a check of country and distance, and of the short code's uniqueness."""
    k = F.col("s_suppkey")
    left = _points(spark, sf_dir).select(k.alias("id"), F.col("a").alias("lat"), F.col("b").alias("lon"), (k % 25).alias("country"), F.concat(F.lit("K"), (k % 40).cast("string")).alias("code"))
    shift = F.when(F.col("id") % 5 == 0, 0.03).when(F.col("id") % 7 == 0, 0.2).otherwise(0.001)
    right = left.filter("id % 6 > 0").select(F.col("id").alias("id2"), (F.col("lat") + shift).alias("lat2"), F.col("lon").alias("lon2"), F.when(F.col("id") % 11 == 0, 99).otherwise(F.col("country")).alias("country2"))
    uses = left.groupBy("code").agg(F.count("*").alias("n"))
    rows = left.join(right, F.col("id") == F.col("id2"), "left").join(uses, "code")
    km = geo.great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    fate = F.when(F.col("lat2").isNull(), "no_reference").when(F.col("country") != F.col("country2"), "country_differs").when(km > 5, "too_far").when(km > 1, "near_only").when(F.col("n") > 2, "code_not_unique").otherwise("accepted")
    return rows.select("id", fate.alias("disposition"), km.alias("km"))


_OUTCOMES = """c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'landed' WHEN 'click' THEN 'cancelled' WHEN 'signup' THEN 'diverted' WHEN 'purchase' THEN 'landed' ELSE 'scheduled' END AS status, ts AS departure, (user_id % 27 - 13) * 60 AS offset_minutes,
CASE WHEN event_id % 41 = 0 THEN ts::DATE ELSE (ts + to_minutes((user_id % 27 - 13) * 60))::DATE END AS service_date, CASE WHEN event_id % 5 > 0 THEN ts + to_minutes((event_id % 50)::INTEGER) END AS actual_departure,
CASE WHEN event_type IN ('view', 'purchase', 'signup') AND event_id % 6 > 0 OR event_id % 31 = 0 THEN ts + to_minutes((event_id % 300)::INTEGER) END AS actual_arrival, CASE WHEN event_type <> 'error' OR event_id % 13 = 0 THEN ts + to_minutes((event_id % 400)::INTEGER) END AS outcome_seen FROM events)"""


@query(f"""WITH {_OUTCOMES} SELECT event_id, CASE WHEN actual_arrival < actual_departure THEN 'actual_order' WHEN status IN ('cancelled', 'scheduled') AND actual_arrival IS NOT NULL THEN 'arrival_of_none' WHEN status = 'scheduled' AND outcome_seen IS NOT NULL THEN 'outcome_of_none'
WHEN status = 'landed' AND outcome_seen < actual_arrival THEN 'landed_early' WHEN status = 'diverted' AND outcome_seen < actual_departure THEN 'diverted_early' WHEN service_date <> (departure + to_minutes(offset_minutes))::DATE THEN 'service_date' END AS reject_reason FROM c""")
def canonical_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with their actual times and when these were seen, each with the first reason to reject it."""
    from portolan.operators import validation as v

    e, k, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    status = F.when(kind.isin("view", "purchase"), "landed").when(kind == "click", "cancelled").when(kind == "signup", "diverted").otherwise("scheduled")
    later = lambda minutes: F.timestamp_micros(F.unix_micros("ts") + minutes.cast("long") * 60_000_000)
    offset = (F.col("user_id") % 27 - 13) * 60
    rows = e.select(
        "event_id", status.alias("status"), F.col("ts").alias("departure"), offset.alias("offset_minutes"), F.to_date(F.when(k % 41 == 0, F.col("ts")).otherwise(later(offset))).alias("service_date"), F.when(k % 5 > 0, later(k % 50)).alias("actual_departure"),
        F.when((kind.isin("view", "purchase", "signup") & (k % 6 > 0)) | (k % 31 == 0), later(k % 300)).alias("actual_arrival"), F.when((kind != "error") | (k % 13 == 0), later(k % 400)).alias("outcome_seen"),
    )
    return v.audited(rows, v.outcome_rules()).select("event_id", "reject_reason")


_VECTOR = """b AS (SELECT event_id, ts AS dep, ts + to_minutes((60 + event_id % 300)::INTEGER) AS arr, (user_id % 5 - 2) * 60 + 30 AS oo, (event_id % 7 - 3) * 60 AS d_o, (user_id % 160) - 80.0::DOUBLE AS a, (user_id * 7 % 340) - 170.0::DOUBLE AS b, (event_id % 150) - 75.0::DOUBLE AS c, (event_id * 3 % 340) - 170.0::DOUBLE AS d,
  user_id % 9 AS oc, event_id % 9 AS dc, ['Africa', 'ASIA', 'Europe ', 'Middle-East', 'north  america', 'Oceania', 'South America', 'Atlantis'][1 + user_id % 8] AS orr, ['Africa', 'ASIA', 'Europe ', 'Middle-East', 'north  america', 'Oceania', 'South America', 'Atlantis'][1 + event_id % 8] AS dr, CASE WHEN event_id % 3 > 0 THEN 'A320' END AS craft FROM events),
l AS (SELECT *, dep + to_minutes(oo::INTEGER) AS ld, arr + to_minutes(d_o::INTEGER) AS la, (60 + event_id % 300)::DOUBLE AS mins, sin((radians(c) - radians(a)) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin((radians(d) - radians(b)) / 2) ** 2 AS h,
  atan2(sin(radians(d) - radians(b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d) - radians(b))) AS ang,
  {'africa': 'africa', 'asia': 'asia', 'europe': 'europe', 'middle east': 'middle_east', 'north america': 'north_america', 'oceania': 'oceania', 'south america': 'south_america', 'atlantis': 'other'} AS m FROM b),
t AS (SELECT *, 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(h))) AS km, ['africa', 'asia', 'europe', 'middle_east', 'north_america', 'oceania', 'south_america', 'other'] AS r, trim(regexp_replace(lower(replace(orr, '-', ' ')), '\\s+', ' ', 'g')) AS ro, trim(regexp_replace(lower(replace(dr, '-', ' ')), '\\s+', ' ', 'g')) AS rd FROM l),
u AS (SELECT *, CASE WHEN list_contains(r, replace(ro, ' ', '_')) THEN replace(ro, ' ', '_') ELSE 'other' END AS to_, CASE WHEN list_contains(r, replace(rd, ' ', '_')) THEN replace(rd, ' ', '_') ELSE 'other' END AS td FROM t)"""
_CIRCLES = {"month": "month(ld) / 12.0", "weekday": "isodow(ld) / 7.0", "year_day": "(dayofyear(ld) / (CASE WHEN year(ld) % 4 = 0 THEN 366.0 ELSE 365.0 END)::DOUBLE) / 1.0", "origin_departure_hour": "(hour(ld) + minute(ld) / 60.0::DOUBLE) / 24.0", "destination_arrival_hour": "(hour(la) + minute(la) / 60.0::DOUBLE) / 24.0", "utc_departure_hour": "(hour(dep) + minute(dep) / 60.0::DOUBLE) / 24.0"}


@query(f"""WITH {_VECTOR} SELECT event_id, {", ".join(f"sin(2 * pi() * {x}) AS {n}_sin, cos(2 * pi() * {x}) AS {n}_cos" for n, x in _CIRCLES.items())}, (isodow(ld) >= 6)::INTEGER::DOUBLE AS is_origin_weekend, mins AS scheduled_duration_minutes, ln(1 + mins) AS scheduled_duration_log1p, km AS great_circle_distance_km, ln(1 + km) AS great_circle_distance_log1p, sin(ang) AS bearing_sin, cos(ang) AS bearing_cos,
(d_o - oo) / 60.0::DOUBLE AS timezone_change_hours, (oc = dc)::INTEGER::DOUBLE AS same_country, (lower(orr) = lower(dr))::INTEGER::DOUBLE AS same_region, (oc <> dc)::INTEGER::DOUBLE AS is_international, cos(radians(a)) * cos(radians(b)) AS origin_ecef_x, cos(radians(a)) * sin(radians(b)) AS origin_ecef_y, sin(radians(a)) AS origin_ecef_z,
cos(radians(c)) * cos(radians(d)) AS destination_ecef_x, cos(radians(c)) * sin(radians(d)) AS destination_ecef_y, sin(radians(c)) AS destination_ecef_z, (craft IS NULL)::INTEGER::DOUBLE AS aircraft_family_missing, {", ".join(f"(to_ = '{r}')::INTEGER::DOUBLE AS origin_region_{r}, (td = '{r}')::INTEGER::DOUBLE AS destination_region_{r}" for r in REGIONS)} FROM u""")
def schedule_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 46 features of each published schedule."""
    k, u = F.col("event_id"), F.col("user_id")
    regions = F.array(*map(F.lit, ("Africa", "ASIA", "Europe ", "Middle-East", "north  america", "Oceania", "South America", "Atlantis")))
    number = lambda x: x.cast("double")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("departure"), F.timestamp_micros(F.unix_micros("ts") + (60 + k % 300) * 60_000_000).alias("arrival"), ((u % 5 - 2) * 60 + 30).alias("origin_offset"), ((k % 7 - 3) * 60).alias("destination_offset"),
        number(u % 160 - 80).alias("origin_lat"), number(u * 7 % 340 - 170).alias("origin_lon"), number(k % 150 - 75).alias("destination_lat"), number(k * 3 % 340 - 170).alias("destination_lon"), (u % 9).alias("origin_country"), (k % 9).alias("destination_country"),
        F.get(regions, (u % 8).cast("int")).alias("origin_region"), F.get(regions, (k % 8).cast("int")).alias("destination_region"), F.when(k % 3 > 0, "A320").alias("aircraft"),
    )
    return rows.select("event_id", *[v.alias(n) for n, v in schedule_vector().items()])
