"""Evidence and rankings of the request side: outlooks, offers, journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.functions import scores
from portolan.operators.running import exact_quantile
from portolan.operators.search import spread
from portolan.plans.registry import query
from portolan.sources.tables import LEGS, legs, table

_EVIDENCE = """e AS (SELECT origin, destination, count(*) AS observations, count(delay) AS known, count(*) FILTER (delay >= 15) AS late_15, count(*) FILTER (delay >= 30) AS late_30, count(*) FILTER (delay >= 60) AS late_60, floor(quantile_cont(delay, 0.5) FILTER (delay >= 15) + 0.5)::BIGINT AS typical_late,
min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM legs WHERE status = 'landed' GROUP BY ALL),
w AS (SELECT *, CASE WHEN known > 0 THEN floor((late_15 + 1)::DOUBLE / (known + 2) * 100 * 10 + 0.5) / 10 END AS laplace, late_15::DOUBLE / known AS p, 1.959963984540054::DOUBLE AS z FROM e),
c AS (SELECT *, (p + z * z / (2 * known)) / (1 + z * z / known) AS m, z / (1 + z * z / known) * sqrt(p * (1 - p) / known + z * z / (4 * known * known)) AS d FROM w),
i AS (SELECT *, floor(greatest(0, m - d) * 100 * 10 + 0.5) / 10 AS low, floor(least(1, m + d) * 100 * 10 + 0.5) / 10 AS high FROM c),
o AS (SELECT origin, destination, observations, known, late_15, late_30, late_60, typical_late, first_day, last_day, laplace, low, high, CASE WHEN known < 5 THEN 'insufficient' WHEN known < 20 OR high - low > 35 THEN 'limited' WHEN known < 50 OR high - low > 20 THEN 'moderate' ELSE 'strong' END AS confidence FROM i)"""


def _outlook(rows: DataFrame) -> DataFrame:
    late = {t: F.count_if(F.col("delay") >= t) for t in (15, 30, 60)}
    landed = rows.filter("status = 'landed'")
    groups = landed.groupBy("origin", "destination").agg(
        F.count("*").alias("observations"), F.count("delay").alias("known"), *[x.alias(f"late_{t}") for t, x in late.items()],
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"),
    )
    typical = exact_quantile(landed.filter("delay >= 15"), ["origin", "destination"], "delay", 0.5, "median_")
    groups = groups.join(typical, ["origin", "destination"], "left").withColumn("typical_late", F.floor(F.col("median_") + 0.5)).drop("median_")
    low, high = scores.wilson(F.col("late_15"), F.col("known"))
    groups = groups.withColumns({"laplace": scores.laplace(F.col("late_15"), F.col("known")), "low": low, "high": high})
    return groups.withColumn("confidence", scores.confidence(F.col("known"), F.col("low"), F.col("high")))


@query(f"WITH {LEGS}, {_EVIDENCE} SELECT * FROM o")
def historical_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a route was late, with its interval and what the sample is worth."""
    return _outlook(legs(spark, sf_dir))


@query(f"""WITH {LEGS}, {_EVIDENCE}, j AS (SELECT record_id, unnest([{{'a': origin, 'b': destination}}, {{'a': destination, 'b': (destination + 3) % 12}}]) AS l FROM legs),
x AS (SELECT j.record_id, o.* FROM j LEFT JOIN o ON o.origin = j.l.a AND o.destination = j.l.b)
SELECT record_id, CASE WHEN bool_and(coalesce(known >= 5 AND laplace IS NOT NULL, false)) THEN floor((1 - product(1 - laplace / 100)) * 100 + 0.5)::BIGINT END AS percent,
CASE WHEN bool_and(coalesce(known >= 5 AND laplace IS NOT NULL, false)) THEN ['limited', 'moderate', 'strong'][min(CASE confidence WHEN 'limited' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END)::INTEGER] END AS confidence FROM x GROUP BY record_id""")
def journey_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that any leg of a journey is late; nothing if evidence on one leg is insufficient; the weakest confidence."""
    rows = legs(spark, sf_dir)
    both = F.array(F.struct(F.col("origin").alias("a"), F.col("destination").alias("b")), F.struct(F.col("destination").alias("a"), ((F.col("destination") + 3) % 12).alias("b")))
    asked = rows.select("record_id", F.explode(both).alias("l"))
    found = asked.join(_outlook(rows), (F.col("l.a") == F.col("origin")) & (F.col("l.b") == F.col("destination")), "left")
    enough = F.bool_and(F.coalesce((F.col("known") >= 5) & F.col("laplace").isNotNull(), F.lit(False)))
    level = F.when(F.col("confidence") == "limited", 1).when(F.col("confidence") == "moderate", 2).otherwise(3)
    groups = found.groupBy("record_id").agg(enough.alias("enough"), F.product(1 - F.col("laplace") / 100).alias("none_late"), F.min(level).alias("level"))
    return groups.select("record_id", F.when(F.col("enough"), F.floor((1 - F.col("none_late")) * 100 + 0.5)).alias("percent"), F.when(F.col("enough"), F.element_at(F.array(*map(F.lit, ["limited", "moderate", "strong"])), F.col("level"))).alias("confidence"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS segments, count(*) FILTER (l_discount > 0) AS scored, max(l_discount) FILTER (l_discount > 0) AS p FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, p AS risk, CASE WHEN scored = 0 THEN 'unavailable' WHEN p < 0.16 THEN 'lower' WHEN p < 0.28 THEN 'moderate' ELSE 'higher' END AS level, CASE WHEN scored = 0 THEN NULL WHEN scored = segments THEN 'complete' ELSE 'partial' END AS coverage, segments, scored FROM g""")
def itinerary_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest segment risk of an itinerary, and whether all segments could be scored."""
    known = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("segments"), F.count(known).alias("scored"), F.max(known).alias("risk"))
    none = F.col("scored") == 0
    return groups.select("l_orderkey", "risk", F.when(none, "unavailable").otherwise(scores.risk_level(F.col("risk"))).alias("level"), F.when(~none, F.when(F.col("scored") == F.col("segments"), "complete").otherwise("partial")).alias("coverage"), "segments", "scored")


_OFFERS = """f AS (SELECT o_custkey, o_orderkey, round(sum(l_extendedprice), 2) AS price, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE sum(l_quantity) END AS minutes, count(*) - 1 AS stops, list_sort(list_distinct(list(l_returnflag))) AS airlines, bool_or(l_tax > 0.05) AS baggage, (o_orderkey % 24)::INTEGER AS hour
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey), k AS (SELECT * FROM f WHERE stops <= 5 AND baggage AND list_contains(airlines, 'N') AND hour >= 5 AND hour < 18 AND (minutes IS NULL OR minutes <= 200)),
b AS (SELECT *, min(price) OVER w AS p0, max(price) OVER w AS p1, min(minutes) OVER w AS m0, max(minutes) OVER w AS m1 FROM k WINDOW w AS (PARTITION BY o_custkey)),
s AS (SELECT *, 0.5 * CASE WHEN p1 > p0 THEN (price - p0) / (p1 - p0) ELSE 0 END + 0.35 * CASE WHEN minutes IS NULL THEN 1 WHEN m1 > m0 THEN (minutes - m0) / (m1 - m0) ELSE 0 END + 0.15 * least(stops, 2) / 2 AS score FROM b)"""


@query(f"""WITH {_OFFERS} SELECT o_custkey, o_orderkey, score::DOUBLE AS score, array_to_string(airlines, ',') AS airlines, row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 9), o_orderkey)::INTEGER AS best, row_number() OVER (PARTITION BY o_custkey ORDER BY price, o_orderkey)::INTEGER AS cheapest, row_number() OVER (PARTITION BY o_custkey ORDER BY minutes NULLS LAST, o_orderkey)::INTEGER AS fastest FROM s""")
def offer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's offers filtered, then ranked by price, by duration, and by a blend over what was left."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    offers = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.when(F.col("o_orderkey") % 13 != 0, F.sum("l_quantity")).alias("minutes"), (F.count("*") - 1).alias("stops"), F.sort_array(F.collect_set("l_returnflag")).alias("airlines"), F.bool_or(F.col("l_tax") > 0.05).alias("baggage"),
    )
    hour = F.col("o_orderkey") % 24
    kept = offers.filter((F.col("stops") <= 5) & F.col("baggage") & F.array_contains("airlines", "N") & (hour >= 5) & (hour < 18) & (F.col("minutes").isNull() | (F.col("minutes") <= 200)))
    search = Window.partitionBy("o_custkey")

    def scaled(c: str):
        low, high = F.min(c).over(search), F.max(c).over(search)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    score = 0.5 * scaled("price") + 0.35 * F.when(F.col("minutes").isNull(), 1.0).otherwise(scaled("minutes")) + 0.15 * F.least("stops", F.lit(2)) / 2
    kept = kept.withColumn("score", score)
    place = lambda *order: F.row_number().over(search.orderBy(*order, "o_orderkey"))
    return kept.select("o_custkey", "o_orderkey", "score", F.array_join("airlines", ",").alias("airlines"), place(F.round("score", 9)).alias("best"), place("price").alias("cheapest"), place(F.col("minutes").asc_nulls_last()).alias("fastest"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 2 * floor(value) ELSE floor(value) END::DOUBLE AS emissions, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_id % 4 = 0 THEN 'not_allowed' ELSE 'allowed' END AS rule, CASE WHEN event_type <> 'error' AND event_id % 4 <> 0 THEN greatest(value, 20) END AS penalty FROM events""")
def offer_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested offers: emissions in kilograms summed (none if none are told), and the strictest fare rule with the largest penalty."""
    kind, value = F.col("event_type"), F.col("value")
    emission = lambda w, u: F.struct(w.cast("double").alias("weight"), F.lit(u).alias("unit"))
    told = F.when(kind == "error", F.array(emission(value, "LB"))).when(kind == "click", F.array(emission(F.floor(value), "KG"), emission(F.floor(value), "KG"))).otherwise(F.array(emission(F.floor(value), "KG"), emission(value, "LB")))
    rule = lambda c, bar, p: F.struct(F.lit(c).alias("category"), bar.alias("barred"), p.alias("penalty"))
    rules = F.array(rule("REFUND", F.col("event_id") % 4 == 0, value), rule("REFUND", F.lit(False), F.lit(20.0)), rule("EXCHANGE", F.lit(True), F.lit(500.0)))
    rows = table(spark, sf_dir, "events").select("event_id", told.alias("emissions"), F.when(kind == "error", F.filter(rules, lambda r: r["category"] == "OTHER")).otherwise(rules).alias("rules"))
    kilos = F.filter("emissions", lambda e: (e["unit"] == "KG") & (e["weight"] >= 0))
    mine = F.filter("rules", lambda r: r["category"] == "REFUND")
    rows = rows.select("event_id", kilos.alias("kilos"), mine.alias("mine"))
    barred = F.exists("mine", lambda r: r["barred"])
    allowed = F.when(F.size("mine") == 0, "unknown").when(barred, "not_allowed").otherwise("allowed")
    return rows.select("event_id", F.when(F.size("kilos") > 0, F.aggregate("kilos", F.lit(0.0), lambda s, e: s + e["weight"])).alias("emissions"), allowed.alias("rule"), F.when(allowed == "allowed", F.array_max(F.transform("mine", lambda r: r["penalty"]))).alias("penalty"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, l_linenumber, l_suppkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS option, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS link, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
k AS (SELECT * FROM x WHERE option <= 6 AND link <= 8 AND l_returnflag IN ('A', 'R')), u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY option, link) AS seen FROM k)
SELECT o_custkey, option, link, l_suppkey FROM u WHERE seen = 1""")
def booking_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a search's first six options, eight each, from approved hosts, each address once."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    option = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    link = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    rows = rows.select("o_custkey", "l_suppkey", "l_returnflag", option.cast("long").alias("option"), link.cast("long").alias("link")).filter("option <= 6 and link <= 8").filter(F.col("l_returnflag").isin("A", "R"))
    first = rows.groupBy("o_custkey", "l_suppkey").agg(F.min(F.struct("option", "link")).alias("f"))
    return first.select("o_custkey", "f.option", "f.link", "l_suppkey")


@query("""WITH f AS (SELECT event_id, [abs(sin(event_id)), -abs(cos(event_id)), abs(sin(event_id * 2)), -abs(cos(event_id * 3)), value / 100] AS d FROM events), u AS (SELECT event_id, unnest(['month', 'hour', 'carrier', 'route', 'distance']) AS factor, unnest(d) AS delta FROM f)
SELECT event_id, factor, delta, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(delta), 12) DESC, factor)::INTEGER AS rank FROM u QUALIFY rank <= 3""")
def factor_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three factors of each case that move it most, within the row."""
    k = F.col("event_id")
    deltas = {"month": F.abs(F.sin(k)), "hour": -F.abs(F.cos(k)), "carrier": F.abs(F.sin(k * 2)), "route": -F.abs(F.cos(k * 3)), "distance": F.col("value") / 100}
    items = F.array(*[F.struct((-F.round(F.abs(d), 12)).alias("o"), F.lit(n).alias("factor"), d.alias("delta")) for n, d in deltas.items()])
    top = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.slice(F.array_sort(items), 1, 3)).alias("i", "f"))
    return top.select("event_id", "f.factor", "f.delta", (F.col("i") + 1).alias("rank"))


#: An order as an offer: its first two lines are the way out, the others the way back; prices in three ways of writing, two of them faulty at times.
_DOCUMENTS = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i FROM lineitem),
s AS (SELECT l_orderkey, i, l_shipdate, l_quantity, CASE WHEN l_quantity > 48 THEN 'x1' ELSE 'A' || chr((65 + l_suppkey % 26)::INTEGER) || chr((65 + l_partkey % 26)::INTEGER) END AS a, 'B' || chr((65 + l_partkey % 26)::INTEGER) || chr((65 + l_suppkey % 26)::INTEGER) AS b, l_returnflag || l_linestatus AS code, l_returnflag AS r, l_linestatus AS z, l_partkey,
  strftime(l_shipdate, '%Y-%m-%dT08:00:00') AS dep, strftime(l_shipdate + to_hours(6 + l_quantity::INTEGER), '%Y-%m-%dT%H:00:00') AS arr FROM l),
v AS (SELECT *, l_quantity > 2 AND l_quantity <= 48 AS sound, a || ':' || b || ':' || code || ':' || l_partkey || ':' || dep || ':' || arr AS ident FROM s),
g AS (SELECT l_orderkey, count(*) FILTER (i > 2) AS n_back, count(*) FILTER (i <= 2) AS n_out, bool_and(sound) AS sound, arg_min(a, i) AS first_a, arg_max(b, i) FILTER (i <= 2) AS out_b, min_by(dep, i) AS first_dep, string_agg(ident, '|' ORDER BY i) FILTER (i <= 2) AS out_ident, string_agg(ident, '|' ORDER BY i) FILTER (i > 2) AS back_ident,
  arg_min(a, i) FILTER (i > 2) AS back_a, arg_max(b, i) AS last_b, list(code || '=Air ' || r ORDER BY i) AS carriers, list(z || 'X=Op ' || z ORDER BY i) AS operators FROM v GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderstatus, g.*, CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'JPY' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'eur' ELSE 'KWD' END END AS currency, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN o_orderkey % 23 = 0 THEN '-5.00' ELSE (floor(o_totalprice)::BIGINT)::VARCHAR || '.25' END AS amount,
  CASE WHEN o_orderkey % 7 = 0 THEN 'business' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'economy' END AS cabin, o_orderkey % 17 = 0 AS self_transfer, o_orderkey % 19 = 0 AS other_way, o_orderkey % 29 = 0 AS other_day FROM orders JOIN g ON o_orderkey = l_orderkey)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as captured JSON, and what was asked for."""
    lines, k = table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    letter = lambda c: F.char((65 + F.col(c) % 26).cast("int"))
    carrier = lambda c, n: F.struct(c.alias("code"), n.alias("name"))
    stamp = lambda t, p: F.date_format(t, p)
    arrival = F.timestamp_micros(F.unix_micros("l_shipdate") + (6 + F.col("l_quantity").cast("int")).cast("long") * 3_600_000_000)
    segment = F.struct(
        F.when(F.col("l_quantity") > 48, "x1").otherwise(F.concat(F.lit("A"), letter("l_suppkey"), letter("l_partkey"))).alias("origin"), F.concat(F.lit("B"), letter("l_partkey"), letter("l_suppkey")).alias("destination"),
        stamp("l_shipdate", "yyyy-MM-dd'T08:00:00'").alias("departure"), stamp(arrival, "yyyy-MM-dd'T'HH:00:00").alias("arrival"), F.col("l_partkey").cast("string").alias("number"),
        carrier(F.concat("l_returnflag", "l_linestatus"), F.concat(F.lit("Air "), "l_returnflag")).alias("carrier"), carrier(F.concat("l_linestatus", F.lit("X")), F.concat(F.lit("Op "), "l_linestatus")).alias("operator"),
    )
    inner = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")] + [F.date_trunc("hour", "l_shipdate"), F.col("l_returnflag"), F.col("l_linestatus")]
    sorted_lines = spread(lines, "l_orderkey").sortWithinPartitions("l_orderkey", *inner)  # the narrow columns are moved and sorted once; segments are built behind that
    order = Window.partitionBy("l_orderkey").orderBy(*inner)
    listed = sorted_lines.select("l_orderkey", F.collect_list(segment).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("every"), F.row_number().over(order).alias("i")).filter("i = 1")  # an order's few lines
    rows = table(spark, sf_dir, "orders").join(listed, k == F.col("l_orderkey"))
    out, back = F.slice("every", 1, 2), F.slice("every", 3, 1 << 20)
    currency = F.when(F.col("o_orderstatus") == "F", "USD").when(F.col("o_orderstatus") == "O", "JPY").when(k % 3 == 0, "eur").otherwise("KWD")
    whole = F.floor("o_totalprice").cast("string")
    amount = F.when((F.col("o_orderstatus") == "O") & (k % 2 == 0), whole).when(k % 23 == 0, "-5.00").otherwise(F.concat(whole, F.lit(".25")))
    cabin = F.when(k % 7 == 0, "business").when(k % 5 != 0, "economy")
    document = F.to_json(F.struct(F.struct(amount.alias("amount"), currency.alias("currency")).alias("price"), cabin.alias("cabin"), (k % 17 == 0).alias("self_transfer"), F.struct(out.alias("segments")).alias("outbound"), F.when(F.size(back) > 0, F.struct(back.alias("segments"))).alias("inbound")))
    start, end = F.get("every", F.lit(0)), F.element_at(out, -1)
    first_day = F.to_date(F.substring(start["departure"], 1, 10))
    back_day = F.to_date(F.substring(F.get(back, F.lit(0))["departure"], 1, 10))
    return rows.select(
        "o_orderkey", document.alias("document"), F.when(k % 19 == 0, "ZZZ").otherwise(start["origin"]).alias("want_origin"), end["destination"].alias("want_destination"), F.when(k % 29 == 0, F.date_add(first_day, 1)).otherwise(first_day).alias("want_departure"),
        F.when(k % 4 != 0, back_day).alias("want_return"), F.lit("economy").alias("want_cabin"),
    )


@query(f"""WITH {_DOCUMENTS}, j AS (SELECT *, n_back > 0 AND o_orderkey % 4 <> 0 AS returns, CASE WHEN self_transfer THEN 'self_transfer' WHEN amount = '-5.00' OR currency = 'eur' THEN 'price' WHEN cabin = 'business' THEN 'cabin' WHEN (n_back > 0 AND o_orderkey % 4 <> 0) <> (n_back > 0) THEN 'return' WHEN NOT sound THEN 'segment' WHEN other_way OR other_day THEN 'itinerary' WHEN n_back > 0 AND (back_a <> out_b OR last_b <> first_a) THEN 'itinerary' END AS reject_reason FROM o),
a AS (SELECT o_orderkey, string_agg(x, ',' ORDER BY p) AS airlines FROM (SELECT o_orderkey, x, min(p) AS p FROM (SELECT o_orderkey, unnest(list_concat(carriers, operators)) AS x, unnest(list_concat(list_transform(range(len(carriers)), lambda i: 2 * i), list_transform(range(len(carriers)), lambda i: 2 * i + 1))) AS p FROM j WHERE reject_reason IS NULL) GROUP BY ALL) GROUP BY o_orderkey)
SELECT j.o_orderkey, reject_reason, CASE WHEN reject_reason IS NULL THEN currency END AS currency, CASE WHEN reject_reason IS NULL THEN CASE currency WHEN 'USD' THEN (amount::DECIMAL(18, 2) * 100)::BIGINT WHEN 'KWD' THEN (amount::DECIMAL(18, 2) * 1000)::BIGINT WHEN 'JPY' THEN CASE WHEN contains(amount, '.') THEN NULL ELSE amount::BIGINT END END END AS minor_units,
CASE WHEN reject_reason IS NULL THEN (n_out - 1 + CASE WHEN returns THEN n_back - 1 ELSE 0 END)::INTEGER END AS connections, airlines, CASE WHEN reject_reason IS NULL THEN 'slice-1|' || first_a || '|' || out_b || '|' || out_ident || CASE WHEN returns THEN '||slice-2|' || back_a || '|' || last_b || '|' || back_ident ELSE '' END END AS identity FROM j LEFT JOIN a ON j.o_orderkey = a.o_orderkey""")
def normalized_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured JSON of nested offers to rows: all or nothing on segments, carriers in first-seen order, amounts in minor units, an identity over all segments."""
    from portolan.operators.offers import normalized

    airlines = F.array_join(F.transform("airlines", lambda a: F.concat_ws("=", a["code"], a["name"])), ",").alias("airlines")
    return normalized(_documents(spark, sf_dir), "document").select("o_orderkey", "reject_reason", "currency", "minor_units", "connections", airlines, "identity")


@query(f"""WITH {_DOCUMENTS}, c AS (SELECT orders.o_custkey, o.o_orderkey, currency, o_totalprice AS price FROM o JOIN orders ON o.o_orderkey = orders.o_orderkey), w AS (SELECT *, min(price) OVER q AS low, max(price) OVER q AS high FROM c WINDOW q AS (PARTITION BY o_custkey)), n AS (SELECT o_custkey, count(DISTINCT currency) AS n_currencies, array_to_string(list_sort(list(DISTINCT currency)), ',') AS currencies FROM c GROUP BY o_custkey)
SELECT o_custkey, o_orderkey, n_currencies, currencies, CASE WHEN n_currencies > 1 THEN 0.5 WHEN high > low THEN (price - low) / (high - low) ELSE 0 END::DOUBLE AS price_part FROM w JOIN n USING (o_custkey)""")
def currency_aware_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's prices on a scale from its cheapest to its dearest offer, or 0.5 for all of them where their currencies differ."""
    docs = _documents(spark, sf_dir).select("o_orderkey", F.get_json_object("document", "$.price.currency").alias("currency"))
    offers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price")).join(docs, "o_orderkey")
    groups = offers.groupBy(F.col("o_custkey").alias("c_")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sort_array(F.collect_set("currency")).alias("currencies"))  # a few currencies
    rows = offers.join(groups, F.col("o_custkey") == F.col("c_"))
    part = F.when(F.size("currencies") > 1, 0.5).when(F.col("high") > F.col("low"), (F.col("price") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return rows.select("o_custkey", "o_orderkey", F.size("currencies").cast("long").alias("n_currencies"), F.array_join("currencies", ",").alias("currencies"), part.alias("price_part"))
