"""Stores replayed from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.operators import states as op
from portolan.operators.quotas import fixed_window
from portolan.operators.stores import bounded_store
from portolan.plans.registry import query
from portolan.sources.tables import table

HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "value", F.unix_micros("ts").alias("t"))


@query("SELECT user_id, event_type AS kind, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.upsert(_events(spark, sf_dir), ["user_id", "kind"], ["t", "event_id"]).select("user_id", "kind", "event_id", "value")


@query("""SELECT user_id, event_type AS kind, arg_min(event_id, ts) AS event_id, count(*) - 1 AS ignored, count(DISTINCT floor(value / 50)) > 1 AS conflict FROM events GROUP BY user_id, event_type""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.insert_or_ignore(_events(spark, sf_dir), ["user_id", "kind"], ["t", "event_id"], F.floor(F.col("value") / 50)).select("user_id", "kind", "event_id", "ignored", "conflict")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), w AS (SELECT user_id, min(t) AS s FROM e GROUP BY user_id
UNION ALL SELECT user_id, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.s + 86400000000) FROM w WHERE s IS NOT NULL),
a AS (SELECT e.user_id, event_id, t, s, row_number() OVER (PARTITION BY e.user_id, s ORDER BY t, event_id) AS k FROM e ASOF JOIN (SELECT * FROM w WHERE s IS NOT NULL) w ON e.user_id = w.user_id AND e.t >= w.s)
SELECT event_id, user_id, k <= 2 AS allowed, s AS opened, CASE WHEN k <= 2 THEN 0 ELSE greatest(1, ceil((s + 86400000000 - t) / 1000000.0))::BIGINT END AS retry_after FROM a""")
def fixed_window_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests a day for each user, the day beginning with the first request after the last day's end."""
    return fixed_window(_events(spark, sf_dir).select("event_id", "user_id", "t"), "user_id", "t", ["t", "event_id"], 24 * HOUR, 2).drop("t")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, NULL::BIGINT AS t, []::STRUCT(k BIGINT, o BIGINT, n BIGINT)[] AS held
UNION ALL SELECT i, event_id, user_id, t, CASE WHEN len(list_filter(live, lambda x: x.k = user_id)) > 0
THEN list_transform(live, lambda x: CASE WHEN x.k = user_id THEN {'k': x.k, 'o': x.o, 'n': x.n + 1} ELSE x END) ELSE list_append(live[greatest(len(live) - 8, 1):], {'k': user_id, 'o': t, 'n': 1::BIGINT}) END
FROM (SELECT e.i, e.event_id, e.user_id, e.t, list_filter(s.held, lambda x: x.o + 86400000000 > e.t) AS live FROM s JOIN e ON e.i = s.i + 1)),
a AS (SELECT event_id, user_id, t, unnest(list_filter(held, lambda x: x.k = user_id)) AS w FROM s WHERE i > 0)
SELECT event_id, user_id, w.n <= 2 AS allowed, w.o AS opened, CASE WHEN w.n <= 2 THEN 0 ELSE greatest(1, ceil((w.o + 86400000000 - t) / 1000000.0))::BIGINT END AS retry_after FROM a""")
def bounded_quota_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests a day for each user whose window is among the ten opened last."""
    return bounded_store(_events(spark, sf_dir).select("event_id", "user_id", "t"), "user_id", "t", ["t", "event_id"], 24 * HOUR, 2, 10).drop("t")


#: kind -> (states in which it applies, state after it)
RULES = {"signup": (("new", "closed"), "open"), "view": (("open",), "quoted"), "click": (("quoted",), "held"), "purchase": (("held", "quoted"), "booked"), "error": (("held", "booked", "quoted"), "closed")}
_RULES_SQL = "(VALUES ('signup', 'new', 'open'), ('signup', 'closed', 'open'), ('view', 'open', 'quoted'), ('click', 'quoted', 'held'), ('purchase', 'held', 'booked'), ('purchase', 'quoted', 'booked'), ('error', 'held', 'closed'), ('error', 'booked', 'closed'), ('error', 'quoted', 'closed')) AS r(kind, was, becomes)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS applied, 'new' AS state FROM events
UNION ALL SELECT s.user_id, e.i, e.event_id, r.becomes IS NOT NULL, coalesce(r.becomes, s.state) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1 LEFT JOIN {_RULES_SQL} ON r.kind = e.kind AND r.was = s.state)
SELECT event_id, applied, state FROM s WHERE i > 0""")
def guarded_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request of a booking with whether it applied, and the state after it."""
    rows = op.transitions(_events(spark, sf_dir).select("event_id", "user_id", "kind", "t"), "user_id", "t", ["t", "event_id"], "new", RULES, 24 * HOUR)
    return rows.select("event_id", "applied", "state")


@query("SELECT event_id, user_id FROM events WHERE epoch_us(ts) + 86400000000 * (1 + event_id % 5) > 1706140800000000")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("expires", F.col("t") + 24 * HOUR * (1 + F.col("event_id") % 5))
    return op.live(rows, "expires", F.lit(1706140800000000)).select("event_id", "user_id")


@query("""WITH x AS (SELECT event_id, user_id, epoch_us(ts) + 86400000000 AS expires FROM events), g AS (SELECT event_id FROM x WHERE expires <= 1706140800000000 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase') ORDER BY expires, event_id LIMIT 100)
SELECT event_id, user_id FROM x WHERE event_id NOT IN (SELECT event_id FROM g)""")
def bounded_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest expired rows go, but none that a purchase refers to."""
    rows = _events(spark, sf_dir).withColumn("expires", F.col("t") + 24 * HOUR)
    return op.expire(rows, "event_id", "expires", F.lit(1706140800000000), 100, rows.filter("kind = 'purchase'")).select("event_id", "user_id")


@query("""SELECT s.event_id FROM events s WHERE s.event_type = 'click' AND EXISTS (SELECT 1 FROM events v WHERE v.user_id = s.user_id AND v.event_type = 'signup' AND v.ts < s.ts) AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'error' AND p.ts < s.ts)""")
def guarded_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted only after a first sign-up and before a first error: bounds of each key, then a filter."""
    rows = _events(spark, sf_dir)
    first = rows.groupBy("user_id").agg(F.min(F.when(F.col("kind") == "signup", F.col("t"))).alias("from_"), F.min(F.when(F.col("kind") == "error", F.col("t"))).alias("until_"))
    kept = rows.filter("kind = 'click'").join(first, "user_id").filter("t > from_ and (until_ is null or t <= until_)")
    return kept.select("event_id")


@query("""SELECT 'user_id,event_type' AS key, count(*) > count(DISTINCT (user_id, event_type)) AS violated FROM events UNION ALL SELECT 'event_id', count(*) > count(DISTINCT event_id) FROM events UNION ALL SELECT 'user_id where purchase', count(*) > count(DISTINCT user_id) FROM events WHERE event_type = 'purchase'""")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each unique index, one of them partial, would be violated."""
    rows = _events(spark, sf_dir)
    checks = [("user_id,event_type", rows, ["user_id", "kind"]), ("event_id", rows, ["event_id"]), ("user_id where purchase", rows.filter("kind = 'purchase'"), ["user_id"])]
    out = None
    for name, source, key in checks:
        one = source.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("violated")).select(F.lit(name).alias("key"), "violated")
        out = one if out is None else out.unionByName(one)
    return out
