"""Metrics, calibration, thresholds and gates over scored cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.scores import nonincreasing, platt, risk_level, support
from portolan.operators import metrics as op
from portolan.plans.registry import query
from portolan.sources.tables import SCORES, scores, table


def _auc_sql(by: str) -> str:
    """Brute-force pairs for AUC, cumulative counts of tied scores for AP."""
    return f"""c AS (SELECT {by}, score, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL),
w AS (SELECT *, rank_sum, sum(n) OVER d AS above, sum(pos) OVER d AS pos_above FROM (SELECT *, (sum(n) OVER (PARTITION BY {by} ORDER BY score) - n + (n + 1) / 2.0) AS rank_sum FROM c) WINDOW d AS (PARTITION BY {by} ORDER BY score DESC)),
m AS (SELECT {by}, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum(pos * rank_sum) AS ranks, sum(pos * pos_above::DOUBLE / above) AS precisions, sum(pos * (score - 1) ** 2 + (n - pos) * score ** 2) AS sq,
sum(-pos * ln(greatest(least(score, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE)) - (n - pos) * ln(1 - greatest(least(score, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE))) AS ll FROM w GROUP BY ALL)"""


_COLUMNS = "n, pos, pos::DOUBLE / n AS prevalence, CASE WHEN pos > 0 AND pos < n THEN ((ranks - pos * (pos + 1) / 2.0) / (pos * (n - pos)))::DOUBLE END AS auc, CASE WHEN pos > 0 AND pos < n THEN precisions / pos END AS ap, sq / n AS brier, CASE WHEN pos > 0 AND pos < n THEN ll / n END AS log_loss"


@query(f"WITH {SCORES}, s AS (SELECT slice, score, y FROM scores), {_auc_sql('slice')} SELECT slice, {_COLUMNS} FROM m")
def metrics_auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranking(scores(spark, sf_dir), ["slice"], "score", "y")


@query(f"""WITH {SCORES}, s AS (SELECT 'slice' AS dimension, slice::VARCHAR AS value, score, y FROM scores UNION ALL SELECT 'day', (dayofmonth(ts) % 3)::VARCHAR, score, y FROM scores UNION ALL SELECT 'kind', event_type, score, y FROM scores), {_auc_sql('dimension, value')}
SELECT dimension, value, {_COLUMNS} FROM m""")
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumns({"day": F.dayofmonth("ts") % 3, "kind": F.col("event_type")})
    return op.ranking(op.sliced(rows, ["slice", "day", "kind"], "score", "y"), ["dimension", "value"], "score", "y")


@query(f"""WITH {SCORES}, t AS (SELECT count(*) AS total FROM scores), s AS (SELECT 'slice' AS dimension, slice::VARCHAR AS value, y FROM scores UNION ALL SELECT 'kind', event_type, y FROM scores)
SELECT dimension, count(DISTINCT value) AS n_values, count(*) AS n, count(*) = (SELECT total FROM t) AS exhausts FROM s GROUP BY dimension""")
def slice_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the slices of each dimension add up to all rows."""
    rows = scores(spark, sf_dir).withColumn("kind", F.col("event_type"))
    total = rows.agg(F.count("*").alias("total"))
    groups = op.sliced(rows, ["slice", "kind"], "y").groupBy("dimension", "value").agg(F.count("*").alias("n")).groupBy("dimension").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"))
    return groups.join(F.broadcast(total)).select("dimension", "n_values", "n", (F.col("n") == F.col("total")).alias("exhausts"))


@query(f"""WITH {SCORES}, e AS (SELECT list_transform(range(1, 10), lambda i: i / 10.0::DOUBLE) AS edges), b AS (SELECT slice, len(list_filter(edges, lambda x: x <= score)) AS bin, score, y FROM scores, e),
c AS (SELECT slice, bin, count(*) AS n, avg(score) AS p, avg(y::DOUBLE) AS q FROM b GROUP BY ALL) SELECT slice, sum(n)::BIGINT AS n, sum(n * abs(p - q)) / sum(n) AS ece FROM c GROUP BY slice""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.calibration(scores(spark, sf_dir), ["slice"], "score", "y")


_THRESHOLDS = """c AS (SELECT slice, score, count(*) AS n, sum(y) AS pos FROM scores GROUP BY ALL), w AS (SELECT slice, score AS threshold, sum(n) OVER d AS k, sum(pos) OVER d AS tp, sum(n) OVER (PARTITION BY slice) AS a, sum(pos) OVER (PARTITION BY slice) AS p FROM c WINDOW d AS (PARTITION BY slice ORDER BY score DESC)),
t AS (SELECT slice, threshold, tp::BIGINT AS tp, (k - tp)::BIGINT AS fp, (p - tp)::BIGINT AS fn, (a - p - k + tp)::BIGINT AS tn, tp::DOUBLE / k AS precision, tp::DOUBLE / p AS recall, CASE WHEN tp > 0 THEN 2 * tp::DOUBLE / (k + p) ELSE 0 END AS f1, (tp + a - p - k + tp)::DOUBLE / a AS accuracy FROM w)"""


@query(f"WITH {SCORES}, {_THRESHOLDS} SELECT slice, threshold, tp, fp, fn, tn, precision, recall, f1, accuracy FROM t QUALIFY row_number() OVER (PARTITION BY slice ORDER BY round(f1, 12) DESC, threshold) = 1")
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.best_f1(scores(spark, sf_dir), ["slice"], "score", "y")


@query(f"""WITH {SCORES}, g AS (SELECT avg(y::DOUBLE) AS p FROM scores WHERE dayofmonth(ts) <= 20), s AS (SELECT slice, avg((score - y) ** 2) AS brier, avg((p - y) ** 2) AS constant_brier, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS constant_log_loss FROM scores, g WHERE dayofmonth(ts) > 20 GROUP BY slice)
SELECT slice, brier, constant_brier, constant_log_loss, 1 - brier / constant_brier AS improvement, constant_brier - brier >= 0.005 AS accepted FROM s""")
def reference_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later scores against the constant share of earlier cases, and whether the gain is worth taking."""
    rows = scores(spark, sf_dir)
    share = rows.filter(F.dayofmonth("ts") <= 20).agg(F.avg(F.col("y").cast("double")).alias("p"))
    late = rows.filter(F.dayofmonth("ts") > 20).join(F.broadcast(share))
    groups = late.groupBy("slice").agg(F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"), F.avg((F.col("p") - F.col("y")) ** 2).alias("constant_brier"), F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("constant_log_loss"))
    return groups.withColumn("improvement", 1 - F.col("brier") / F.col("constant_brier")).withColumn("accepted", F.col("constant_brier") - F.col("brier") >= 0.005)


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a >= b AND b >= c THEN a WHEN a < b AND (a + b) / 2 >= c THEN (a + b) / 2 WHEN b < c AND a >= (b + c) / 2 THEN a ELSE (a + b + c) / 3 END AS p15,
CASE WHEN a >= b AND b >= c THEN b WHEN a < b AND (a + b) / 2 >= c THEN (a + b) / 2 WHEN b < c AND a >= (b + c) / 2 THEN (b + c) / 2 ELSE (a + b + c) / 3 END AS p30,
CASE WHEN a >= b AND b >= c THEN c WHEN a < b AND (a + b) / 2 >= c THEN c WHEN b < c AND a >= (b + c) / 2 THEN (b + c) / 2 ELSE (a + b + c) / 3 END AS p60 FROM v""")
def isotonic_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of three rising delays made non-increasing."""
    rows = table(spark, sf_dir, "lineitem")
    a, b, c = nonincreasing(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("p15"), b.alias("p30"), c.alias("p60"))


@query("""WITH r AS (SELECT event_id, value / 25 - 2 AS x FROM events), p AS (SELECT event_id, 1 / (1 + exp(-(1.3 * x - 0.2))) AS p15, 1 / (1 + exp(-(0.9 * x - 0.1))) AS p30, 1 / (1 + exp(-(2 * x - 1))) AS cancelled, 1 / (1 + exp(-(1.5 * x - 1.2))) AS disrupted FROM r)
SELECT event_id, CASE WHEN p15 >= p30 THEN p15 ELSE (p15 + p30) / 2 END AS p15, CASE WHEN p15 >= p30 THEN p30 ELSE (p15 + p30) / 2 END AS p30, CASE WHEN disrupted >= cancelled THEN disrupted ELSE (cancelled + disrupted) / 2 END AS disrupted, CASE WHEN disrupted >= cancelled THEN cancelled ELSE (cancelled + disrupted) / 2 END AS cancelled FROM p""")
def calibrated_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores through their logistic curves, then each family made consistent."""
    x = F.col("value") / 25 - 2
    late = nonincreasing(platt(x, 1.3, -0.2), platt(x, 0.9, -0.1))
    off = nonincreasing(platt(x, 1.5, -1.2), platt(x, 2.0, -1.0))
    return table(spark, sf_dir, "events").select("event_id", late[0].alias("p15"), late[1].alias("p30"), off[0].alias("disrupted"), off[1].alias("cancelled"))


@query("""WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_route, count(*) FILTER (event_type = 'view') AS n_carrier, avg(value) / 100 AS p FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n = 0 THEN '0' WHEN n < 100 THEN '1-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS support, CASE WHEN p < 0.16 THEN 'lower' WHEN p < 0.28 THEN 'moderate' ELSE 'higher' END AS risk,
CASE WHEN n >= 70 THEN 'established' WHEN greatest(n_route, n_carrier) >= 15 THEN 'partial' ELSE 'cold_start' END AS tier, CASE WHEN n >= 70 THEN 'all' WHEN greatest(n_route, n_carrier) >= 15 THEN CASE WHEN n_route >= n_carrier THEN 'route' ELSE 'carrier' END END AS strongest FROM c""")
def coverage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a key is known: by itself, by a wider level, or not at all."""
    groups = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_route"), F.count_if(F.col("event_type") == "view").alias("n_carrier"), (F.avg("value") / 100).alias("p"))
    partial = F.greatest("n_route", "n_carrier") >= 15
    tier = F.when(F.col("n") >= 70, "established").when(partial, "partial").otherwise("cold_start")
    strongest = F.when(F.col("n") >= 70, "all").when(partial & (F.col("n_route") >= F.col("n_carrier")), "route").when(partial, "carrier")
    return groups.select("user_id", support(F.col("n")).alias("support"), risk_level(F.col("p")).alias("risk"), tier.alias("tier"), strongest.alias("strongest"))


#: Two small trees as an export would hold them.
TREES = [
    {"feature": "score", "op": "<=", "threshold": 0.3, "missing": "no", "yes": {"leaf": -0.4}, "no": {"feature": "slice", "op": ">", "threshold": 2, "missing": "yes", "yes": {"leaf": 0.25}, "no": {"leaf": 0.1}}},
    {"feature": "gust", "op": ">=", "threshold": 40, "missing": "yes", "yes": {"leaf": 0.2}, "no": {"feature": "score", "op": "<", "threshold": 0.5, "missing": "no", "yes": {"leaf": -0.1}, "no": {"leaf": 0.3}}},
]


@query(f"""WITH {SCORES}, g AS (SELECT s.*, CASE WHEN e.event_type = 'view' THEN NULL ELSE e.value END AS gust FROM scores s JOIN events e USING (event_id)),
r AS (SELECT event_id, CASE WHEN score <= 0.3 THEN -0.4 WHEN slice > 2 THEN 0.25 ELSE 0.1 END + CASE WHEN gust IS NULL OR gust >= 40 THEN 0.2 WHEN score < 0.5 THEN -0.1 ELSE 0.3 END AS raw FROM g) SELECT event_id, raw::DOUBLE AS raw, 1 / (1 + exp(-(1.5 * raw - 0.3)))::DOUBLE AS p FROM r""")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees given as data, each one expression inside code generation; missing values go to their default side."""
    from portolan.operators.models import ensemble

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("gust"))
    rows = scores(spark, sf_dir).join(e, "event_id")
    raw = ensemble(TREES)
    return rows.select("event_id", raw.alias("raw"), platt(raw, 1.5, -0.3).alias("p"))


@query(f"""WITH {SCORES}, k AS (SELECT DISTINCT user_id FROM events WHERE dayofmonth(ts) <= 3), s AS (SELECT CASE WHEN user_id IN (SELECT user_id FROM k) THEN 'seen' ELSE 'new' END AS membership, score, y FROM scores JOIN events USING (event_id) WHERE dayofmonth(scores.ts) > 3), {_auc_sql('membership')} SELECT membership, {_COLUMNS} FROM m""")
def cold_start_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics apart for keys met in the fitting days and for new ones."""
    from portolan.operators.matching import unseen

    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = scores(spark, sf_dir).join(users, "event_id")
    marked = unseen(rows.filter(F.dayofmonth("ts") > 3), rows.filter(F.dayofmonth("ts") <= 3), ["user_id"])
    return op.ranking(marked.withColumn("membership", F.when(F.col("new_user_id"), "new").otherwise("seen")), ["membership"], "score", "y")


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees fitted on early cases with early stopping, calibrated on later ones, and measured on the last. No SQL states a fit."""
    from portolan.operators import models

    e = table(spark, sf_dir, "events").select("event_id", F.col("value"), F.hour("ts").cast("double").alias("hour"), (F.col("user_id") % 8).cast("double").alias("carrier"), (F.col("event_type") == "purchase").cast("double").alias("y"), F.dayofmonth("ts").alias("day"))
    features = ["value", "hour", "carrier"]
    model = models.fit_trees(e.filter("day <= 15").withColumn("check", F.col("day") > 12), features, "y", "check", rounds=8, depth=3)
    scored = models.margins(model, e.filter("day > 15"), features)
    try:
        slope, intercept = models.fit_platt(scored.filter("day <= 20"), "raw_score", "y")
    except ValueError:  # nothing was learned; the scores stay as they are
        slope, intercept = 1.0, 0.0
    return op.ranking(scored.filter("day > 20").select(F.lit("test").alias("part"), platt(F.col("raw_score"), slope, intercept).alias("score"), F.col("y").cast("int").alias("y")), ["part"], "score", "y")


@query("SELECT dayofmonth(ts)::INTEGER AS day, count(*) AS n, true AS agrees FROM events WHERE dayofmonth(ts) > 20 GROUP BY ALL")
def exported_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted trees written as data and scored as expressions, against the fitted model, for every case of the last days; they may differ by 1e-9."""
    from portolan.operators import models

    e = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"), (F.col("user_id") % 8).cast("double").alias("carrier"), (F.col("event_type") == "purchase").cast("double").alias("y"), F.dayofmonth("ts").alias("day"))
    features = ["value", "hour", "carrier"]
    model = models.fit_trees(e.filter("day <= 15").withColumn("check", F.col("day") > 12), features, "y", "check", rounds=4, depth=3)
    scored = models.margins(model, e.filter("day > 20"), features).withColumn("exported", models.ensemble(models.exported(model, features)))
    close = F.coalesce(F.abs(F.col("raw_score") - F.col("exported")) <= 1e-9, F.lit(False))
    return scored.groupBy("day").agg(F.count("*").alias("n"), F.bool_and(close).alias("agrees"))


HEADS = ["late_15", "late_30", "late_60", "cancelled", "disrupted"]


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with what is known when they are predicted, their labels, and their part in time."""
    from portolan.operators.splits import chronological
    from portolan.operators.temporal import known_before
    from portolan.sources.tables import legs

    rows = legs(spark, sf_dir)
    past = rows.select("origin", F.col("outcome_us").alias("pred_us"), F.lit(1).alias("seen"), (F.coalesce(F.col("delay") >= 15, F.lit(False))).cast("int").alias("seen_late"))
    told = known_before(rows, past, ["origin"], "pred_us", ["seen", "seen_late"], 5 * 86_400_000_000)
    ends = {"train": 1705276800000000, "tune": 1705708800000000, "calibration": 1706140800000000, "test": 1706572800000000}
    labels = {f"late_{t}": (F.col("delay") >= t).cast("int") for t in (15, 30, 60)} | {"cancelled": (F.col("status") == "cancelled").cast("int"), "disrupted": F.col("status").isin("cancelled", "diverted").cast("int")}
    return told.select("record_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "carrier", "origin", "destination", ((F.col("seen_late") + 1) / (F.col("seen") + 2)).alias("rate"), chronological(F.col("pred_us"), F.col("outcome_us"), ends).alias("split"), *[v.alias(k) for k, v in labels.items()])


@query()
def five_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five heads fitted in order of time, scored as expressions, made consistent and measured on the last part, beside the constant share of the first. No SQL states a fit."""
    from portolan.operators import models
    from portolan.operators.running import settled

    cases = settled(_cases(spark, sf_dir), "heads-cases")
    model = models.fit_heads(cases, ["hour", "weekday", "carrier", "origin", "destination", "rate"], HEADS, "split")
    test = cases.filter("split = 'test'").withColumnsRenamed({h: f"y_{h}" for h in HEADS})
    scored = models.consistent(models.score_heads(test, model), [HEADS[:3], ["disrupted", "cancelled"]])
    pairs = F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("score"), F.col(f"y_{h}").alias("y"), F.lit(model["prevalence"][h]).cast("double").alias("share")) for h in HEADS])
    long = scored.select(F.explode(pairs).alias("p")).select("p.*").filter("y is not null")
    constant = long.groupBy("head").agg(F.avg((F.col("share") - F.col("y")) ** 2).alias("constant_brier"))
    return op.ranking(long, ["head"], "score", "y").join(constant, "head")
