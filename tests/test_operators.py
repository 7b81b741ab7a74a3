"""Operators on cases that the tables lack, and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from portolan.operators import matching, metrics, models, rates, splits, states, temporal
from portolan.streaming import stores


def test_as_of_skips_nulls_and_is_inclusive(spark):
    seen = spark.createDataFrame([("a", 100, 1.0, None), ("a", 150, None, 5.0), ("a", 150, None, 7.0), ("b", 10, 2.0, 2.0), (None, 4, 9.0, 9.0)], "k string, t long, v double, w double")
    asked = spark.createDataFrame([(1, "a", 100), (2, "a", 160), (3, "a", 201), (4, "a", 99), (5, "c", 100), (6, "b", 110), (7, "b", 111), (8, None, 5)], "id int, k string, t long")
    got = {r.id: (r.v, r.v_age, r.w) for r in temporal.as_of(asked, seen, "k", "t", ["v", "w"], 100).collect()}
    assert got == {1: (1.0, 0, None), 2: (1.0, 60, 7.0), 3: (None, None, 7.0), 4: (None, None, None), 5: (None, None, None), 6: (2.0, 100, 2.0), 7: (None, None, None), 8: (None, None, None)}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_known_before_equals_counting(spark, span):
    rng = random.Random(span)
    events = [(rng.choice("ab"), rng.randrange(60), rng.randrange(3)) for _ in range(80)]
    asked = [(i, rng.choice("abc"), rng.randrange(70)) for i in range(60)]
    got = {r.id: r.x for r in temporal.known_before(spark.createDataFrame(asked, "id int, k string, t long"), spark.createDataFrame(events, "k string, t long, x long"), ["k"], "t", ["x"], span).collect()}
    assert got == {i: sum(x for k2, t2, x in events if k2 == k and t2 < t) for i, k, t in asked}


def test_ties_see_neither_each_other_nor_the_instant(spark):
    rows = spark.createDataFrame([(1, "k", 10, 1), (2, "k", 10, 1), (3, "k", 11, 1)], "id int, k string, t long, n long")
    got = {r.id: r.seen for r in temporal.known_before(rows.select("id", "k", "t"), rows.select("k", "t", F.col("n").alias("seen")), ["k"], "t", ["seen"], 100).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_latest_ranks_nulls_lowest(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3), ("b", None, 4)], "k string, t long, id int")
    assert {r.k: r.id for r in temporal.latest(rows, ["k"], [F.col("t"), F.col("id")]).collect()} == {"a": 2, "b": 4}


def test_immature_outcomes_are_purged_at_the_window_end(spark):
    rows = [(1, 5, 9), (2, 5, 10), (3, 10, 11), (4, 19, 20), (5, 20, 21)]
    df = spark.createDataFrame(rows, "id int, at long, known long").select("id", splits.chronological(F.col("at"), F.col("known"), {"train": 10, "test": 20}).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {1: "train", 2: "purged_immature", 3: "test", 4: "purged_immature", 5: "excluded_after_test"}


def test_every_row_of_a_join_has_one_fate(spark):
    left = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1), (4, 1)], "k int, n int")
    right = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (5, 1), (5, 1)], "k int, n int")
    rows = matching.exact_match(left, right, ["k", "n"], ["k"], ("plan", "fact")).collect()
    assert len(rows) == 10
    assert {(r.side, r.k, r.n, r.disposition, r.reason) for r in rows} == {
        ("plan", 1, 1, "matched", None), ("fact", 1, 1, "matched", None), ("plan", 2, 1, "unmatched", "key_differs"), ("fact", 2, 2, "unmatched", "key_differs"),
        ("plan", 3, 1, "ambiguous", "several_plan"), ("fact", 3, 1, "ambiguous", "several_plan"), ("plan", 4, 1, "unmatched", "no_identity"), ("fact", 5, 1, "ambiguous", "several_fact"),
    }
    with pytest.raises(ValueError, match="doubled"):
        matching.assert_empty(matching.conflicts(right, ["k"], ["n"]), "doubled")


def test_metrics_of_tied_scores(spark):
    rng = random.Random(1)
    cases = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)]
    (r,) = metrics.ranking(spark.createDataFrame([("s", p, y) for p, y in cases], "s string, p double, y int"), ["s"], "p", "y").collect()
    pos, neg = [p for p, y in cases if y], [p for p, y in cases if not y]
    assert math.isclose(r.auc, sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    ap, found = 0.0, 0
    for t in sorted({p for p, _ in cases}, reverse=True):
        at = [y for p, y in cases if p >= t]
        ap += (sum(at) - found) / len(pos) * sum(at) / len(at)
        found = sum(at)
    assert math.isclose(r.ap, ap)
    (one,) = metrics.ranking(spark.createDataFrame([("s", 0.5, 1)], "s string, p double, y int"), ["s"], "p", "y").collect()
    assert one.auc is None and one.log_loss is None and one.brier == 0.25


def test_bins_follow_their_edges(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.3,), (0.29999,), (1.0,), (0.7,)], "p double").select(metrics.bin_of(F.col("p"), 10)).collect()]
    assert got == [0, 3, 2, 9, 7]


def test_single_fold_has_no_rate(spark):
    rows = spark.createDataFrame([("x", 1, 1), ("y", 1, 0)], "k string, m int, f int")
    assert {r.rate for r in rates.out_of_fold(rows, {"k": 5.0}, "f", "m").collect()} == {None}


def test_budgets_are_nearly_equal(spark):
    rows = spark.createDataFrame([(m, i) for m in range(3) for i in range(10)], "m int, i int")
    counts = sorted(r["count"] for r in rates.bounded_sample(rows, "m", F.col("i"), 11).groupBy("m").count().collect())
    assert counts == [3, 4, 4]


def test_quota_windows_open_with_the_first_request(spark):
    rows = spark.createDataFrame([(i, "u", t) for i, t in enumerate([0, 5, 9, 10, 14, 21])], "id int, u string, t long")
    start, step = states.quota_step(10, 2)
    got = {r.id: (r.allowed, r.opened) for r in states.fold(rows, "u", ["t"], start, step, "allowed boolean, opened long, wait long").collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 0), 3: (True, 10), 4: (True, 10), 5: (True, 21)}


def test_spans_of_transitions_equal_one_fold(spark):
    rng = random.Random(5)
    rules = {"open": (("new", "shut"), "open"), "shut": (("open",), "shut"), "end": (("shut", "open"), "ended")}
    data = [(i, rng.choice(["a", "a", "a", "b", None]), None if i == 7 else rng.randrange(60), rng.choice(["open", "shut", "shut", "other", None] + ["end"] * (i % 9 == 0))) for i in range(300)]
    state, want = {}, {}
    for i, k, t, kind in sorted(data, key=lambda r: (-1 if r[2] is None else r[2], r[0])):
        expected, after = rules.get(kind, ((), None))
        was = state.get(k, "new")
        state[k] = after if was in expected else was
        want[i] = (was in expected, state[k])
    rows = spark.createDataFrame(data, "id int, k string, t long, kind string")
    for most in (1, 20, 1000):
        got = states.transitions(rows, "k", "t", ["t", "id"], "new", rules, 32, most)
        assert got.columns == ["id", "k", "t", "kind", "applied", "state"]
        assert {r.id: (r.applied, r.state) for r in got.collect()} == want
    assert states.transitions(rows.limit(0), "k", "t", ["t", "id"], "new", rules, 32).count() == 0


def test_trees_send_missing_values_to_their_side(spark):
    tree = {"feature": "x", "op": "<=", "threshold": 1.0, "missing": "no", "yes": {"leaf": 1.0}, "no": {"feature": "y", "op": ">", "threshold": 0, "missing": "yes", "yes": {"leaf": 2.0}, "no": {"leaf": 3.0}}}
    rows = spark.createDataFrame([(1.0, None), (1.5, None), (None, -1.0), (2.0, 0.0)], "x double, y double")
    assert [r[0] for r in rows.select(models.ensemble([tree], 0.5)).collect()] == [1.5, 2.5, 3.5, 3.5]


def test_platt_recovers_a_curve(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(4000):
        x = rng.uniform(-3, 3)
        rows.append((x, int(rng.random() < 1 / (1 + math.exp(-(1.5 * x - 0.5))))))
    slope, intercept = models.fit_platt(spark.createDataFrame(rows, "s double, y int"), "s", "y")
    assert abs(slope - 1.5) < 0.2 and abs(intercept + 0.5) < 0.2


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) as t")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = stores.latest_reports(stream, ["user_id"], ["t", "event_id"]).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    batch = states.upsert(spark.read.parquet(str(tmp_path / "in")), ["user_id"], ["t", "event_id"])
    assert {(r.user_id, r.event_id) for r in spark.table("latest").collect()} == {(r.user_id, r.event_id) for r in batch.collect()}
    window = 24 * 3_600_000_000
    run = stores.quota_decisions(stream, window, 2, forget=False).writeStream.outputMode("append").format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    start, step = states.quota_step(window, 2)
    folded = states.fold(spark.read.parquet(str(tmp_path / "in")), "user_id", ["t", "event_id"], start, step, "allowed boolean, opened long, wait long")
    assert {(r.event_id, r.allowed) for r in spark.table("quota").collect()} == {(r.event_id, r.allowed) for r in folded.collect()}


def test_cumulated_counts_in_buckets(spark):
    import random

    from portolan.operators.metrics import best_f1, cumulated, ranking

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.0, 1.0, 0.5, -3.0, 7.0]), rng.randrange(2)) for _ in range(400)]
    table = spark.createDataFrame(rows, "k string, score double, y int")
    cells = table.groupBy("k", "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    for r in cumulated(cells, ["k"], "score").collect():
        own = [x for x in rows if x[0] == r.k]
        low, high = [x for x in own if x[1] < r.score], [x for x in own if x[1] >= r.score]
        assert (r.below_n, r.below_pos, r.above_n, r.above_pos) == (len(low), sum(x[2] for x in low), len(high), sum(x[2] for x in high))
    assert ranking(table, [], "score", "y").count() == 1 and best_f1(table, ["k"], "score", "y").count() == 3


def test_spans_follow_the_density(spark):
    from portolan.operators.temporal import fitting_span, known_before

    events = spark.range(1000).selectExpr("'a' as k", "id % 500 as t", "1 as n")
    assert fitting_span(events, ["k"], "t", 1000, 2000) == 1000 and fitting_span(events, ["k"], "t", 1000, 50) <= 25
    asked = spark.createDataFrame([(i, "a", i) for i in range(0, 600, 37)], "q int, k string, t long")
    want = {(i, 2 * min(i, 500)) for i in range(0, 600, 37)}
    for most in (1, 50, 10_000):
        assert {(r.q, r.n) for r in known_before(asked, events, ["k"], "t", ["n"], 1000, most).collect()} == want


def test_boosted_trees_beat_a_constant(spark):
    from portolan.operators import models

    rows = spark.range(3000).selectExpr("cast(id % 97 as double) as a", "cast(id % 13 as double) as b", "cast(pmod(hash(id), 100) < (id % 97) as double) as y", "id % 5 = 0 as check", "id % 3 as part")
    model = models.fit_trees(rows.filter("part < 2"), ["a", "b"], "y", "check", rounds=8, depth=3)
    scored = models.margins(model, rows.filter("part = 2"), ["a", "b"])
    slope, intercept = models.fit_platt(scored, "raw_score", "y")
    assert slope > 0
    p = 1 / (1 + F.exp(-(F.col("raw_score") * slope + intercept)))
    brier, constant = scored.select(F.avg((p - F.col("y")) ** 2), F.var_pop("y")).first()
    assert brier < 0.9 * constant


def test_stored_models_are_checked_before_they_score(spark):
    tree = {"feature": "a", "op": "<", "threshold": 1.0, "missing": "no", "yes": {"leaf": -1.0}, "no": {"leaf": 1.0}}
    model = {"features": ["a"], "heads": [{"name": "late", "trees": [tree], "start": 0.0, "slope": 2.0, "intercept": 0.5}]}
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, a double")
    scored = models.score_heads(rows, model).withColumn("other", F.col("late") + F.when(F.col("id") == 2, 1e-3).when(F.col("id") == 3, F.lit(None)).otherwise(0.0))
    assert [round(r.late, 6) for r in scored.orderBy("id").collect()] == [0.182426, 0.924142, 0.924142]
    assert sorted(r.id for r in models.disparities(scored, "late", "other").collect()) == [2, 3]
    bad = {"features": ["a", "a"], "heads": [{"name": "late", "trees": [tree | {"feature": "z"}, {"leaf": float("nan")}, tree | {"op": "!="}, tree | {"no": None}], "start": 0.0, "slope": 0.0, "intercept": 0.0}]}
    assert models.model_faults(bad) == ["features", "late: calibration", "late: branch", "late: feature", "late: leaf", "late: node"]
    with pytest.raises(ValueError, match="faulty"):
        models.score_heads(rows, {"features": ["a"]})


def test_a_table_is_rebuilt_from_itself(spark):
    spark.createDataFrame([(1, "x"), (2, None)], "id int, v string").write.mode("overwrite").saveAsTable("rebuilt")
    states.rebuild_table(spark.table("rebuilt").filter("v is not null").withColumn("added", F.lit(0)), "rebuilt")
    assert [tuple(r) for r in spark.table("rebuilt").collect()] == [(1, "x", 0)]
    spark.sql("DROP TABLE rebuilt")
