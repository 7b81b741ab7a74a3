"""Offers, sparse categories, outcome rules and accounting on cases that the tables lack."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from portolan.operators import categories, models, offers, temporal, validation


def segment(a, b, start, end, number="12", carrier=("LH", "Lufthansa"), operator=("LH", "Lufthansa")):
    return {"origin": a, "destination": b, "departure": start, "arrival": end, "number": number, "carrier": dict(zip(("code", "name"), carrier)), "operator": dict(zip(("code", "name"), operator))}


OUT = [segment("FRA", "MUC", "2024-05-01T08:00:00", "2024-05-01T09:00:00"), segment("MUC", "LIS", "2024-05-01T10:00:00", "2024-05-01T13:00:00", carrier=("TP", "TAP"), operator=(None, "Charter"))]
BACK = [segment("LIS", "FRA", "2024-05-09T08:00:00", "2024-05-09T12:00:00", carrier=("TP", "TAP"))]


def offer(out=OUT, back=BACK, **more):
    whole = {"price": {"amount": "120.50", "currency": "EUR"}, "cabin": "economy", "outbound": {"segments": out}} | ({"inbound": {"segments": back}} if back is not None else {})
    return json.dumps(whole | more)


def test_offers_are_taken_whole_or_not_at_all(spark):
    broken = lambda **change: [OUT[0], OUT[1] | change]
    cases = [
        (offer(), None), (offer(cabin=None), None), (offer(unknown=[1]), None), ("no json", "document"), (None, "document"), ("{}", "document"), ("[]", "document"), (offer(self_transfer=True), "self_transfer"),
        (offer(price={"amount": "-1", "currency": "EUR"}), "price"), (offer(price={"amount": "0", "currency": "EUR"}), "price"), (offer(price={"amount": "1", "currency": "euro"}), "price"), (offer(price=None), "price"), (offer(cabin="first"), "cabin"),
        (offer(back=None), "return"), (offer(out=broken(origin="M1")), "segment"), (offer(out=broken(arrival="2024-05-01T10:00:00")), "segment"), (offer(out=broken(arrival="later")), "segment"), (offer(out=broken(number=" ")), "segment"),
        (offer(out=broken(carrier=None)), "segment"), (offer(out=broken(destination=None)), "segment"), (offer(out=[]), "segment"), (offer(back=[]), "segment"), (offer(outbound=None), "segment"), (offer(out=OUT[:1]), "itinerary"), (offer(back=OUT), "itinerary"),
    ]
    day = dt.date(2024, 5, 1)
    raw = spark.createDataFrame([(i, d, "FRA", "LIS", day, dt.date(2024, 5, 9), "economy", "kept") for i, (d, _) in enumerate(cases)], "id int, document string, want_origin string, want_destination string, want_departure date, want_return date, want_cabin string, price string")
    rows = offers.normalized(raw, "document").orderBy("id").collect()
    assert [(r.id, r.reject_reason) for r in rows] == [(i, why) for i, (_, why) in enumerate(cases)] and {r.price for r in rows} == {"kept"}
    good = rows[0]
    assert (good.currency, good.amount, good.minor_units, good.connections) == ("EUR", "120.50", 12050, 1)
    assert [(a.code, a.name) for a in good.airlines] == [("LH", "Lufthansa"), ("TP", "TAP"), ("", "Charter")]
    assert good.identity == "slice-1|FRA|LIS|FRA:MUC:LH:12:2024-05-01T08:00:00:2024-05-01T09:00:00|MUC:LIS:TP:12:2024-05-01T10:00:00:2024-05-01T13:00:00||slice-2|LIS|FRA|LIS:FRA:TP:12:2024-05-09T08:00:00:2024-05-09T12:00:00"
    assert all(r.identity is None and r.airlines is None for r in rows if r.reject_reason)
    one_way = raw.withColumn("want_return", F.lit(None).cast("date")).filter("id in (0, 13)")
    assert {r.id: (r.reject_reason, r.connections) for r in offers.normalized(one_way, "document").collect()} == {0: ("return", None), 13: (None, 1)}
    assert offers.normalized(raw.limit(0), "document").count() == 0


def test_sparse_vectors_equal_dense_ones(spark):
    rng = random.Random(4)
    caps = {"a": 3, "b": 10, "c": 2}
    rows = [(i, rng.choice(["x", "y", "z", "v", "w", None]), rng.choice([1, 2, 3, None]), None if i < 150 else "late") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, b int, c string")
    words = categories.vocabulary(df.filter("id < 120"), caps)
    got = {r.id: r.features for r in categories.as_ml_vectors(categories.encoded(df, words, list(caps))).collect()}
    size, frames = 0, []
    for at, (field, cap) in enumerate(caps.items(), 1):
        counts = {}
        for r in rows[:120]:
            if r[at] is not None:
                counts[str(r[at])] = counts.get(str(r[at]), 0) + 1
        chosen = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:cap]
        frames.append((at, size, dict(chosen), [v for v, _ in chosen]))
        size += len(chosen) + 3
    for r in rows:
        dense = [0.0] * size
        for at, base, counts, order in frames:
            value = None if r[at] is None else str(r[at])
            if value in counts:
                dense[base + order.index(value)] = 1.0
                dense[base + len(order) + 1], dense[base + len(order) + 2] = math.log1p(counts[value]), counts[value] / 120
            else:
                dense[base + len(order)] = 1.0
        assert got[r[0]].size == size and got[r[0]].toArray().tolist() == pytest.approx(dense)
    assert categories.encoded(df.limit(0), words, list(caps)).count() == 0


def test_outcome_rules(spark):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    base = ("landed", at(22), 180, dt.date(2024, 5, 2), at(22), at(23), at(23))
    names = ["status", "departure", "offset_minutes", "service_date", "actual_departure", "actual_arrival", "outcome_seen"]
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(names, base))
    cases = [
        (base, None), (change(actual_arrival=None), None), (change(actual_arrival=at(21)), "actual_order"), (change(status="cancelled"), "arrival_of_none"), (change(status="cancelled", actual_arrival=None), None), (change(status="scheduled", actual_arrival=None), "outcome_of_none"),
        (change(outcome_seen=at(22)), "landed_early"), (change(status="diverted", outcome_seen=at(20)), "diverted_early"), (change(status="diverted", outcome_seen=None), None), (change(service_date=dt.date(2024, 5, 1)), "service_date"), (change(service_date=None), "service_date"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "id int, status string, departure timestamp, offset_minutes int, service_date date, actual_departure timestamp, actual_arrival timestamp, outcome_seen timestamp")
    assert [r.reject_reason for r in validation.audited(df, validation.outcome_rules()).orderBy("id").collect()] == [why for _, why in cases]


def test_rows_are_accounted_for_by_the_pass_that_writes_them(spark, tmp_path):
    checked = validation.audited(spark.range(100), [("odd", F.col("id") % 2 == 0), ("high", F.col("id") < 90)])
    told = validation.write_accounted(checked, f"{tmp_path}/good", excluded=F.col("id") < 10)
    assert told == {"read": 100, "accepted": 40, "excluded": 5, "rejected": 55} and (tmp_path / "good" / "_ACCOUNTED").exists()
    again = spark.read.parquet(f"{tmp_path}/good")
    assert {r.disposition: r["count"] for r in again.groupBy("disposition").count().collect()} == {"accepted": 40, "excluded": 5, "rejected": 55}
    with pytest.raises(ValueError, match="too few"):
        validation.write_accounted(checked, f"{tmp_path}/bad", least_accepted=0.9)
    assert not (tmp_path / "bad" / "_ACCOUNTED").exists()


def test_an_early_prediction_fails_the_plan(spark):
    snapshot = spark.createDataFrame([("a", 3)], "k string, n long")
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 11)], "id int, k string, t long")
    assert {r.id: r.n for r in temporal.with_snapshot(rows, snapshot, ["k"], "t", 10, ["n"]).collect()} == {1: 3, 2: 0}
    for bad in (9, None):
        late = rows.unionByName(spark.createDataFrame([(3, "a", bad)], "id int, k string, t long"))
        with pytest.raises(Exception, match="older than its snapshot of 10"):
            temporal.with_snapshot(late, snapshot, ["k"], "t", 10, ["n"]).collect()


def test_exported_trees_score_alike(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random(), rng.choice([rng.random(), float("nan")]), float(rng.random() < 0.5), i % 4 == 0) for i in range(400)], "id int, a double, b double, y double, hold boolean").withColumn("y", (F.col("a") + F.nanvl("b", F.lit(0.3)) > 0.9).cast("double"))
    model = models.fit_trees(df.withColumn("b", F.nanvl("b", F.lit(0.3))), ["a", "b"], "y", "hold", rounds=5, depth=4)
    trees = models.exported(model, ["a", "b"])
    assert not models.model_faults({"features": ["a", "b"], "heads": [{"name": "h", "trees": trees, "start": 0.0, "slope": 1.0, "intercept": 0.0}]})
    scored = models.margins(model, df, ["a", "b"]).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).withColumn("ours", models.ensemble(trees))
    assert models.disparities(scored, "ours", "raw_score").isEmpty()
    assert not models.disparities(scored.withColumn("ours", F.col("ours") + F.when(F.col("id") == 7, 1e-6).otherwise(0.0)), "ours", "raw_score").isEmpty()


def test_five_heads_in_order_of_time(spark):
    """Heads learn what there is to learn, from early rows only; their scores are consistent, and the query's metrics are those of its scores."""
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        a, b = rng.random(), rng.random()
        split = ["train", "tune", "calibration", "test"][min(3, i // 300)]
        delay = 70 * a + 10 * rng.random()
        late = [int(delay >= t) if rng.random() > 0.1 else None for t in (15, 30, 60)]
        rows.append((i, a, b, split, *late, 0, int(b > 0.8) if split != "test" else 1 - int(b > 0.8)))  # the last head's test labels are turned round
    df = spark.createDataFrame(rows, "id int, a double, b double, split string, late_15 int, late_30 int, late_60 int, cancelled int, disrupted int")
    heads = ["late_15", "late_30", "late_60", "cancelled", "disrupted"]
    model = models.fit_heads(df, ["a", "b"], heads, "split")
    assert not models.model_faults(model) and ["leaf" not in h["trees"][0] for h in model["heads"]] == [True, True, True, False, True]
    again = models.fit_heads(df.filter("split <> 'test'"), ["a", "b"], heads, "split")
    assert model == again  # nothing of the test part is read
    test = df.filter("split = 'test'").withColumnsRenamed({h: f"y_{h}" for h in heads})
    scored = models.consistent(models.score_heads(test, model), [heads[:3], ["disrupted", "cancelled"]]).collect()
    assert all(r.late_15 >= r.late_30 - 1e-12 and r.late_30 >= r.late_60 - 1e-12 and r.disrupted >= r.cancelled - 1e-12 for r in scored)
    for h in heads[:3]:
        own = [(r[h], r[f"y_{h}"]) for r in scored if r[f"y_{h}"] is not None]
        assert sum((p >= 0.5) == (y == 1) for p, y in own) / len(own) > 0.85
    assert sum((r.disrupted >= 0.5) == (r.y_disrupted == 1) for r in scored) < 0.2 * len(scored)
    none = models.fit_heads(df.limit(0), ["a", "b"], heads, "split")
    assert all(h["trees"] == [{"leaf": 0.0}] for h in none["heads"])


def test_lines_of_orders_are_moved_narrow_and_sorted_once(spark):
    """No segment is built before the shuffle, and the order of a group's lines comes from the one sort behind it."""
    from portolan.plans import outlooks

    docs = outlooks._documents(spark, "/root/testdata/sf0.001")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    moved = plan[plan.index("Exchange hashpartitioning(l_orderkey") :]
    assert "date_format" not in moved and "struct(" not in moved and plan.count("Sort [l_orderkey") == 1
    lines = {}
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").collect(), key=lambda r: (r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice, r.l_quantity)):
        lines.setdefault(r.l_orderkey, []).append(str(r.l_partkey))
    rows = docs.select("o_orderkey", "document").collect()
    assert len(rows) == len({r.o_orderkey for r in rows}) > 0
    for r in rows:
        offer = json.loads(r.document)
        assert [s["number"] for leg in ("outbound", "inbound") for s in (offer.get(leg) or {"segments": []})["segments"]] == lines[r.o_orderkey]
