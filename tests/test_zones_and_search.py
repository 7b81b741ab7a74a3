"""Zones and searches against brute force, exact quantiles against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from portolan.operators import running, search, zones


def inside(x, y, rings):
    """Odd number of rings, edges included."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if abs(turn) < 1e-12 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def frame(spark, shapes):
    return spark.createDataFrame([(n, [[list(map(float, c)) for c in ring] for ring in rings]) for n, rings in shapes], "zone string, rings array<array<array<double>>>")


@pytest.mark.parametrize("size,band", [(1.0, 0.25), (7.0, 3.0), (0.6, 0.1)])
def test_any_shapes_equal_brute_force(spark, size, band):
    rng = random.Random(int(size * 10))

    def star(x, y, r, n):
        return [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]

    shapes = [(f"z{i}", [star(x, y, 9, 17), star(x, y, 3, 7), star(x + 14, y, 2, 5)]) for i, (x, y) in enumerate((rng.uniform(-40, 40), rng.uniform(-30, 30)) for _ in range(12))]
    shapes += [("grid", [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]), ("beside", [[(6, 0), (12, 0), (12, 6), (6, 6)]])]
    points = [(rng.uniform(-50, 50), rng.uniform(-40, 40)) for _ in range(1500)] + [(float(x), float(y)) for x in range(-1, 14) for y in range(-1, 8)] + [tuple(map(float, c)) for _, rings in shapes[:3] for ring in rings for c in ring]
    got = zones.holding(spark.createDataFrame(points, "x double, y double"), frame(spark, shapes), size, band).collect()
    want = {}
    for x, y in set(points):
        held = sorted(n for n, rings in shapes if inside(x, y, rings))
        if held:
            want[x, y] = (len(held), held[0])
    assert {(r.x, r.y): (r.n_zones, r.zone) for r in got} == want


def test_points_on_borders(spark):
    boxes = frame(spark, [("a", [[(0, 0), (10, 0), (10, 10), (0, 10)]]), ("b", [[(10, 0), (20, 0), (20, 10), (10, 10)]])])
    rows = [(1, 5.0, 5.0), (2, 5.0, 10.0), (3, 5.0, 9.999), (4, 50.0, 5.0), (5, 5.0, 15.0), (6, None, 5.0), (7, float("nan"), 5.0), (8, 5.0, 200.0)] + [(9, 5.0, 5.0)] * 300
    points = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = zones.located(points, boxes, "lat", "lon")
    assert got.columns == ["id", "lat", "lon", "zone", "disposition"] and got.count() == len(rows)
    assert {r.id: (r.zone, r.disposition) for r in got.collect()} == {1: ("a", "resolved"), 2: (None, "overlap"), 3: (None, "near_border"), 4: (None, "outside"), 5: ("b", "resolved"), 6: (None, "invalid"), 7: (None, "invalid"), 8: (None, "invalid"), 9: ("a", "resolved")}
    assert {r.disposition for r in zones.located(points.filter("id < 6"), boxes.limit(0), "lat", "lon").collect()} == {"outside"}
    assert zones.located(points.limit(0), boxes, "lat", "lon").count() == 0


def test_few_points_are_tested_exactly(spark):
    """Of a fine grid only the cells of the border remain for exact tests, and no cell has both kinds."""
    sides = zones.edges(frame(spark, [("a", [[(0, 0), (40, 3), (38, 41), (1, 40)]])]))
    kinds = {r.inner: r.n for r in zones.cover(sides, 0.5).groupBy("inner").agg(F.count("*").alias("n")).collect()}
    assert kinds[True] > 10 * kinds[False]
    cells = zones.cover(sides, 0.5)
    assert cells.count() == cells.select("zone", "cx", "cy").distinct().count()


def plain_score(q, code, place, name, land):
    compact, whole = q.replace(" ", ""), f"{code} {place} {name} {land}"
    rules = [(code == compact, 0), (place == q, 10), (name == q, 12), (code.startswith(compact), 18), (place.startswith(q), 20), (name.startswith(q), 24)]
    for holds, s in rules:
        if holds:
            return s
    if all(t in whole for t in q.split()):
        found = [i for i in (place.find(q), name.find(q)) if i >= 0]
        return 40 + min(found, default=20)
    return None


def test_searches_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["paris", "orly", "new", "york", "san", "jose", "st", "o", "al ain", "villa"]
    entries = [(i, rng.choice(["Ärport", "x", "Zed"]), "".join(rng.choices("abc", k=3)), rng.choice([*words, ""]), " ".join(rng.choices(words, k=2)), rng.choice(["fr", "us", ""])) for i in range(150)]
    queries = ["abc", "a b", "ab", "paris", "new york", "york new", "o", "ri", "fr", "st o", "aris orl", "none", "san", "vil us", "", " ", None, "p", "al ain", "new york new york new york", "ca", "orly fr"]
    data = spark.createDataFrame(entries, "entry int, title string, code string, place string, name string, land string")
    got = search.search(data, spark.createDataFrame([(q,) for q in queries + queries], "query string"), most=8, longest=20).collect()
    want = set()
    for q in {q[:20].rstrip(" ") for q in queries if q}:
        if len(q) >= 2:
            found = sorted((s, t, c, e) for e, t, c, p, n, l in entries if (s := plain_score(q, c, p, n, l)) is not None)
            want |= {(q, i + 1, e, s) for i, (s, _, _, e) in enumerate(found[:8])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert search.search(data.limit(0), spark.createDataFrame([("abc",)], "query string")).count() == 0


@pytest.mark.parametrize("most", [3, 100_000])
def test_quantiles(spark, most, monkeypatch):
    if most == 3:
        plain = running.exclusive_sums
        monkeypatch.setattr(running, "exclusive_sums", lambda *a: plain(*a[:5], 3, *a[6:]))
    rng = random.Random(most)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), None])) for _ in range(500)] + [("one", 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in running.exact_quantile(df, ["g"], "v", share, "q").collect()}
        want = {}
        for g in {g for g, v in rows if v is not None}:
            own = sorted(v for h, v in rows if h == g and v is not None)
            at = (len(own) - 1) * share
            low, high = own[math.floor(at)], own[math.ceil(at)]
            want[g] = low + (high - low) * (at - math.floor(at))
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], abs_tol=1e-12) for g in want)


def test_parts_of_words_are_not_broadcast(spark, tmp_path):
    folder = str(tmp_path / "entries")  # a small file, which Spark would broadcast with all that is exploded from it
    spark.range(300).selectExpr("id AS entry", "'t' AS title", "concat('p', id) AS code", "'brand 7' AS place", "'hot bolt' AS name", "'' AS land").coalesce(1).write.parquet(folder)
    entries = spark.read.parquet(folder)
    found = search.search(entries, entries.select(F.concat(F.lit("p "), F.col("entry")).alias("query")))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    broadcasts = [i for i, x in enumerate(lines) if "BroadcastExchange" in x]
    assert len(broadcasts) == sum("BroadcastHashJoin" in x for x in lines)
    for i in broadcasts:  # only the words of more than `busy` entries
        below = next(x for x, d in zip(lines[i + 1 :], depth[i + 1 :]) if "Filter" in x)
        assert "> 5000" in below
    assert found.filter("query = 'p 299'").select("rank", "entry", "score").collect()[0] == (1, 299, 0)
