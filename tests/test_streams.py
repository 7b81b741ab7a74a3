"""Stores as streams over several batches and a restart, against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from portolan.operators import states
from portolan.streaming import stores

RULES = {"open": (("new", "shut"), "open"), "shut": (("open",), "shut"), "end": (("open", "shut"), "ended")}
SCHEMA = "event_id long, key string, t long, kind string, content string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stores.ROCKS)
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, query, label):
    done = query.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / f"out-{label}")).option("checkpointLocation", str(tmp_path / f"check-{label}")).trigger(availableNow=True).start()
    assert done.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"out-{label}")).collect()


def test_replays_and_transitions_over_batches_and_a_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", "c"]), 1_000_000 * i, rng.choice(list(RULES) + ["other"]), rng.choice("xxxy")) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def source():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    run(spark, tmp_path, stores.replayed_requests(source()), "replay")
    run(spark, tmp_path, stores.guarded_requests(source(), "new", RULES), "guard")
    spark.createDataFrame(rows[90:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    replays = run(spark, tmp_path, stores.replayed_requests(source()), "replay")
    guards = run(spark, tmp_path, stores.guarded_requests(source(), "new", RULES), "guard")

    table = spark.createDataFrame(rows, SCHEMA)
    batch = states.transitions(table, "key", "t", ["t", "event_id"], "new", RULES, 50_000_000)
    assert {(r.event_id, r.applied, r.state) for r in guards} == {(r.event_id, r.applied, r.state) for r in batch.collect()} and len(guards) == 120
    firsts = {r.key: r for r in states.insert_or_ignore(table, ["key"], ["t", "event_id"], F.col("content")).collect()}
    assert len(replays) == 120
    for r in replays:
        own = rows[r.event_id]
        first = firsts[own[1]]
        assert r.first_id == first.event_id and r.fate == ("first" if r.event_id == first.event_id else "replay" if own[4] == first.content else "conflict")
    conflicting = {rows[r.event_id][1] for r in replays if r.fate == "conflict"}
    assert conflicting == {k for k, r in firsts.items() if r.conflict}


def test_a_key_is_forgotten_after_its_time(rocks, tmp_path):
    spark = rocks
    minute = 60_000_000
    for n, (event, at) in enumerate([(1, 0), (2, 5), (3, 30), (4, 31)]):
        keys = [(event, "a", (1000 + at) * minute, "open", "x"), (100 + event, f"other{event}", (1000 + at) * minute, "open", "x")]
        spark.createDataFrame(keys, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = run(spark, tmp_path, stores.replayed_requests(stream, keep=10 * 60_000, delay="1 minute"), "replay")
    assert {r.event_id: (r.fate, r.first_id) for r in rows if r.event_id < 100} == {1: ("first", 1), 2: ("replay", 1), 3: ("first", 3), 4: ("replay", 3)}
