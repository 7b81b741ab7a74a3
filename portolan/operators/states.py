"""Stores replayed from their requests: last write wins, first write stays, guarded transitions, quotas, expiry.

What needs no order beyond "first" or "last" is an aggregation. What depends on the rows before it is a fold over
rows sorted by key and time within partitions: rows stream through, and a task holds the state of one key, however
many rows the key has. Where the states are few, a key is cut into spans whose moves are composed first, so that no
key is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators.folds import fold, key_text
from portolan.operators.temporal import fitting_span


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def insert_or_ignore(rows: DataFrame, key: list[str], order: list[str], content: Column) -> DataFrame:
    """The first row of each key, how many later ones were ignored, and whether one of them had other content."""
    groups = rows.withColumn("hash_", content).groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"), (F.count("*") - 1).alias("ignored"), (F.min("hash_") < F.max("hash_")).alias("conflict"))
    return groups.select("r.*", "ignored", "conflict")


def quota_step(window: int, limit: int) -> tuple[Callable, Callable]:
    """A window opens with the first request after the last one's end; requests beyond the limit are refused and not counted."""

    def step(state, row):
        opened, used = state
        if opened is None or row.t >= opened + window:
            opened, used = row.t, 0
        allowed = used < limit
        used += allowed
        return (opened, used), (allowed, opened, 0 if allowed else max(1, -(-(opened + window - row.t) // 1_000_000)))

    return lambda: (None, 0), step


def transition_step(first: str, rules: dict[str, tuple[tuple[str, ...], str]]) -> tuple[Callable, Callable]:
    """A request of a kind applies only in its expected states."""

    def step(state, row):
        expected, after = rules.get(row.kind, ((), state))
        applied = state in expected
        return (after if applied else state), (applied, after if applied else state)

    return lambda: first, step


def transitions(rows: DataFrame, key: str, at: str, order: list[str], first: str, rules: dict[str, tuple[tuple[str, ...], str]], span: int, most: int = 100_000) -> DataFrame:
    """rows (with a column kind) and whether each request applied, and the state after it; each key begins in the state `first`.

    Spans of `at` are at most `span` long and hold about `most` requests of a key. A span is a map from the state before
    it to the state after it; the maps of a key, one row a span, are followed in order, and then each span is gone
    through from its own first state. order begins with `at`. Kinds without a rule change nothing; a null key is a key.
    """
    names = sorted({first, *[s for expected, after in rules.values() for s in (*expected, after)]})
    same = F.array(*[F.lit(i) for i in range(len(names))])
    moves = same
    for kind, (expected, after) in rules.items():
        moves = F.when(F.col("kind") == kind, F.array(*[F.lit(names.index(after if s in expected else s)) for s in names])).otherwise(moves)
    rows = rows.withColumn("id_", key_text(key))
    rows = rows.withColumn("span_", F.coalesce(F.floor(F.col(at) / fitting_span(rows, ["id_"], at, span, most)).cast("long"), F.lit(-(1 << 63))))
    told = F.sort_array(F.collect_list(F.struct(*order, moves.alias("moves_"))))
    composed = F.aggregate(told, same, lambda now, r: F.transform(now, lambda s: F.get(r["moves_"], s)))

    def follow(state, row):
        return int(row.map_[state]), (names[state],)

    maps = rows.groupBy("id_", "span_").agg(composed.alias("map_"))
    entered = fold(maps, "id_", ["span_"], lambda: names.index(first), follow, "before_ string").drop("map_")
    _, step = transition_step(first, rules)
    parts = rows.join(entered, ["id_", "span_"]).withColumn("part_", F.concat_ws("@", F.col("span_").cast("string"), "id_"))
    done = fold(parts, "part_", order, lambda: None, lambda state, row: step(row.before_ if state is None else state, row), "applied boolean, state string")
    return done.drop("id_", "span_", "part_", "before_")


def live(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    return rows.filter(F.col(expires) > now)


def expire(rows: DataFrame, key: str, expires: str, now: Column, most: int, kept: DataFrame | None = None) -> DataFrame:
    """rows without the `most` oldest expired ones; keys in `kept` never go."""
    old = rows.filter(F.col(expires) <= now)
    if kept is not None:
        old = old.join(kept.select(key), key, "left_anti")
    gone = old.orderBy(expires, key).limit(max(1, min(500, most))).select(key)
    return rows.join(F.broadcast(gone), key, "left_anti")  # 500 keys at most


def rebuild_table(rows: DataFrame, name: str) -> None:
    """A table written anew from rows, which may read the old one, and then put in its place.

    The old table is moved aside before the new one takes its name, and goes last: whatever fails, one of them stands, under its
    name or as <name>_old, and the next call begins by putting it back.
    """
    spark, catalog = rows.sparkSession, rows.sparkSession.catalog
    if catalog.tableExists(f"{name}_old") and not catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name}_old RENAME TO {name}")
    rows.write.mode("overwrite").saveAsTable(f"{name}_next")
    spark.sql(f"DROP TABLE IF EXISTS {name}_old")
    if catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_old")
