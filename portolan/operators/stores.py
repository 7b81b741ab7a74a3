"""Quotas kept in a store of bounded size, from which the oldest entries go first.

What a full store drops depends on the requests of all keys together, so keys cannot be told apart as in `quotas`. But
entries open, expire and are dropped in one order, so all that later requests need to know is the last openings: as many
as the store holds. Requests are cut into spans along time, each span is replayed by a task of its own from a guess of the
entries at its start, and a span whose guess differs from what the span before it leaves is replayed again. When none
differs, every span began with the right entries. The first guess is the store without a bound, which is right wherever
nothing is dropped; a span that drops entries is mostly forgotten after as many openings as the store holds.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.operators.folds import key_text
from portolan.operators.quotas import fixed_window
from portolan.operators.running import settled

ENTRIES = "array<struct<k: string, t: bigint, u: int>>"
_ENTRIES = pa.list_(pa.struct([("k", pa.string()), ("t", pa.int64()), ("u", pa.int32())]))


class Store:
    """Open windows by key in the order of their openings, which is that of their ends too."""

    def __init__(self, entries: list[dict] | None, window: int, limit: int, capacity: int):
        self.window, self.limit, self.capacity = window, limit, capacity
        self.open = OrderedDict((e["k"], (e["t"], e["u"])) for e in entries or [])

    def expire(self, now: int) -> None:
        while self.open and next(iter(self.open.values()))[0] + self.window <= now:
            self.open.popitem(last=False)

    def request(self, key: str, now: int) -> tuple[bool, int, int]:
        """allowed, when its window opened, seconds to wait."""
        self.expire(now)
        opened, used = self.open.get(key, (None, 0))
        if opened is None:
            if len(self.open) >= self.capacity:
                self.open.popitem(last=False)
            opened = now
        allowed = used < self.limit
        self.open[key] = (opened, used + allowed)
        return allowed, opened, 0 if allowed else max(1, -(-(opened + self.window - now) // 1_000_000))

    def entries(self) -> list[dict]:
        return [{"k": k, "t": t, "u": u} for k, (t, u) in self.open.items()]


def _guess(spans: DataFrame, order: list[str], window: int, limit: int, capacity: int, starts: DataFrame, reach: int) -> DataFrame:
    """span_, entries: the newest open windows at each span's start if nothing were dropped, from the `reach` spans before it."""
    asked = spans.select(F.col("id_").alias("who_"), F.col("span_").alias("was_"), *{"t_": None, **dict.fromkeys(order)})  # names that fixed_window does not use
    per = fixed_window(asked, "who_", "t_", order, window, limit).groupBy("who_", "opened", "was_").agg(F.count_if("allowed").alias("n_"))
    later = per.select(F.col("who_").alias("id_"), "opened", "n_", F.explode(F.sequence(F.col("was_") + 1, F.col("was_") + reach)).alias("span_"))
    alive = later.join(F.broadcast(starts), "span_").filter(F.col("opened") + window > F.col("start_"))
    held = alive.groupBy("span_", "id_", "opened").agg(F.sum("n_").cast("int").alias("u_"))
    newest = Window.partitionBy("span_").orderBy(F.col("opened").desc(), "id_")
    held = held.withColumn("place_", F.row_number().over(newest)).filter(F.col("place_") <= capacity)
    entry = F.struct("opened", "id_", "u_")
    listed = held.groupBy("span_").agg(F.sort_array(F.collect_list(entry)).alias("e_"))  # capacity entries at most
    return listed.select("span_", F.transform("e_", lambda e: F.struct(e["id_"].alias("k"), e["opened"].alias("t"), e["u_"].alias("u"))).alias("entries"))


def bounded_store(rows: DataFrame, key: str, at: str, order: list[str], window: int, limit: int, capacity: int, span_rows: int = 200_000, reach: int = 16) -> DataFrame:
    """rows with allowed, opened and retry_after (seconds, 0 where allowed): at most `limit` requests in each window of a key.

    A window opens with a key's first request that finds no entry of it. The store has room for `capacity` entries: expired ones
    go first, then the one that was opened first (an entry that is opened anew is the newest). `at` is a long in
    microseconds, order begins with it and is total. A null key is a key; a request without an instant gets nulls. An empty table gives an
    empty result. A task holds a span of about `span_rows` requests and the store. Only numbers of spans reach the driver. Known limit:
    where entries stay that depend on all before them, spans are settled one after another, each round in a task for each span left.
    """
    if capacity < 1 or limit < 1 or window < 1:
        raise ValueError("capacity, limit and window must be positive")
    named = rows.withColumns({"id_": key_text(key), "t_": F.col(at).cast("long")})
    timed = named.filter("t_ is not null")
    count = max(1, -(-timed.count() // span_rows))
    parts = settled(timed.repartitionByRange(count, *order).withColumn("part_", F.spark_partition_id()), "store-ranges")
    starts = parts.groupBy("part_").agg(F.min("t_").alias("start_")).withColumn("span_", F.row_number().over(Window.orderBy("part_")))  # one row for each span
    starts = settled(starts, "store-starts")
    ends = starts.select("span_", "start_", F.lead("start_").over(Window.orderBy("span_")).alias("end_"))
    spans = parts.join(F.broadcast(starts.select("part_", "span_")), "part_").drop("part_")
    columns = [c for c in spans.columns if c != "span_"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.select(*columns).schema)

    def replayed(group: pa.Table, state: pa.Table) -> tuple[Store, pa.Table, list]:
        store = Store(state.column("entries")[0].as_py(), window, limit, capacity)
        group = group.sort_by([(c, "ascending") for c in [*order, "id_"]])
        return store, group, [store.request(k, t) for k, t in zip(group.column("id_").to_pylist(), group.column("t_").to_pylist())]

    def leaves(group: pa.Table, state: pa.Table) -> pa.Table:
        store, _, _ = replayed(group, state)
        if (end := state.column("end_")[0].as_py()) is not None:
            store.expire(end)
        return pa.table({"span_": pa.array([state.column("span_")[0].as_py() + 1], pa.int32()), "left_": pa.array([store.entries()], _ENTRIES)})

    def tells(group: pa.Table, state: pa.Table) -> pa.Table:
        _, group, told = replayed(group, state)
        allowed, opened, wait = zip(*told)
        added = {"allowed": pa.array(allowed, pa.bool_()), "opened": pa.array(opened, pa.int64()), "retry_after": pa.array(wait, pa.int64())}
        return pa.table({**{c: group.column(c) for c in columns}, **added})

    def over(states: DataFrame, f, schema: str, slim: bool) -> DataFrame:
        asked = spans.select("span_", "id_", "t_", *[c for c in order if c not in ("id_", "t_")]) if slim else spans
        chosen = asked.join(F.broadcast(states.select("span_")), "span_", "left_semi")  # one number for each span
        return chosen.groupBy("span_").cogroup(states.groupBy("span_")).applyInArrow(f, schema)

    empty = F.array().cast(ENTRIES)
    guess = _guess(spans, order, window, limit, capacity, starts.select("span_", "start_"), reach)
    states = ends.join(guess, "span_", "left").select("span_", "end_", F.coalesce("entries", empty).alias("entries"), F.lit(True).alias("new_"))
    states = settled(states, "store-states")
    for _ in range(count + 1):  # the first span is right, and each round settles another at least
        left = over(states.filter("new_"), leaves, f"span_ int, left_ {ENTRIES}", True)
        changed = F.col("left_").isNotNull() & ~F.col("left_").eqNullSafe(F.col("entries"))
        states = settled(states.drop("new_").join(left, "span_", "left").select("span_", "end_", F.when(changed, F.col("left_")).otherwise(F.col("entries")).alias("entries"), changed.alias("new_")), "store-states")
        if not states.filter("new_").limit(1).count():
            break
    else:
        raise RuntimeError("spans of the store did not settle")
    done = over(states, tells, f"{kept}, allowed boolean, opened long, retry_after long", False).select(*rows.columns, "allowed", "opened", "retry_after")
    none = named.filter("t_ is null").select(*rows.columns, F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("opened"), F.lit(None).cast("long").alias("retry_after"))
    return done.unionByName(none)
