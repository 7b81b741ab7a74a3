"""Quotas of requests in windows that open with a request, for keys of any size.

A window opens with the first request after the last one's end, so where the windows of a key begin depends on all
that came before. It is found without going through a key's requests one by one: each request points to the first one
at or after its window's end, and that pointer never stays within a span of one window's length. Pointers over
blocks of 2, 4, 8, ... spans are composed, but only from requests by which a chain can enter a block: those of its
first span, and the first ones of later spans. So the tables shrink from level to level; from the top down each level
then tells one more opening of each block. Every join is on (key, instant), so that no key is one task's work. Keys of few
requests need none of this: their requests are gone through in order, all keys in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.operators.folds import fold, key_text
from portolan.operators.running import settled
from portolan.operators.temporal import fitting_span


def next_at_or_after(nodes: DataFrame, ahead: int, slot: int) -> DataFrame:
    """nodes (id_, t_) with out_: the first instant of the same key at or after t_ + ahead. Windows hold one slot of a key, or one row for each slot."""
    slot_of = lambda t: F.floor(t / slot).cast("long")
    targets = nodes.select("id_", slot_of(F.col("t_")).alias("slot_"), F.col("t_").alias("at_"), F.lit(0).alias("side_"), F.col("t_").alias("target_"), F.lit(None).cast("long").alias("t_"))
    asked = nodes.select("id_", slot_of(F.col("t_") + ahead).alias("slot_"), (F.col("t_") + ahead).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast("long").alias("target_"), "t_")
    back = Window.partitionBy("id_", "slot_").orderBy(F.col("at_").desc(), "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = targets.unionByName(asked).withColumn("own_", F.last("target_", ignorenulls=True).over(back)).filter("side_ = 1").select("id_", "slot_", "t_", "own_")
    slots = targets.unionByName(asked).groupBy("id_", "slot_").agg(F.min("target_").alias("first_"))
    later = Window.partitionBy("id_").orderBy(F.col("slot_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("id_", "slot_", F.last("first_", ignorenulls=True).over(later).alias("later_"))
    return found.join(slots, ["id_", "slot_"]).select("id_", "t_", F.coalesce("own_", "later_").alias("out_"))


def openings(rows: DataFrame, window: int, most: int = 100_000) -> DataFrame:
    """(id_, t_): the instants at which windows open, of rows (id_, t_) with a non-null key and a long instant."""
    nodes = rows.select("id_", "t_").filter("t_ is not null").distinct()
    first, last = nodes.agg(F.min("t_"), F.max("t_")).first()
    if first is None:
        return nodes
    base = first // window
    span = lambda t: (F.floor(F.col(t) / window).cast("long") - base)
    begins = nodes.groupBy("id_", span("t_").alias("s_")).agg(F.min("t_").alias("t_")).select("id_", "t_", F.lit(True).alias("first_"))
    start = next_at_or_after(nodes, window, fitting_span(nodes, ["id_"], "t_", window, most)).join(begins, ["id_", "t_"], "left")
    levels = [settled(start.withColumn("first_", F.coalesce("first_", F.lit(False))), "quota-level")]
    for k in range((last // window - base).bit_length()):
        here = levels[-1]
        entries = here.filter(F.col("first_") | (F.pmod(span("t_"), F.lit(2 << k)) == 0))
        onward = here.select(F.col("id_").alias("on_"), F.col("t_").alias("from_"), F.col("out_").alias("then_"))
        joined = entries.join(onward, (F.col("id_") == F.col("on_")) & (F.col("out_") == F.col("from_")), "left")
        inside = F.shiftright(span("t_"), k + 1) == F.shiftright(span("out_"), k + 1)
        levels.append(settled(joined.select("id_", "t_", F.when(inside, F.col("then_")).otherwise(F.col("out_")).alias("out_"), "first_"), "quota-level"))
    opened = nodes.groupBy("id_").agg(F.min("t_").alias("t_"))
    for k in range(len(levels) - 2, -1, -1):
        inside = F.shiftright(span("t_"), k + 1) == F.shiftright(span("out_"), k + 1)
        both = opened.join(levels[k], ["id_", "t_"]).select("id_", F.explode(F.array("t_", F.when(inside, F.col("out_")))).alias("t_"))
        opened = both.filter("t_ is not null")
    return opened


def fixed_window(rows: DataFrame, key: str, at: str, order: list[str], window: int, limit: int, most: int = 100_000) -> DataFrame:
    """rows with allowed, opened and retry_after (seconds, 0 where allowed): at most `limit` requests in each window of a key.

    `at` is a long in microseconds and order begins with it. Refused requests are not counted and open no window. A null key is a key; a request
    without an instant gets nulls. Rows that agree in all of `order` are one request. Keys of more than `most` requests are spread over many
    tasks; both ways give the same rows. An empty table gives an empty result.
    """
    named = rows.withColumns({"id_": key_text(key), "t_": F.col(at).cast("long")})
    hot = settled(named.groupBy("id_").agg(F.count("*").alias("n_")).filter(F.col("n_") > most).select("id_"), "quota-hot")
    many = hot.count()  # at most the rows over `most`
    near = F.broadcast(hot) if many <= 1_000_000 else hot
    cold = named.join(near, "id_", "left_anti") if many else named
    done = _in_order(cold, order, window, limit).select(*rows.columns, "allowed", "opened", "retry_after")
    return done.unionByName(_spread(named.join(near, "id_", "left_semi"), order, window, limit, most).select(done.columns)) if many else done


def _in_order(named: DataFrame, order: list[str], window: int, limit: int) -> DataFrame:
    def step(state, row):
        opened, used, last, fate = state
        if row.t_ is None:
            return state, (None, None, None)
        now = tuple(getattr(row, c) for c in order)
        if now != last:
            if opened is None or row.t_ >= opened + window:
                opened, used = row.t_, 0
            fate = used < limit
            used += fate
        return (opened, used, now, fate), (fate, opened, 0 if fate else max(1, -(-(opened + window - row.t_) // 1_000_000)))

    return fold(named, "id_", order, lambda: (None, 0, None, None), step, "allowed boolean, opened long, retry_after long")


def _spread(named: DataFrame, order: list[str], window: int, limit: int, most: int) -> DataFrame:
    columns = named.columns
    named = named.withColumn("span_", F.floor(F.col("t_") / window).cast("long"))
    opened = openings(named, window, most).withColumn("span_", F.floor(F.col("t_") / window).cast("long"))
    # a request's window opened in its own span of time or in the one before
    near = opened.select("id_", "t_", F.posexplode(F.array(F.col("span_"), F.col("span_") + 1)).alias("late_", "span_"))
    near = near.groupBy("id_", "span_").agg(F.max(F.when(F.col("late_") == 0, F.col("t_"))).alias("own_"), F.max(F.when(F.col("late_") == 1, F.col("t_"))).alias("before_"))
    told = named.join(near, ["id_", "span_"], "left").withColumn("opened", F.when(F.col("own_") <= F.col("t_"), F.col("own_")).otherwise(F.col("before_"))).drop("own_", "before_", "span_")
    place = F.row_number().over(Window.partitionBy("id_", "opened").orderBy(*order))  # ranks beyond the limit are cut before the shuffle
    counted = told.filter("opened is not null").select("id_", "opened", *order).distinct().withColumn("place_", place).filter(F.col("place_") <= limit)
    lasts = counted.groupBy("id_", "opened").agg(F.max(F.struct(*order)).alias("last_"))
    allowed = F.when(F.col("opened").isNotNull(), F.coalesce(F.struct(*order) <= F.col("last_"), F.lit(False)))
    wait = F.greatest(F.floor((F.col("opened") + window - F.col("t_") + 999_999) / 1_000_000), F.lit(1)).cast("long")
    done = told.join(lasts, ["id_", "opened"], "left").withColumn("allowed", allowed)
    return done.select(*columns, "allowed", "opened", F.when(F.col("allowed"), F.lit(0).cast("long")).when(~F.col("allowed"), wait).alias("retry_after"))
