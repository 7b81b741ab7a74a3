"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets are shares of all words. Document rates minimise the relative entropy to rate one under one token
constraint for each source, so they have the form exp(lambda * size / mean size), capped at `most`. The convex
dual separates by source; each Newton step is one distributed aggregate over the (source, size) histogram,
kept inside a shrinking bracket. Rates become whole copies by systematic rounding along the sizes of a
source. The larger sizes' copies then stay, and the rates of the smaller ones take up the words that rounding has
left, again rounded along the sizes; at last copies of one or two sizes are exchanged, as long as that comes nearer
to the target. All this is on the histogram. A document's copies follow from its source, its size and the hash of
its id and text: those with the smallest hashes take one copy more. So no window holds more than a block of
hashes or the distinct sizes of a source, and a corpus is mixed without moving its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import WORD, few, materialize, shuffled


#: Rounds of nearing a target; each at least brings a source half a word nearer, and in practice an eighth of its gap or less is left.
ROUNDS = 100


def sized(cells: DataFrame, most_small: int = 250_000) -> DataFrame:
    """A table of sources and sizes, as far as Spark may broadcast it: its file holds a few bytes a row, memory some hundred."""
    return cells if cells.count() <= most_small else shuffled(cells)


def targets(sources: DataFrame, most: float) -> DataFrame:
    """source_size -> target: shares by weight 1, 2, 3, ..., at most `most` times the source's size each.

    `sources` has one row for each source. What exceeds a limit is shared again by weight among the others, until
    none is above: sources close by ascending limit for a weight, each if its share of what is left then reaches it.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_last())
    out = (
        sources.withColumn("weight", F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)).cast("double") + 1)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("limit_", F.col("source_size") * F.lit(float(most)))
        .withColumn("left_", F.col("total") - F.coalesce(F.sum("limit_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("left_") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    )
    # the first source that stays open sets the level of all that do
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("limit_"), F.struct(F.col("limit_") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"])
    return out.select("source", "source_size", F.least(F.col("level") * F.col("weight"), "limit_").alias("target"))


def _rate(lam: Column, z: Column, most: float) -> Column:
    return F.least(F.exp(F.least(lam * z, F.lit(50.0))), F.lit(float(most)))


def dual(cells: DataFrame, goals: DataFrame, most: float, steps: int, exact: float = 1e-9) -> DataFrame:
    """lambda for each source, by safeguarded Newton iterations over cells (source, size, n); every `steps` of them the gaps are tested.

    The multiplier per mean size solves sum n * min(most, exp(lambda z)) * size = target with z = size / mean size.
    """
    cells = sized(cells.select(F.col("source").alias("cell_source"), "size", "n"))
    state = goals.select("source", "target", "source_size", "mean_size", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    for step in range(60):
        # one row for each source: a checked bound would not help, the join is as small as the list of sources
        seen = (
            cells.join(state, F.col("cell_source").eqNullSafe(F.col("source")))
            .select("source", "lam", "low", "high", "target", "source_size", "mean_size", "n", "size", (F.col("size") / F.col("mean_size")).alias("z"))
            .withColumn("w", _rate(F.col("lam"), F.col("z"), most))
            .groupBy("source", "lam", "low", "high", "target", "source_size", "mean_size")
            .agg(F.sum(F.col("n") * F.col("size") * F.col("w")).alias("value"), F.sum(F.when(F.col("w") < most, F.col("n") * F.col("size") * F.col("w") * F.col("z")).otherwise(0.0)).alias("slope"))
        )
        low = F.when(F.col("value") <= F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("value") >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + F.when(F.col("slope") > 0, (F.col("target") - F.col("value")) / F.col("slope"))
        nearer = seen.withColumn("next_low", low).withColumn("next_high", high).withColumn("newton", newton)
        inside = (F.col("newton") > F.col("next_low")) & (F.col("newton") < F.col("next_high"))
        state = nearer.select("source", "target", "source_size", "mean_size", F.when(inside, F.col("newton")).otherwise((F.col("next_low") + F.col("next_high")) / 2).alias("lam"), F.col("next_low").alias("low"), F.col("next_high").alias("high"), (F.abs(F.col("value") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))).alias("off"))
        if step % steps == steps - 1:
            state = materialize(state, "mix-dual")
            # a source at its limit, or one that its bracket has closed on, comes no nearer
            if state.filter((F.col("off") > exact) & (F.col("high") - F.col("low") > 1e-12) & (F.col("target") < F.col("source_size") * most)).isEmpty():
                break
    else:
        raise RuntimeError("the rates did not settle")
    return state.select("source", "lam", "mean_size", "target", "source_size")


def _rounded(rated: DataFrame, most: int) -> DataFrame:
    """quota: whole copies of each (source, size), the running sum of n * w along descending sizes cut at integers; gap: words left."""
    whole = Window.partitionBy("source")
    along = whole.orderBy(F.col("size").desc())
    out = (
        rated.withColumn("upto", F.sum(F.col("n") * F.col("w")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.coalesce(F.lag(F.floor(F.col("upto") + 0.5)).over(along), F.lit(0)))
        .withColumn("quota", F.greatest(F.least(F.floor(F.col("upto") + 0.5) - F.col("before"), F.col("n") * most), F.lit(0)))
    )
    return out.withColumn("gap", F.col("target") - F.sum(F.col("quota") * F.col("size")).over(whole)).select("source", "size", "n", "target", "w", "quota", "gap")


def _tilted(state: DataFrame, most: int) -> DataFrame:
    """The sizes above a bound keep their copies; the rates up to it take up the words left, moved towards 0 or `most`.

    For each size as the bound, `owed` is what the rates up to it lack, and `room` how far they can be moved. A bound
    promises a gap of half its size where at most half the room is needed. The largest bound that promises an eighth
    of the gap is taken, so that many documents share the words, or else the one that promises least.
    """
    whole = Window.partitionBy("source")
    larger = whole.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("size")
    out = (
        state.withColumn("slack", F.col("target") - F.sum(mass * F.col("w")).over(whole))
        .withColumn("owed", F.col("slack") + F.coalesce(F.sum((F.col("n") * F.col("w") - F.col("quota")) * F.col("size")).over(larger), F.lit(0.0)))
        .withColumn("room", F.when(F.col("owed") < 0, F.sum(mass * F.col("w")).over(smaller)).otherwise(F.sum(mass * (most - F.col("w"))).over(smaller)))
        .withColumn("promised", F.greatest(F.abs("owed") - F.col("room") / 2, F.lit(0.0)) + F.col("size") / 2)
        .withColumn("enough", F.greatest(F.min("promised").over(whole), F.abs("gap") / 8))
        .withColumn("best", F.max(F.when(F.col("promised") <= F.col("enough"), F.struct("size", "owed", "room"))).over(whole))
    )
    left = 1 - F.when(F.col("best.room") > 0, F.least(F.abs("best.owed") / F.col("best.room"), F.lit(1.0))).otherwise(0.0)
    moved = F.when(F.col("best.owed") < 0, F.col("w") * left).otherwise(most - (most - F.col("w")) * left)
    return out.select("source", "size", "n", "target", F.when(F.col("size") > F.col("best.size"), F.col("quota") / F.col("n")).otherwise(moved).alias("w"))


def retilted(state: DataFrame, most: int) -> DataFrame:
    """state with what rounding has left of each source taken up by its smaller sizes, until no source comes nearer."""
    for _ in range(ROUNDS):
        after = _rounded(_tilted(state, most), most).select(F.col("source").alias("as"), F.col("size").alias("az"), F.col("w").alias("aw"), F.col("quota").alias("aq"), F.col("gap").alias("ag"))
        nearer = F.abs("ag") < F.abs("gap") - 0.5
        pick = [F.when(nearer, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("aw", "w"), ("aq", "quota"), ("ag", "gap"))]
        both = sized(state).join(after, F.col("source").eqNullSafe(F.col("as")) & (F.col("size") == F.col("az")))
        state = materialize(both.select("source", "size", "n", "target", *pick, nearer.alias("nearer")), "mix-quotas")
        if state.filter("nearer").isEmpty():
            return state.drop("nearer")
        state = state.drop("nearer")
    raise RuntimeError(f"rounding did not settle in {ROUNDS} rounds")


def exchanged(state: DataFrame, most: int) -> DataFrame:
    """state (source, size, n, target, quota, gap) after moves of one or two copies, as long as they bring a source nearer to its target.

    A copy of a size more or less is a signed number of words. To each such number v the one nearest to gap - v is
    found next to it in their order; 0 stands for moving one copy alone.
    """
    state = materialize(state.select("source", "size", "n", "target", "quota", "gap"), "mix-exchange")
    for _ in range(ROUNDS):
        up, down = F.when(F.col("quota") < F.col("n") * most, F.col("size")), F.when(F.col("quota") > 0, -F.col("size"))
        moves = state.select("source", "gap", F.explode(F.array(up, down, F.lit(0).cast("long"))).alias("v")).filter("v is not null").distinct()
        # wanted partners and moves in one order: what is nearest to a wanted number stands beside it
        both = moves.select("source", "gap", F.col("v").cast("double").alias("at"), F.col("v").alias("move"), F.lit(None).cast("long").alias("first"))
        both = both.unionByName(moves.select("source", "gap", (F.col("gap") - F.col("v")).alias("at"), F.lit(None).cast("long").alias("move"), F.col("v").alias("first")))
        # two opposite orders, each with a frame that only grows: one that ends at the last row would be summed anew for every row
        up_, down_ = (F.col("at").asc(), F.col("move").isNull().asc()), (F.col("at").desc(), F.col("move").isNull().desc())
        below, above = (F.last("move", True).over(Window.partitionBy("source").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)) for way in (up_, down_))
        pairs = both.withColumns({"below": below, "above": above}).withColumn("second", F.explode(F.array("below", "above"))).filter("first is not null and second is not null and first <> second")
        pairs = pairs.withColumn("left_", F.abs(F.col("gap") - F.col("first") - F.col("second"))).filter(F.col("left_") < F.abs("gap") - 0.5)
        best = pairs.groupBy("source").agg(F.min(F.struct("left_", F.abs("first").alias("far"), "first", "second")).alias("b"))
        best = materialize(best.select(F.col("source").alias("bs"), F.col("b.first").alias("one"), F.col("b.second").alias("two")), "mix-moves")
        if best.isEmpty():
            return state
        moved = state.join(best, F.col("source").eqNullSafe(F.col("bs")), "left")  # one row a source
        steps = [F.when(F.abs(m) == F.col("size"), F.signum(m)).otherwise(0) for m in (F.coalesce("one", F.lit(0)), F.coalesce("two", F.lit(0)))]
        moved = moved.select("source", "size", "n", "target", (F.col("quota") + steps[0] + steps[1]).cast("long").alias("quota"), (F.col("gap") - F.coalesce("one", F.lit(0)) - F.coalesce("two", F.lit(0))).alias("gap"))
        state = materialize(moved, "mix-exchange")
    raise RuntimeError(f"exchanges did not settle in {ROUNDS} rounds")


def mix_plan(docs: DataFrame, most: int, steps: int, blocks: int, block_rows: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the rows as id, source, size, h; one row for each source; one for each source and size: base, edge, more, ties).

    A document's copies are base, and one more if its hash h is below edge, or is edge and all of its `ties` rows take one
    (more = ties); of ties that are split, rows of one id and one text, `more` take it.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("h")), "mix-sizes")
    blocks = max(blocks, -(-rows.count() // block_rows))
    cells = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("filled"))
    goals = targets(sources.select("source", "source_size"), most).withColumnRenamed("source", "s")
    means = sources.select(F.col("source").alias("m"), F.greatest(F.col("source_size") / F.greatest("filled", F.lit(1)), F.lit(1.0)).alias("mean_size"))
    goals = goals.join(means, F.col("s").eqNullSafe(F.col("m"))).withColumnRenamed("s", "source").drop("m")
    goals = dual(cells.filter("size > 0"), materialize(goals, "mix-goals"), most, steps)
    g = goals.withColumnRenamed("source", "s")

    # whole copies of each (source, size): the running sum of rates along descending sizes, cut at integers
    w = F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean_size"), most))
    rated = sized(cells.filter("size > 0")).join(g, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "target", w.alias("w"))
    quota = exchanged(retilted(materialize(_rounded(rated, most), "mix-quotas"), most), most)
    quota = quota.withColumn("base", F.floor(F.col("quota") / F.col("n"))).withColumn("rest", F.col("quota") - F.col("base") * F.col("n"))

    # the hash up to which documents take one copy more: first its block, in the order of the hashes, then its place there
    q = materialize(quota.select(F.col("source").alias("qs"), F.col("size").alias("qz"), "base", "rest"), "mix-rests")
    cell = lambda s, z: F.col("source").eqNullSafe(F.col(s)) & (F.col("size") == F.col(z))
    keyed = rows.filter("size > 0").withColumn("block", F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * blocks / F.lit(1 << 32)).cast("int"))
    over = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    by_block = keyed.groupBy("source", "size", "block").agg(F.count("*").alias("own")).withColumn("upto", F.sum("own").over(over))
    split = by_block.join(shuffled(q.filter("rest > 0")), cell("qs", "qz")).filter("upto >= rest and upto - own < rest")
    split = split.select("qs", "qz", F.col("block").alias("qb"), (F.col("rest") - F.col("upto") + F.col("own")).alias("open"))
    inside = keyed.join(shuffled(split), cell("qs", "qz") & (F.col("block") == F.col("qb"))).groupBy("source", "size", "open", "h").agg(F.count("*").alias("ties"))
    within = inside.withColumn("upto", F.sum("ties").over(Window.partitionBy("source", "size").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    edges = within.filter("upto >= open and upto - ties < open").select(F.col("source").alias("es"), F.col("size").alias("ez"), F.col("h").alias("edge"), (F.col("open") - F.col("upto") + F.col("ties")).alias("more"), "ties")
    plan = sized(q).join(edges, F.col("qs").eqNullSafe(F.col("es")) & (F.col("qz") == F.col("ez")), "left").select("qs", "qz", "base", "edge", "more", "ties")
    return rows, goals, materialize(plan, "mix-plan")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text, F.coalesce(text, F.lit("")) == "")


def copied(rows: DataFrame, plan: DataFrame, source: str, size: str, h: str, broadcast_rows: int) -> DataFrame:
    """rows with their `copies_`. Ties that are split are rows alike; they are numbered part by part, so that no window holds them all."""
    joined = rows.join(few(plan, broadcast_rows), F.col(source).eqNullSafe(F.col("qs")) & (F.col(size) == F.col("qz")), "left")
    tied = F.coalesce((F.col(h) == F.col("edge")) & (F.col("more") < F.col("ties")), F.lit(False))
    more = F.coalesce((F.col(h) <= F.col("edge")).cast("long"), F.lit(0))
    copies = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.col("base") + more).cast("long")
    plain = joined.filter(~tied).withColumn("copies_", copies)
    if plan.filter("more < ties").isEmpty():
        return plain.drop("qs", "qz", "base", "edge", "more", "ties")
    alike = materialize(joined.filter(tied).withColumn("part_", F.spark_partition_id()), "mix-alike")
    counts = alike.groupBy("qs", "qz", "part_").agg(F.count("*").alias("own"))
    before = counts.withColumn("before", F.sum("own").over(Window.partitionBy("qs", "qz").orderBy("part_")) - F.col("own"))
    before = before.select(F.col("qs").alias("bs"), F.col("qz").alias("bz"), F.col("part_").alias("bp"), "before")
    placed = alike.join(before, F.col("qs").eqNullSafe(F.col("bs")) & (F.col("qz") == F.col("bz")) & (F.col("part_") == F.col("bp")))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("qs", "qz", "part_").orderBy("edge"))
    placed = placed.withColumn("copies_", F.col("base") + (nth <= F.col("more")).cast("long")).drop("part_", "bs", "bz", "bp", "before")
    return plain.unionByName(placed).drop("qs", "qz", "base", "edge", "more", "ties")


def mix(docs: DataFrame, most: int = 3, steps: int = 6, blocks: int = 64, block_rows: int = 100_000, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's size, source_size, target, copies and taken (copies * size).

    Rows with null or empty text have size 0 and keep one copy. The words taken from a source come
    as near to its target as moves of one or two copies can bring them, once the smaller documents have taken up what
    rounding leaves. Copies are from 0 to `most`. Results depend on the rows alone, so reruns agree; repeated rows of one id and text
    count as documents of their own and may get different copies. Null sources are a source. An empty table gives an
    empty result.
    """
    rows, goals, plan = mix_plan(docs, most, steps, blocks, block_rows, id_col, text_col, source_col)
    out = copied(rows, plan, "source", "size", "h", broadcast_rows)
    out = out.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("copies_").alias("copies"), (F.col("copies_") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, most: int = 3, steps: int = 6, blocks: int = 64, block_rows: int = 100_000, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with the columns of docs. Texts are not shuffled while the plan is small."""
    _, _, plan = mix_plan(docs, most, steps, blocks, block_rows, id_col, text_col, source_col)
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no name can clash
    key, text, source = (F.col(columns[docs.columns.index(c)]) for c in (id_col, text_col, source_col))
    rows = docs.toDF(*columns).withColumns({"source_": source, "size_": size_of(text), "h_": hash_of(key, text)})
    rows = copied(rows, plan, "source_", "size_", "h_", broadcast_rows).filter("copies_ > 0")
    rows = rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))))
    return rows.select(*[F.col(c).alias(name) for c, name in zip(columns, docs.columns)])
