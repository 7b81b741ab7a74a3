"""Time-ordered operators: as-of values, counts of what was known before, latest revisions, recurrences.

A key may hold a third of all rows, so no window runs over a whole key: as-of lookups stay within spans as long as
the greatest age, counts are summed within spans and carried over from earlier ones, and the latest row of a group
is a maximum, which is aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(queries: DataFrame, observations: DataFrame, key: str, at: str, values: list[str], most_age: int) -> DataFrame:
    """queries with, for each of values, its latest non-null observation at or before `at` (`<v>`, `<v>_age`), if not older than most_age.

    `at` is an integer instant in both tables. An observation can serve its own span of most_age and the next one, so it
    is sent to both, and each span is a window of its own. Observations at one instant: the largest value. A null key meets
    nothing.
    """
    seen = observations.filter(F.col(key).isNotNull()).groupBy(key, at).agg(*[F.max(v).alias(v) for v in values])
    span = F.floor(F.col(at) / most_age).cast("long")
    seen = seen.select(key, F.col(at).alias("t_"), F.explode(F.array(span, span + 1)).alias("span_"), F.lit(0).alias("side_"), *values)
    asked = queries.withColumn("row_", F.struct(*queries.columns)).select(key, F.col(at).alias("t_"), span.alias("span_"), F.lit(1).alias("side_"), "row_")
    both = asked.unionByName(seen, allowMissingColumns=True)
    before = Window.partitionBy(key, "span_").orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(v).isNotNull(), F.struct("t_", F.col(v).alias("v"))), ignorenulls=True).over(before).alias(f"last_{v}") for v in values]
    found = both.select("t_", "side_", "row_", *last).filter("side_ = 1")
    fresh = [(v, F.col("t_") - F.col(f"last_{v}.t_")) for v in values]
    columns = [c for v, age in fresh for c in (F.when(age <= most_age, F.col(f"last_{v}.v")).alias(v), F.when(age <= most_age, age).alias(f"{v}_age"))]
    return found.select("row_.*", *columns)


def fitting_span(events: DataFrame, by: list[str], at: str, span: int, most: int) -> int:
    """span, halved until no group has more than `most` events in one span, or a span is an instant. Few rows reach the driver."""
    while span > 1:
        busiest = events.groupBy(*by, F.floor(F.col(at) / span)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if busiest <= most:
            break
        span = max(1, span // max(2, -(-busiest // most)))
    return span


def known_before(queries: DataFrame, events: DataFrame, by: list[str], at: str, measures: list[str], span: int, most: int = 2_000_000) -> DataFrame:
    """queries with the sum of each measure over the events of the same group strictly before `at`.

    Ties see neither each other nor what happens at that instant. Events are first summed for each group, instant; then
    running sums stay within a span, and the sums of earlier spans are added: one row for each group and span. Spans are
    at most `span` long and hold at most about `most` events of a group.
    """
    span = fitting_span(events, by, at, span, most)
    bucket = F.floor(F.col(at) / span).cast("long")
    summed = events.groupBy(*by, at).agg(*[F.sum(m).alias(m) for m in measures]).withColumn("span_", bucket)
    by_span = summed.groupBy(*by, "span_").agg(*[F.sum(m).alias(m) for m in measures])
    marks = queries.select(*by, bucket.alias("span_")).distinct().unionByName(by_span, allowMissingColumns=True).groupBy(*by, "span_").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*by).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*by, "span_", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"carried_{m}") for m in measures])
    within = Window.partitionBy(*by, "span_").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    asked = queries.withColumn("row_", F.struct(*queries.columns)).select(*by, at, bucket.alias("span_"), "row_")
    both = asked.unionByName(summed, allowMissingColumns=True)
    sums = both.select(*by, "span_", "row_", *[F.coalesce(F.sum(m).over(within), F.lit(0)).alias(f"own_{m}") for m in measures]).filter("row_ is not null")
    return sums.join(carried, [*by, "span_"]).select("row_.*", *[(F.col(f"own_{m}") + F.col(f"carried_{m}")).alias(m) for m in measures])


def known_before_by_level(rows: DataFrame, levels: list[str], asked: str, known: str, measures: list[str], span: int, most: int = 50_000) -> DataFrame:
    """The columns of rows, with of_<level>: the sum of each measure over the rows that share the level's value and whose `known` is strictly before the row's `asked`.

    As known_before for many groupings at once, without one copy of the rows for each: they are dealt by spans of time, in which all levels'
    running sums are taken, and each level's sums of earlier spans stand in as a row before the span. A null level or time meets nothing.
    """
    past = rows.filter(F.col(known).isNotNull()).select(F.col(known).alias("t_"), *levels, *[F.coalesce(m, F.lit(0)).cast("long").alias(f"sum_{m}") for m in measures])
    asks = rows.select(F.col(asked).alias("t_"), *levels, *[F.lit(0).cast("long").alias(f"sum_{m}") for m in measures], F.struct(*rows.columns).alias("row_"))
    both = asks.unionByName(past, allowMissingColumns=True)
    span = fitting_span(both, [], "t_", span, most)
    both = both.withColumn("span_", F.floor(F.col("t_") / span).cast("long"))
    sums = [F.sum(f"sum_{m}").alias(f"sum_{m}") for m in measures]
    cells = both.groupBy("span_", *levels).agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(x).alias("key")) for i, x in enumerate(levels)])).alias("p_")
    by_span = cells.select("span_", pairs, *[f"sum_{m}" for m in measures]).groupBy("p_.level", "p_.key", "span_").agg(*sums).filter("key is not null and span_ is not null")
    earlier = Window.partitionBy("level", "key").orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_span.select("level", "key", "span_", *[F.sum(f"sum_{m}").over(earlier).alias(f"sum_{m}") for m in measures]).filter(F.col(f"sum_{measures[0]}").isNotNull())
    carried = carried.select((F.col("span_") * span - 1).alias("t_"), "span_", *[F.when(F.col("level") == i, F.col("key")).alias(x) for i, x in enumerate(levels)], *[f"sum_{m}" for m in measures])
    dealt = both.unionByName(carried, allowMissingColumns=True).repartition("span_")
    for x in levels:
        before = Window.partitionBy("span_", x).orderBy("t_").rangeBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn(f"of_{x}", F.struct(*[F.when(F.col(x).isNotNull(), F.coalesce(F.sum(f"sum_{m}").over(before), F.lit(0))).otherwise(0).alias(m) for m in measures]))
    return dealt.filter("row_ is not null").select("row_.*", *[f"of_{x}" for x in levels])


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest order of each group; nulls in the order rank lowest. The order must be total."""
    top = F.max_by(F.struct(*df.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*by).agg(top.alias("top_")).select("top_.*")


def latest_with_ties(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """df with n_latest (rows at the group's last instant) and disposition: superseded, selected, or ambiguous where several are last."""
    last = df.groupBy(*by).agg(F.max(at).alias("last_"))
    counts = df.groupBy(*by, at).agg(F.count("*").alias("n_latest")).withColumnRenamed(at, "last_")
    tops = last.join(counts, [*by, "last_"])
    kind = F.when(F.col(at) < F.col("last_"), "superseded").when(F.col("n_latest") > 1, "ambiguous").otherwise("selected")
    return df.join(tops, by).withColumn("disposition", kind).drop("last_")


def expand_series(series: DataFrame, start: str, end: str, mask: str) -> DataFrame:
    """One row for each service date from start to end whose weekday (Monday first) is set in the mask."""
    dated = series.withColumn("service_date", F.explode(F.sequence(start, end)))
    return dated.filter(F.element_at(mask, F.weekday("service_date") + 1))


def consecutive_months(months: DataFrame, month: str) -> DataFrame:
    """Each first-of-month date with whether it directly follows the one before it. One row a month."""
    before = F.lag(month).over(Window.orderBy(month))
    return months.select(month, F.coalesce(before == F.add_months(month, -1), F.lit(True)).alias("consecutive"))


def with_snapshot(predictions: DataFrame, snapshot: DataFrame, by: list[str], at: str, as_of: int, measures: list[str]) -> DataFrame:
    """predictions with the measures of a snapshot taken at `as_of`, 0 for groups it has not.

    The plan itself fails on a prediction older than the snapshot, or without a time: such a row must not be scored with what was known later, and is not dropped silently either.
    """
    late = F.coalesce(F.col(at) >= as_of, F.lit(False))
    checked = predictions.withColumn(at, F.when(late, F.col(at)).otherwise(F.raise_error(F.concat(F.lit(f"a prediction is older than its snapshot of {as_of}: "), F.coalesce(F.col(at).cast("string"), F.lit("no time")))).cast("long")))
    joined = checked.join(snapshot.select(*by, *measures), by, "left")
    return joined.select(*predictions.columns, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])
