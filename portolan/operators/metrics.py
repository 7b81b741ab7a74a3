"""Metrics of scored cases for any number of slices at once.

Everything works on one row for each slice and distinct score, so ties are settled before any order matters and
running sums are taken within buckets of scores, with the sums of the other buckets added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators.running import exclusive_sums, order_key

#: The smallest distance of a probability from 0 and 1 in logarithms.
EPSILON = 2.220446049250313e-16


def by_score(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    return df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))


def cumulated(cells: DataFrame, by: list[str], score: str) -> DataFrame:
    """cells (by..., score, n, pos) with below_n and below_pos (lower scores), above_n and above_pos (this and higher ones), all_n and all_pos.

    Any scores will do, however close together: sums run in buckets of scores that hold a bounded number of them.
    """
    told = exclusive_sums(cells.withColumn("key_", order_key(F.col(score))), by, "key_", [score], ["n", "pos"])
    told = told.withColumnsRenamed({"before_n": "below_n", "before_pos": "below_pos"})
    return told.withColumns({"above_n": F.col("all_n") - F.col("below_n"), "above_pos": F.col("all_pos") - F.col("below_pos")}).drop("key_")


def ranking(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by..., n, pos, prevalence, auc, ap, brier, log_loss. auc, ap and log_loss are null where a class is missing."""
    cells = cumulated(by_score(df, by, score, label), by, score)
    p = F.greatest(F.least(F.col(score), F.lit(1.0 - EPSILON)), F.lit(EPSILON))
    neg = F.col("n") - F.col("pos")
    sums = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sum(F.col("pos") * (F.col("below_n") - F.col("below_pos") + neg / 2)).alias("pairs"), F.sum(F.col("pos") * F.col("above_pos") / F.col("above_n")).alias("precisions"),
        F.sum(F.col("pos") * (F.col(score) - 1) ** 2 + neg * F.col(score) ** 2).alias("squares"), F.sum(-F.col("pos") * F.log(p) - neg * F.log(1 - p)).alias("logs"),
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return sums.select(
        *by, "n", "pos", (F.col("pos") / F.col("n")).alias("prevalence"), F.when(both, F.col("pairs") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"),
        F.when(both, F.col("precisions") / F.col("pos")).alias("ap"), (F.col("squares") / F.col("n")).alias("brier"), F.when(both, F.col("logs") / F.col("n")).alias("log_loss"),
    )


def bin_of(score: Column, bins: int) -> Column:
    """The equal-width bin of a probability, by the edges i / bins as doubles; 1 is in the last."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= score))


def calibration(df: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """by..., n, ece: the mean distance of score and label over bins, weighted by their rows."""
    cells = df.groupBy(*by, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def thresholds(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by..., threshold, tp, fp, fn, tn, precision, recall, f1, accuracy for each distinct score as a threshold (score >= threshold)."""
    cells = cumulated(by_score(df, by, score, label), by, score).withColumnsRenamed({"above_n": "at_least", "above_pos": "tp"})
    fp, fn = F.col("at_least") - F.col("tp"), F.col("all_pos") - F.col("tp")
    tn = F.col("all_n") - F.col("all_pos") - fp
    return cells.select(
        *by, F.col(score).alias("threshold"), "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), (F.col("tp") / F.col("at_least")).alias("precision"), F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).alias("recall"),
        F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + fp + fn)).otherwise(0.0).alias("f1"), ((F.col("tp") + tn) / F.col("all_n")).alias("accuracy"),
    )


def best_f1(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """The threshold with the greatest F1; of several the lowest."""
    rows = thresholds(df, by, score, label)
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(F.round("f1", 12), -F.col("threshold"))).alias("b"))
    return best.select(*by, "b.*")


def sliced(df: DataFrame, dimensions: list[str], *keep: str) -> DataFrame:
    """Each row once for each dimension: dimension, value (as text) and what is kept."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.explode(pairs).alias("d"), *keep).select("d.dimension", "d.value", *keep)
