"""Group rates that shrink to a common rate, their out-of-fold form, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(df: DataFrame, levels: list[str], *keep: str | Column) -> DataFrame:
    """One row for each level of each row: level, key (as text) and what is kept. Partial aggregation follows before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("key")) for c in levels])
    return df.select(F.explode(pairs).alias("p"), *keep).select("p.level", "p.key", *[k if isinstance(k, str) else k for k in keep])


def counts_by_level(df: DataFrame, levels: list[str], flag: str, *by: str) -> DataFrame:
    """level, key, by..., n and pos in one pass over the rows."""
    return keyed(df, levels, flag, *by).groupBy("level", "key", *by).agg(F.count("*").alias("n"), F.sum(flag).alias("pos"))


def strength(level: Column, strengths: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, k in strengths.items():
        out = F.when(level == name, F.lit(float(k))).otherwise(out)
    return out


def shrunk(pos: Column, n: Column, prior: Column, k: Column) -> Column:
    """A rate that starts at the prior and moves to its own as n outgrows k."""
    return (pos + k * prior) / (n + k)


def smoothed(df: DataFrame, strengths: dict[str, float], flag: str) -> DataFrame:
    """level, key, n, pos and rate: shrunk to the share of all rows. The common share is one row, joined to every group."""
    groups = counts_by_level(df, list(strengths), flag)
    overall = df.agg(F.avg(F.col(flag).cast("double")).alias("prior"))
    return groups.join(F.broadcast(overall)).select("level", "key", "n", "pos", shrunk(F.col("pos"), F.col("n"), F.col("prior"), strength(F.col("level"), strengths)).alias("rate"))


def out_of_fold(df: DataFrame, strengths: dict[str, float], flag: str, fold: str) -> DataFrame:
    """level, key, fold, n_other, pos_other and rate from all other folds; the prior too is that of the other folds.

    Totals and the folds' own counts come from one aggregation; counts are kept at 0 or above. With a single fold no rate exists.
    """
    own = counts_by_level(df, list(strengths), flag, fold)
    by_key, by_level = Window.partitionBy("level", "key"), Window.partitionBy(fold)
    folds = df.groupBy(fold).agg(F.count("*").alias("fold_n"), F.sum(flag).alias("fold_pos"))
    every = folds.agg(F.sum("fold_n").alias("all_n"), F.sum("fold_pos").alias("all_pos"))
    priors = folds.join(F.broadcast(every)).select(F.col(fold).alias("f_"), ((F.col("all_pos") - F.col("fold_pos")) / F.nullif(F.col("all_n") - F.col("fold_n"), F.lit(0))).alias("prior"))
    other = own.withColumn("n_other", F.greatest(F.sum("n").over(by_key) - F.col("n"), F.lit(0))).withColumn("pos_other", F.greatest(F.sum("pos").over(by_key) - F.col("pos"), F.lit(0)))
    return other.join(priors, F.col(fold).eqNullSafe(F.col("f_"))).select("level", "key", fold, "n_other", "pos_other", shrunk(F.col("pos_other"), F.col("n_other"), F.col("prior"), strength(F.col("level"), strengths)).alias("rate"))


def budgets(folds: DataFrame, fold: str, most: int) -> DataFrame:
    """fold, quota: `most` rows dealt nearly evenly, the first folds getting the remainder. One row for each fold."""
    size = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(fold)) - 1
    return folds.select(fold).distinct().select(F.col(fold).alias("fold_"), (F.floor(F.lit(most) / size) + (place < F.lit(most) % size).cast("int")).cast("long").alias("quota"))


def bounded_sample(df: DataFrame, fold: str, key: Column, most: int) -> DataFrame:
    """A uniform sample of at most the fold's quota: the rows with the smallest hashes of their key, which reruns repeat.

    Ranks up to the largest quota are cut before the shuffle, so no fold's rows meet in one task whole.
    """
    hashed = df.withColumn("hash_", F.md5(key.cast("string")))
    ranked = hashed.withColumn("place", F.row_number().over(Window.partitionBy(fold).orderBy("hash_"))).filter(F.col("place") <= most)
    return ranked.join(F.broadcast(budgets(df, fold, most)), F.col(fold) == F.col("fold_")).filter(F.col("place") <= F.col("quota")).drop("fold_", "hash_", "quota")


def ranked_vocabulary(df: DataFrame, caps: dict[str, int], nulls: bool = True) -> DataFrame:
    """field, value, n and rank by (-n, value), at most the field's cap; null is a value too, unless nulls is False. The largest cap is cut before the shuffle."""
    cap = F.lit(None).cast("int")
    for name, most in caps.items():
        cap = F.when(F.col("level") == name, F.lit(most)).otherwise(cap)
    pairs = keyed(df, list(caps))
    groups = (pairs if nulls else pairs.filter("key is not null")).groupBy("level", "key").agg(F.count("*").alias("n"))
    place = Window.partitionBy("level").orderBy(F.col("n").desc(), "key")
    return groups.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= max(caps.values())).filter(F.col("rank") <= cap).withColumnsRenamed({"level": "field", "key": "value"})
