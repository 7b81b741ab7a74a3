"""Running sums along an order, for groups of any size, and tables that cut a long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(x: Column) -> Column:
    """A long that never falls where x, a double, rises; at most some thousand doubles share one. Nulls come first, NaN last.

    It is the logarithm in steps of 2**-40, which is as fine as neighbouring doubles are to a factor of 2**13.
    """
    size = F.floor((F.log(F.abs(x)) + 746) * float(1 << 40)).cast("long") + 1
    finite = F.when(x == 0, F.lit(0).cast("long")).when(F.abs(x) == float("inf"), F.lit(1 << 52)).otherwise(size)
    signed = F.when(x < 0, -finite).otherwise(finite)
    return F.when(x.isNull(), F.lit(-(1 << 53))).when(F.isnan(x), F.lit(1 << 53)).otherwise(signed)


def same_group(by: list[str], suffix: str = "_") -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(c + suffix))
    return out


def exclusive_sums(rows: DataFrame, by: list[str], key: str, order: list[str], measures: list[str], most: int = 100_000, shift: int = 28, finest: int = 0) -> DataFrame:
    """rows with before_<m>, the sum of m over the group's rows earlier in (key, order), and all_<m>, over the whole group.

    key is a long that never falls along the order, and rows of a group differ in the order. Sums run within buckets of the key, and
    the buckets' own sums are carried from one to the next, by the same means where a group has more than `most` buckets. Buckets
    are made finer until none holds more than `most` rows of a group, or they hold 2**finest keys. Only counts reach the driver.
    """
    while True:
        per_bucket = rows.groupBy(*by, F.shiftright(key, shift).alias("c_")).agg(F.count("*").alias("n_"))
        inside, outside = per_bucket.groupBy(*by).agg(F.max("n_").alias("in_"), F.count("*").alias("out_")).agg(F.max("in_"), F.max("out_")).first()
        if shift <= finest or (inside or 0) <= most:
            break
        shift = max(finest, shift - 14)
    rows = rows.withColumn("c_", F.shiftright(key, shift))
    per = rows.groupBy(*by, "c_").agg(*[F.sum(m).alias(m) for m in measures])
    named = [F.col(c).alias(f"{c}_") for c in by] + [F.col("c_").alias("c__")]
    if (outside or 0) <= most:
        group = Window.partitionBy(*by)
        earlier = group.orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select(*named, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"carried_{m}") for m in measures], *[F.sum(m).over(group).alias(f"all_{m}") for m in measures])
    else:
        deeper = exclusive_sums(per.withColumnRenamed("c_", "k_"), by, "k_", ["k_"], measures, most, 14, 14).withColumnRenamed("k_", "c_")
        carried = deeper.select(*named, *[F.col(f"before_{m}").alias(f"carried_{m}") for m in measures], *[f"all_{m}" for m in measures])
    within = Window.partitionBy(*by, "c_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"own_{m}": F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures})
    joined = own.join(carried, same_group(by) & (F.col("c_") == F.col("c__")))
    kept = [c for c in rows.columns if c != "c_"]
    return joined.select(*kept, *[(F.col(f"own_{m}") + F.col(f"carried_{m}")).alias(f"before_{m}") for m in measures], *[f"all_{m}" for m in measures])


def exact_quantile(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by..., name: the exact quantile of each group's non-null values, between two of them by proportion. Groups without any are left out.

    Values are counted, ranked by running sums in bounded buckets and picked by rank, so that no task holds a group's values.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("n_"))
    ranked = exclusive_sums(cells.withColumn("key_", order_key(F.col("v_"))), by, "key_", ["v_"], ["n_"])
    at = (F.col("all_n_") - 1) * F.lit(float(share))
    pick = lambda place: F.max(F.when((F.col("before_n_") <= place) & (place < F.col("before_n_") + F.col("n_")), F.col("v_")))
    ends = ranked.groupBy(*by).agg(pick(F.floor(at)).alias("low_"), pick(F.ceil(at)).alias("high_"), F.max(at - F.floor(at)).alias("part_"))
    return ends.select(*by, (F.col("low_") + (F.col("high_") - F.col("low_")) * F.col("part_")).alias(name))


def settled(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir, which goes when the driver ends: it cuts lineage and survives lost executors.

    Where the setting is missing a temporary folder is taken in local mode; on a cluster that is a ValueError.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
