"""Categories as sparse vectors from a stored vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.operators.rates import ranked_vocabulary

#: The fields of a sparse vector, as pyspark.ml stores one.
VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def vocabulary(fitted: DataFrame, caps: dict[str, int]) -> DataFrame:
    """field, value, n, rank, base (the field's first place in the vector), size (of the whole vector), total (fitted rows).

    Fields stand in the order of `caps`; each has a place for each of its values, then one for unknown values, for the log count and
    for the frequency. At most as many rows as the caps add up to; keep it as a table to encode later rows alike. A field
    without any value has one row whose value is null.
    """
    order = F.array(*map(F.lit, caps))
    words = ranked_vocabulary(fitted, caps, nulls=False)
    fields = fitted.sparkSession.createDataFrame([(f,) for f in caps], "field string")
    words = F.broadcast(fields).join(words, "field", "left").withColumn("at_", F.array_position(order, F.col("field")))
    widths = words.groupBy("field", "at_").agg((F.count("value") + 3).alias("width"))
    every = Window.partitionBy(F.lit(0))  # one row a field
    placed = widths.select("field", (F.sum("width").over(every.orderBy("at_")) - F.col("width")).cast("int").alias("base"), F.sum("width").over(every).cast("int").alias("size"))
    total = fitted.agg(F.count("*").alias("total"))
    return words.join(placed, "field").join(F.broadcast(total)).select("field", "value", "n", "rank", "base", "size", "total", F.count("value").over(Window.partitionBy("field")).cast("int").alias("known"))


def encoded(rows: DataFrame, words: DataFrame, fields: list[str], name: str = "features") -> DataFrame:
    """rows with one sparse vector of all fields: 1 at the value's place or at the unknown one, log(1 + n) and n / total where the value is known.

    Null values are unknown. Each field is a broadcast join with its part of the vocabulary, which its caps bound.
    """
    columns = rows.columns
    for i, field in enumerate(fields):
        own = words.filter(F.col("field") == field)
        frame = own.select(F.col("base").alias(f"base{i}_"), F.col("known").alias(f"known{i}_"), F.col("size").alias("size_")).limit(1)
        known = own.filter("value is not null").select(F.col("value").alias(f"value{i}_"), F.col("rank").alias(f"rank{i}_"), F.col("n").alias(f"n{i}_"), F.col("total").alias(f"total{i}_"))
        rows = rows.drop("size_").join(F.broadcast(frame)).join(F.broadcast(known), F.col(field).cast("string") == F.col(f"value{i}_"), "left")
    parts = []
    for i in range(len(fields)):
        at, base, known = F.col(f"rank{i}_"), F.col(f"base{i}_"), F.col(f"known{i}_")
        entry = lambda place, value: F.struct(place.cast("int").alias("i"), value.cast("double").alias("v"))
        seen = F.array(entry(base + at - 1, F.lit(1.0)), entry(base + known + 1, F.log1p(f"n{i}_")), entry(base + known + 2, F.col(f"n{i}_") / F.col(f"total{i}_")))
        parts.append(F.when(at.isNull(), F.array(entry(base + known, F.lit(1.0)))).otherwise(seen))
    rows = rows.withColumn("entries_", F.concat(*parts))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.col("size_").alias("size"), F.col("entries_.i").alias("indices"), F.col("entries_.v").alias("values"))
    return rows.select(*columns, vector.alias(name))


def as_ml_vectors(rows: DataFrame, name: str = "features") -> DataFrame:
    """rows with the column as a vector that pyspark.ml takes."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    vector = F.udf(lambda v: SparseVector(v["size"], v["indices"], v["values"]), VectorUDT())
    return rows.withColumn(name, vector(name))
