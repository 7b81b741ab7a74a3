"""Folds over rows in order within a key, for keys of a bounded number of rows."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def key_text(key: str) -> Column:
    """A key as text that is never null: a null key is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """rows with the columns of `schema` from step(state, row) -> (state, values), in order within each key. A null key is a key.

    One task goes through a key's rows, and holds its state only; quotas.fixed_window and states.transitions do without that for hot keys.
    """
    added = T.StructType.fromDDL(schema)
    rows = rows.withColumn("key_", key_text(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = object(), None
        for batch in batches:
            kind, out = namedtuple("Row", batch.schema.names, rename=True), []
            for row in map(kind._make, zip(*(c.to_pylist() for c in batch.columns))):
                if row.key_ != held:
                    held, state = row.key_, start()
                state, values = step(state, row)
                out.append(values)
            columns = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(zip(*out), added)] if out else [pa.array([], to_arrow_type(f.dataType)) for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("key_").sortWithinPartitions("key_", *order).mapInArrow(run, f"{kept}, {schema}").drop("key_")
