"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters; words are the runs of anything else.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share. In local mode a temporary one where none is configured."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="portolan-"))
    return sc.getCheckpointDir()


#: The tables that the innermost call of `tables` has to delete; each thread has its own.
_OPEN: ContextVar[list[str] | None] = ContextVar("portolan_tables", default=None)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes with the innermost `tables` around this call, or else when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _hadoop(df.sparkSession, path)
    files.deleteOnExit(where)
    if (mine := _OPEN.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, where = _hadoop(spark, path)
        files.delete(where, True)


def _folders(df: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in df.inputFiles()}


def drop(df: DataFrame) -> None:
    """Delete the table that `materialize` wrote for df: what was read from it must be written before."""
    delete(df.sparkSession, sorted(_folders(df)))


@contextmanager
def tables(spark: SparkSession):
    """All tables that are written inside are deleted at its end, and no others: write what was read from them before.

    What is inside gets a function keep(df): tables that df reads go to the next `tables` around this one, or stay
    until the driver ends.
    """
    mine: list[str] = []
    outer, kept = _OPEN.get(), []
    token = _OPEN.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        folders = {name.rsplit("/", 1)[-1] for name in _folders(df)}
        kept.extend(path for path in mine if path.rsplit("/", 1)[-1] in folders)
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        delete(spark, [path for path in mine if path not in kept])
        if outer is not None:
            outer.extend(kept)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that must broadcast neither side. Spark sizes a table by its file, an array by one element and an explode by one row, so what seems small may be many times that in the driver."""
    return df.hint("merge")


def few(table: DataFrame, most: int) -> DataFrame:
    """A written table, for broadcast if its counted rows are at most `most`, or else for a shuffle."""
    return F.broadcast(table) if table.count() <= most else shuffled(table)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """The words of a text; an empty array for null, empty or blank texts."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT, -1)),
    )


def bucket_of(key: Column, buckets: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)).cast("int")


def hash_limit(total: int, wanted: int) -> int:
    """The 64-bit hash up to which `wanted` of `total` hashes stand, and a few more, so that no exact rank needs all of them."""
    share = min(1.0, (wanted + 6 * wanted**0.5 + 50) / max(total, 1))
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def finite(vector: Column) -> Column:
    """Whether a vector is there, has a component, and none of them is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Finite vectors as rows of doubles; ValueError if one has another length."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))[:4]} components, not all of {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def freeing(run):
    """run, and then what it has freed goes back to the system: Python workers outlive their tasks and stages."""

    def wrapped(batches):
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # other C libraries have no such call
            pass

    return wrapped


def text_slices(table: pa.RecordBatch | pa.Table, column: str, most: int = 8 << 20):
    """Row ranges (start, stop) of at most about `most` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def flat_words(text: pa.Array, lower: bool = True):
    """(words of all texts one after another, the number of words of each text); nulls count as empty."""
    import numpy as np

    if text.offset:  # ascii_lower misreads what does not begin at the first byte of its buffer
        text = text.take(pa.array(np.arange(len(text))))
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat, parent = pc.filter(flat, full), pc.filter(parent, full)
    return flat, np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(text)).astype("int64")
