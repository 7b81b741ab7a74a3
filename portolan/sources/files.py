"""Readers of delimited and archived files with their checks. Everything is read by Spark, from wherever Spark reads."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_key(name: str) -> str:
    """A heading as lower-case letters and digits joined by underscores, marks dropped."""
    parts = unicodedata.normalize("NFKD", name.lstrip("﻿").replace("ß", "ss").replace("ẞ", "ss"))
    folded = "".join(c for c in parts if not unicodedata.category(c).startswith("M")).lower()
    return "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in folded).split())


def headers(spark: SparkSession, path: str, sep: str = ",", together: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Header -> files that begin with it. Each file is opened for its first line, `together` at a time."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names only
    first = lambda file: tuple(x or "" for x in spark.read.option("sep", sep).csv(_literal(file)).first() or ())
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(together) as pool:
        for file, header in zip(files, pool.map(first, files)):
            found.setdefault(header, []).append(file)
    return found


def _literal(file: str) -> str:
    """A file's name for a reader, which takes some characters as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def read_delimited(spark: SparkSession, path: str, needed: list[str], sep: str = ",", aliases: dict[str, str] | None = None) -> DataFrame:
    """The needed columns as text under plain names; malformed rows keep their text in `_corrupt`.

    Each file is read by its own header, so that files may order their columns differently or have further ones. ValueError if a
    needed column is missing in a file, or stands in it twice. No file at all is Spark's own error; files without any line have no rows.
    """
    parts = []
    for header, found in sorted(headers(spark, path, sep).items()):
        if not header:
            continue
        keys = [(aliases or {}).get(plain_key(h), plain_key(h)) for h in header]
        missing, twice = sorted(set(needed) - set(keys)), sorted(k for k in set(needed) if keys.count(k) > 1)
        if missing or twice:
            raise ValueError(f"columns are {'missing' if missing else 'doubled'}: {missing or twice} in {found[0]} and {len(found) - 1} more")
        names = [k if k in needed else f"_other{i}" for i, k in enumerate(keys)]
        schema = T.StructType([T.StructField(k, T.StringType()) for k in names] + [T.StructField("_corrupt", T.StringType())])
        rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        parts.append(rows.csv([_literal(f) for f in found]).select(*needed, "_corrupt"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in [*needed, "_corrupt"]]))
    return reduce(DataFrame.unionByName, parts)


def read_noted(spark: SparkSession, path: str, header: list[str], sep: str = ";") -> DataFrame:
    """Files with a note line before a fixed header: rows as text, by the header's names in plain form; other lines must be rows.

    Lines are told apart by what they say, not by their number, so that large files split. `_fields` counts a row's fields.
    """
    heading = sep.join(header)
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))
    rows = lines.filter(F.contains("value", F.lit(sep)) & (F.col("value") != heading))
    parts = F.split("value", f"\\{sep}", -1)
    return rows.select(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(plain_key(h)) for i, h in enumerate(header)], F.size(parts).alias("_fields"))


def pinned(spark: SparkSession, path: str, pins: dict[str, tuple[int, str]]) -> DataFrame:
    """name, length, sha256, fault for each pinned file: `missing`, `length`, `sha256` or null. Files not pinned are `unexpected`."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    wanted = spark.createDataFrame([(n, size, digest) for n, (size, digest) in pins.items()], "name string, want_length long, want_sha256 string")
    fault = F.when(F.col("want_length").isNull(), "unexpected").when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("want_length"), "length").when(F.col("sha256") != F.col("want_sha256"), "sha256")
    return found.join(wanted, "name", "full").select("name", "length", "sha256", fault.alias("fault"))


def missing_inputs(present: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Expected inputs that are not there."""
    return expected.join(present, key, "left_anti")


def archive_fault(infos: list[zipfile.ZipInfo], most_bytes: int, most_ratio: float) -> str | None:
    """Why an archive must not be unpacked."""
    names = [i.filename for i in infos]
    if len(set(names)) < len(names):
        return "duplicate"
    for i in infos:
        parts = i.filename.replace("\\", "/").split("/")
        if i.filename.startswith("/") or ".." in parts or ":" in parts[0]:
            return "path"
        if i.flag_bits & 1:
            return "encrypted"
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            return "symlink"
        if i.file_size > most_bytes or i.file_size > most_ratio * max(1, i.compress_size):
            return "size"
    return None


def main_member(names: list[str]) -> str | None:
    """The data file of an archive: no readme, the longest name, then the first in order."""
    fitting = [n for n in names if n.lower().endswith(".csv") and "readme" not in n.lower()]
    return min(fitting, key=lambda n: (-len(n), n), default=None)


def read_archives(spark: SparkSession, path: str, most_bytes: int = 1 << 31, most_ratio: float = 200.0, lines: int = 5000) -> DataFrame:
    """archive, member, line (from 0), value for each line of each archive's main member; fault instead where it is refused.

    An archive is opened by one task and its member streams through in blocks of lines; write the result as a table before wide work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "line", "value", "fault"]
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                name = where.rsplit("/", 1)[-1]
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    fault = archive_fault(archive.infolist(), most_bytes, most_ratio)
                    member = main_member(archive.namelist())
                except zipfile.BadZipFile:
                    archive, fault, member = None, "broken", None
                if fault or member is None:
                    yield pd.DataFrame([(name, None, None, None, fault or "no_member")], columns=columns)
                    continue
                held, at = [], 0
                with archive.open(member) as raw:
                    for text in io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=None):
                        held.append((name, member, at, text.rstrip("\n"), None))
                        at += 1
                        if len(held) == lines:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, line long, value string, fault string")


def split_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Rows of read_archives as columns of text, the header line left out."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return lines.filter("fault is null and line > 0").select("archive", "line", F.from_csv("value", schema, {"sep": sep}).alias("r")).select("archive", "line", "r.*")


def write_json(df: DataFrame, path: str, *order: str | Column) -> None:
    """A small report as one JSON file in a fixed order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)
