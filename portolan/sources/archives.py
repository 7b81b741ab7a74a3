"""Archives of files as Spark data sources: what is read is planned from an archive's directory, before any file in it is opened.

The directory at an archive's end says which files it holds. From it an archive is checked, the files that a filter on the
day leaves are dealt into partitions of some files each, and a task opens only its own, by random access, so that neither
an archive of any size nor its year is one cell or one task. Paths are any that pyarrow's file systems open.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import hashlib
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from portolan.sources.files import archive_fault, main_member
from portolan.sources.registers import days_of, yearly_fault


def opened(path: str):
    """An archive for random access, wherever it is."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        return zipfile.ZipFile(system.open_input_file(name))
    except pa.ArrowInvalid as error:  # too short for the end of a directory
        raise zipfile.BadZipFile(str(error)) from error


def found(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that a pattern in its last part matches."""
    prefix = path[: path.index(":") + 1] + "//" if "://" in path else ""
    system, name = fs.FileSystem.from_uri(path.rsplit("/", 1)[0]) if prefix else (fs.LocalFileSystem(), path.rsplit("/", 1)[0])
    last = path.rsplit("/", 1)[1]
    if not any(c in last for c in "*?["):
        whole = f"{name}/{last}"
        if system.get_file_info(whole).type != fs.FileType.Directory:
            return [path]
        name, last = whole, "*"
        path = f"{path}/*"
    files = [f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File]
    return [f"{path.rsplit('/', 1)[0]}/{f}" for f in sorted(fnmatch.filter(files, last)) if not f.startswith((".", "_"))]


@dataclass
class Block(InputPartition):
    """Files of one archive, or why it is refused."""

    path: str
    members: list[tuple[str, dt.date | None, int]]
    fault: str | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.together = int(options.get("members", "16"))
        self.content = options.get("content", "true").lower() == "true"
        self.most_bytes, self.most_ratio = int(options.get("most_bytes", str(256 << 20))), float(options.get("most_ratio", "1000"))
        self.days: list[tuple[str, object]] = []

    def plan(self, name: str, archive: zipfile.ZipFile) -> tuple[list[tuple[str, dt.date | None, int]], str | None]:
        raise NotImplementedError

    def kept(self, day: dt.date | None) -> bool:
        tests = {"=": lambda d, x: d == x, ">": lambda d, x: d > x, ">=": lambda d, x: d >= x, "<": lambda d, x: d < x, "<=": lambda d, x: d <= x, "in": lambda d, x: d in x}
        return all(day is not None and tests[op](day, value) for op, value in self.days)

    def partitions(self) -> Sequence[Block]:
        out = []
        for path in found(self.path):
            try:
                with opened(path) as archive:
                    members, fault = self.plan(path.rsplit("/", 1)[-1], archive)
            except zipfile.BadZipFile:
                members, fault = [], "broken"
            if fault:
                out.append(Block(path, [], fault))
            members = [m for m in members if self.kept(m[1])]
            out += [Block(path, members[i : i + self.together]) for i in range(0, len(members), self.together)]
        return out or [Block("", [])]


class DailyReader(ArchiveReader):
    """A file for each day of a year, and nothing else."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.member, self.most_total = options.get("member", "%Y/%Y-%m-%d.csv"), int(options.get("most_total", str(1 << 36)))

    def pushFilters(self, filters: list[Filter]):
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in ops and f.attribute == ("day",):
                self.days.append((ops[type(f)], f.value))
            # a refused archive has no day, so Spark's own filter, which drops it, stays
            yield f

    def plan(self, name, archive):
        year = re.search(r"(?<!\d)[12]\d{3}(?!\d)", name)
        if not year:
            return [], "year"
        wanted = {day.strftime(self.member): day for day in days_of(int(year[0]))}
        if fault := yearly_fault(archive.infolist(), list(wanted), self.most_bytes, self.most_ratio, self.most_total):
            return [], fault
        return [(file, day, archive.getinfo(file).file_size) for file, day in wanted.items()], None

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("day", pa.date32()), ("member", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("fault", pa.string())])
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
        name = block.path.rsplit("/", 1)[-1]
        if block.fault:
            yield row(name, None, None, None, None, None, block.fault)
        if not block.members:
            return
        if not self.content:
            for file, day, size in block.members:
                yield row(name, day, file, size, None, None, None)
            return
        with opened(block.path) as archive:
            for file, day, _ in block.members:
                try:
                    content = archive.read(file)
                    content.decode("utf-8")
                except zipfile.BadZipFile:  # the check sum is wrong
                    yield row(name, day, file, None, None, None, "broken")
                except UnicodeDecodeError:
                    yield row(name, day, file, None, None, None, "encoding")
                else:
                    yield row(name, day, file, len(content), hashlib.sha256(content).hexdigest(), content, None)


class LinesReader(ArchiveReader):
    """The lines of each archive's main file; a file that is packed can't be split, so it streams through one task in blocks."""

    def plan(self, name, archive):
        if fault := archive_fault(archive.infolist(), self.most_bytes, self.most_ratio):
            return [], fault
        member = main_member(archive.namelist())
        return ([(member, None, archive.getinfo(member).file_size)], None) if member else ([], "no_member")

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        import io

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string()), ("fault", pa.string())])
        name = block.path.rsplit("/", 1)[-1]
        if block.fault:
            yield pa.RecordBatch.from_pylist([{"archive": name, "fault": block.fault}], schema=schema)
        for file, _, _ in block.members:
            with opened(block.path) as archive, archive.open(file) as raw:
                held, at = [], 0
                for text in io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=None):
                    held.append({"archive": name, "member": file, "line": at, "value": text.rstrip("\n"), "fault": None})
                    at += 1
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)


class DailyArchives(DataSource):
    """Format `daily_archives`: archive, day, member, n_bytes, sha256, content, fault; a row for each day's file, or one for a refused archive.

    Options: path (a file, a folder, a pattern), member (a date pattern), members (files to a partition), content (false: only what the
    directory says, and no file is opened), most_bytes, most_ratio, most_total. A filter on `day` leaves only its files to be opened.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_archives"

    def schema(self) -> str:
        return "archive string, day date, member string, n_bytes long, sha256 string, content binary, fault string"

    def reader(self, schema) -> DailyReader:
        return DailyReader(dict(self.options))


class ArchiveLines(DataSource):
    """Format `archive_lines`: archive, member, line (from 0), value of each archive's main file; fault instead where it is refused."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value string, fault string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DailyArchives)
    spark.dataSource.register(ArchiveLines)
