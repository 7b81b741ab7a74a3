"""Archives as data sources: checks before any file is opened, filters that reach the reader."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from portolan.sources import archives, files, registers


def corrupt(path, member):
    """Flip a byte of a member's packed content, so that whoever opens it meets a wrong check sum."""
    with zipfile.ZipFile(path) as z:
        info = z.getinfo(member)
    data = bytearray(path.read_bytes())
    data[info.header_offset + 30 + len(info.filename) + 2] ^= 0xFF
    path.write_bytes(bytes(data))


@pytest.fixture
def packed(tmp_path):
    def pack(name, year, change=lambda m: m):
        members = {day.strftime("%Y/%Y-%m-%d.csv"): f"a,b\n{day.month},{day.day}\n" for day in registers.days_of(year)}
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
            for member, text in change(members).items():
                z.writestr(member, text)
        return tmp_path / name

    return pack


def test_a_date_filter_opens_one_file(spark, tmp_path, packed):
    archives.register(spark)
    path = packed("plan_2024.zip", 2024)
    for day in registers.days_of(2024):
        if day != dt.date(2024, 2, 29):
            corrupt(path, day.strftime("%Y/%Y-%m-%d.csv"))
    rows = spark.read.format("daily_archives").option("members", 10).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 37
    one = rows.filter(F.col("day") == dt.date(2024, 2, 29))
    assert one.rdd.getNumPartitions() == 1
    assert [(r.day, r.fault, bytes(r.content)) for r in one.collect()] == [(dt.date(2024, 2, 29), None, b"a,b\n2,29\n")]
    few = rows.filter((F.col("day") >= dt.date(2024, 2, 28)) & (F.col("day") < dt.date(2024, 3, 2)))
    assert few.rdd.getNumPartitions() == 1 and sorted((r.day.day, r.fault) for r in few.collect()) == [(1, "broken"), (28, "broken"), (29, None)]
    assert rows.filter(F.col("day").isin(dt.date(2024, 1, 1), dt.date(2030, 1, 1))).count() == 1 and rows.filter("day > date '2024-12-31'").count() == 0
    listed = spark.read.format("daily_archives").option("content", "false").load(str(path))  # the directory only: no fault is met
    assert listed.filter("fault is null and content is null and n_bytes > 0").count() == 366


def test_a_bad_archive_opens_none(spark, tmp_path, packed):
    archives.register(spark)
    packed("good_2023.zip", 2023)
    packed("short_2022.zip", 2022, lambda m: {k: v for k, v in m.items() if not k.endswith("-31.csv")})
    packed("path_2021.zip", 2021, lambda m: m | {"../x.csv": "x"})
    packed("blank_2020.zip", 2020, lambda m: m | {"2020/2020-05-01.csv": ""})
    packed("bytes_2019.zip", 2019, lambda m: m | {"2019/2019-05-01.csv": b"\xff\xfe"})
    packed("other.zip", 2018)
    (tmp_path / "torn_2017.zip").write_bytes(b"nothing")
    rows = spark.read.format("daily_archives").load(f"{tmp_path}/*.zip").cache()
    assert {r.archive: r.fault for r in rows.filter("day is null").collect()} == {"short_2022.zip": "calendar", "path_2021.zip": "path", "blank_2020.zip": "empty", "other.zip": "year", "torn_2017.zip": "broken"}
    assert {r.archive: r["count"] for r in rows.filter("day is not null").groupBy("archive").count().collect()} == {"good_2023.zip": 365, "bytes_2019.zip": 365}
    whole = registers.read_daily_members(spark, f"{tmp_path}/*.zip")  # the same rows as from whole archives
    assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty()
    assert registers.daily_lines(rows).filter("line = 1 and value = concat_ws(',', month(day), day(day))").count() == 365  # an archive with a fault is left out whole


def test_lines_of_archives(spark, tmp_path):
    archives.register(spark)

    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members:
                z.writestr(member, text)

    pack("good.zip", [("readme_long_name.csv", "no"), ("d.csv", "a,b\n" + "".join(f"{i},2\n" for i in range(12_000))), ("x.txt", "")])
    pack("path.zip", [("../d.csv", "a,b\n1,2\n")])
    pack("bomb.zip", [("d.csv", "0" * 5_000_000)])
    pack("empty.zip", [("x.txt", "")])
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    lines = spark.read.format("archive_lines").option("most_ratio", 200).load(f"file://{tmp_path}/*.zip").cache()
    assert {r.archive: r.fault for r in lines.filter("fault is not null").collect()} == {"path.zip": "path", "bomb.zip": "size", "empty.zip": "no_member", "broken.zip": "broken"}
    assert files.split_lines(lines, ["a", "b"]).filter("a = line - 1 and b = 2").count() == 12_000
    (tmp_path / "none").mkdir()
    assert spark.read.format("archive_lines").load(f"{tmp_path}/none").count() == 0
