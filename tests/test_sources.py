"""Readers and their checks on small files."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from portolan.operators import validation, zones
from portolan.sources import files, registers
from portolan.sources.html import first_tables


def test_headings_without_marks_and_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Situação Voo;Número Voo;Other\nREALIZADO;1234;x\n;55;y\n", encoding="utf-8")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), ["numero_voo", "status"], ";", {"situacao_voo": "status"})
    assert [tuple(r) for r in rows.orderBy("numero_voo").collect()] == [("1234", "REALIZADO", None), ("55", None, None)]
    with pytest.raises(ValueError, match="gate"):
        files.read_delimited(spark, str(tmp_path / "a.csv"), ["gate"], ";")


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "one [x].csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "two.csv").write_text("Y,extra,X\n20,e,10\n40,,30\n")
    (tmp_path / "none.csv").write_text("")
    rows = files.read_delimited(spark, str(tmp_path), ["x", "y"])
    assert sorted((r.x, r.y) for r in rows.collect()) == [("1", "2"), ("10", "20"), ("3", "4"), ("30", "40")]
    (tmp_path / "bad.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match=r"missing: \['y'\].*bad.csv"):
        files.read_delimited(spark, str(tmp_path), ["x", "y"])
    (tmp_path / "bad.csv").write_text("x,y,X\n1,2,3\n")
    with pytest.raises(ValueError, match="doubled"):
        files.read_delimited(spark, str(tmp_path), ["x", "y"])


def test_rows_are_accounted_for(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Carrier,Minutes\nLH,15\n,3\nXX,abc\nLH,2000\nLH,-1\n")
    rows = files.read_delimited(spark, str(tmp_path / "b.csv"), ["carrier", "minutes"])
    n = F.col("minutes").try_cast("int")
    checked = validation.audited(rows, [("carrier", F.length("carrier") > 0), ("number", n.isNotNull()), ("range", n.between(0, 1440))])
    got = {r.reason: r.n for r in validation.accounting(checked).collect()}
    assert got == {"accepted": 1, "carrier": 1, "number": 1, "range": 2} and sum(got.values()) == rows.count()


def test_note_line_before_a_fixed_header(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿Data de referência: hoje\r\nCód. Empresa;Nr. Voo\r\nABC;0100\r\nDEF;\r\nBAD;1;2\r\n".encode())
    rows = files.read_noted(spark, str(tmp_path / "c.csv"), ["Cód. Empresa", "Nr. Voo"])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("ABC", "0100", 2), ("DEF", None, 2), ("BAD", "1", 3)], key=str)


def test_pins(spark, tmp_path):
    for name, text in (("x", b"one"), ("y", b"two"), ("z", b"new")):
        (tmp_path / name).write_bytes(text)
    digest = hashlib.sha256(b"one").hexdigest()
    got = {r.name: r.fault for r in files.pinned(spark, str(tmp_path), {"x": (3, digest), "y": (3, digest), "gone": (1, digest)}).collect()}
    assert got == {"x": None, "y": "sha256", "z": "unexpected", "gone": "missing"}


def test_archives(spark, tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members:
                z.writestr(member, text)

    pack("good.zip", [("readme_long_name.csv", "no"), ("d.csv", "a,b\n1,2\n3,\n"), ("x.txt", "")])
    pack("path.zip", [("../d.csv", "a,b\n1,2\n")])
    pack("bomb.zip", [("d.csv", "0" * 1_000_000)])
    pack("empty.zip", [("x.txt", "")])
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    lines = files.read_archives(spark, f"{tmp_path}/*.zip", lines=2).cache()
    assert {r.archive: r.fault for r in lines.filter("fault is not null").collect()} == {"path.zip": "path", "bomb.zip": "size", "empty.zip": "no_member", "broken.zip": "broken"}
    rows = files.split_lines(lines, ["a", "b"]).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [("good.zip", 1, "1", "2"), ("good.zip", 2, "3", None)]
    assert files.main_member(["b.csv", "aa.csv", "cc.csv", "README_all.csv"]) == "aa.csv"


def test_missing_inputs_and_reports(spark, tmp_path):
    present, expected = spark.createDataFrame([(1,)], "m int"), spark.createDataFrame([(1,), (2,)], "m int")
    assert [r.m for r in files.missing_inputs(present, expected, ["m"]).collect()] == [2]
    files.write_json(expected, str(tmp_path / "out"), F.col("m").desc())
    assert [r.m for r in spark.read.json(str(tmp_path / "out")).collect()] == [2, 1]


def test_tables_in_pages(spark):
    page = "<p>x</p><table id='a'><tr><td>no</td></tr></table><table id='b'><tr><th>H &amp; M</th><th>two\n words</th></tr><tr><td>1<table><tr><td>in</td></tr></table></td></tr></table><table><tr><td>later</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "id int, html string")
    assert [tuple(r) for r in first_tables(pages, "id", "html", "b").collect()] == [(1, 0, 0, "H & M"), (1, 0, 1, "two words"), (1, 1, 0, "1in")]
    assert [r.text for r in first_tables(pages, "id", "html").collect()] == ["no"]


def test_yearly_archives(spark, tmp_path):
    def pack(name, year, change=lambda members: members):
        members = change({d.strftime("%Y/%Y-%m-%d.csv"): f"\ufeffa,b\r\n{d.month},{d.day}\r\n" for d in registers.days_of(year)})
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{year}/", "")
            for member, text in members.items():
                z.writestr(member, text)

    pack("plan_2024.zip", 2024)
    pack("short_2023.zip", 2023, lambda m: {k: v for k, v in m.items() if not k.endswith("-31.csv")})
    pack("blank_2022.zip", 2022, lambda m: m | {"2022/2022-05-01.csv": ""})
    pack("bytes_2021.zip", 2021, lambda m: m | {"2021/2021-05-01.csv": b"\xff\xfe"})
    pack("other.zip", 2020)
    (tmp_path / "torn_2019.zip").write_bytes(b"nothing")
    members = registers.read_daily_members(spark, f"{tmp_path}/*.zip").cache()
    assert {r.archive: r.fault for r in members.filter("fault is not null").collect()} == {"short_2023.zip": "calendar", "blank_2022.zip": "empty", "bytes_2021.zip": "encoding", "other.zip": "year", "torn_2019.zip": "broken"}
    lines = registers.daily_lines(members)
    assert [tuple(r) for r in lines.groupBy("archive", "line").count().orderBy("line").collect()] == [("plan_2024.zip", 0, 366), ("plan_2024.zip", 1, 366)]
    assert lines.filter("line = 1 and value = concat_ws(',', month(day), day(day))").count() == 366
    assert lines.filter("line = 0 and value = 'a,b'").count() == 366


def test_boundaries_with_holes(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    feature = lambda zone, kind, coordinates: {"type": "Feature", "properties": {"tzid": zone}, "geometry": {"type": kind, "coordinates": coordinates}}

    def pack(name, document):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("all.json", document if isinstance(document, str) else json.dumps(document))

    pack("good.zip", {"type": "FeatureCollection", "features": [feature("ring", "Polygon", [square(0, 10), square(4, 6)]), feature("two", "MultiPolygon", [[square(20, 22)], [square(30, 32)]])]})
    pack("bad.zip", {"type": "FeatureCollection", "features": [feature("open", "Polygon", [square(0, 1)[:4]]), feature("", "Polygon", [square(0, 1)]), feature("dot", "Point", [0, 0]), feature("far", "Polygon", [square(0, 300)]), feature("text", "Polygon", [["x"]]), None]})
    pack("none.zip", "{}")
    pack("torn.zip", "{")
    found = registers.read_boundaries(spark, f"{tmp_path}/*.zip").cache()
    assert [r.fault for r in found.filter("archive = 'bad.zip'").orderBy("position").collect()] == ["ring", "name", "type", "coordinates", "coordinates", "feature"]
    assert {r.archive: r.fault for r in found.filter("position is null").collect()} == {"none.zip": "collection", "torn.zip": "broken"}
    good = found.filter("archive = 'good.zip'")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 21.0, 21.0), (4, 31.0, 31.0), (5, 26.0, 26.0)], "id int, lat double, lon double")
    assert {r.id: (r.zone, r.disposition) for r in zones.located(points, registers.zone_shapes(good), "lat", "lon").collect()} == {1: ("ring", "resolved"), 2: (None, "outside"), 3: ("two", "resolved"), 4: ("two", "resolved"), 5: (None, "outside")}
    for table, what in ((found, "faulty"), (good.union(good), "twice")):
        with pytest.raises(ValueError, match=what):
            registers.zone_shapes(table)


def test_registers_of_places(spark):
    rows = [("eddf", "fra", " Frankfurt  Main", "de", "50.03", "8.57"), ("EDDF", "FRA ", "Frankfurt Main", "DE", "50.03", "8.57"), (None, "JFK", "Kennedy", "US", "40.6", "-73.8"), ("", " ", "x", "US", "1", "1"), ("ABCDE", None, "x", "US", "1", "1"), ("ABCD", None, "", "US", "1", "1"), ("ABCD", None, "x", "US", "91", "1"), (None,) * 6]
    checked = registers.places(spark.createDataFrame(rows, "icao string, iata string, name string, country string, lat string, lon string"))
    assert {(r.icao, r.iata, r.n_rows) for r in registers.place_index(checked).collect()} == {("EDDF", "FRA", 2), (None, "JFK", 1)}
    assert {r.reason: r.n for r in validation.accounting(checked).collect()} == {"accepted": 2, "no_code": 2, "icao": 1, "name": 1, "coordinates": 1}
    other = registers.places(spark.createDataFrame([*rows, ("EDDF", None, "Elsewhere", "DE", "1", "1")], "icao string, iata string, name string, country string, lat string, lon string"))
    with pytest.raises(ValueError, match="icao"):
        registers.place_index(other)
