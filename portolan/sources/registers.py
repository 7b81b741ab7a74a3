"""Yearly archives of daily files, boundaries in archives, and registers of places that have codes."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
import math
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.operators.matching import assert_empty, conflicts
from portolan.operators.validation import audited, code
from portolan.sources.files import archive_fault


def days_of(year: int) -> list[dt.date]:
    first = dt.date(year, 1, 1)
    return [first + dt.timedelta(days=d) for d in range((dt.date(year + 1, 1, 1) - first).days)]


def yearly_fault(infos: list[zipfile.ZipInfo], wanted: list[str], most_bytes: int, most_ratio: float, most_total: int) -> str | None:
    """Why a yearly archive is refused: unsafe, not exactly the wanted files, an empty one, or too much in all."""
    files = [i for i in infos if not i.is_dir()]
    if fault := archive_fault(infos, most_bytes, most_ratio):
        return fault
    if len({i.filename.lower() for i in infos}) < len(infos):
        return "duplicate"
    if sorted(i.filename for i in files) != sorted(wanted):
        return "calendar"
    if any(i.file_size == 0 for i in files):
        return "empty"
    return "size" if sum(i.file_size for i in files) > most_total else None


def read_daily_members(spark: SparkSession, path: str, member: str = "%Y/%Y-%m-%d.csv", most_bytes: int = 256 << 20, most_ratio: float = 1000.0, most_total: int = 1 << 36) -> DataFrame:
    """archive, day, member, n_bytes, sha256, content, fault: a row for each daily file, or one row with what is wrong with the archive.

    An archive's year is the first run of four digits in its name; it must hold a file for each day of that year and no
    other. One task unpacks an archive, a file at a time; write the result as a table before wide work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "day", "member", "n_bytes", "sha256", "content", "fault"]
        for pdf in batches:
            for where, packed in zip(pdf["path"], pdf["content"]):
                name = where.rsplit("/", 1)[-1]
                refused = lambda why, day=None, file=None: pd.DataFrame([(name, day, file, None, None, None, why)], columns=columns)  # noqa: B023, E731
                year = re.search(r"(?<!\d)[12]\d{3}(?!\d)", name)
                if not year:
                    yield refused("year")
                    continue
                wanted = {day.strftime(member): day for day in days_of(int(year[0]))}
                try:
                    archive = zipfile.ZipFile(io.BytesIO(packed))
                except zipfile.BadZipFile:
                    yield refused("broken")
                    continue
                if fault := yearly_fault(archive.infolist(), list(wanted), most_bytes, most_ratio, most_total):
                    yield refused(fault)
                    continue
                for file, day in wanted.items():
                    try:
                        content = archive.read(file)
                        content.decode("utf-8")
                    except zipfile.BadZipFile:  # the check sum is wrong
                        yield refused("broken", day, file)
                    except UnicodeDecodeError:
                        yield refused("encoding", day, file)
                    else:
                        yield pd.DataFrame([(name, day, file, len(content), hashlib.sha256(content).hexdigest(), content, None)], columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, day date, member string, n_bytes long, sha256 string, content binary, fault string")


def daily_lines(members: DataFrame) -> DataFrame:
    """archive, day, line (from 0), value of the archives without any fault, blank lines left out."""
    bad = members.filter("fault is not null").select("archive").distinct()
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    good = members.join(bad, "archive", "left_anti").repartition("archive", "day")
    return good.select("archive", "day", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line", "value")).filter(F.trim("value") != "")


def boundary(feature: object, name: str) -> tuple[str | None, list | None, str | None]:
    """(zone, rings of (lon, lat), fault) of a GeoJSON feature; the rings of all its polygons, outer ones and holes alike."""
    if not isinstance(feature, dict) or feature.get("type") != "Feature":
        return None, None, "feature"
    zone, shape = (feature.get("properties") or {}).get(name), feature.get("geometry") or {}
    if not isinstance(zone, str) or not zone.strip():
        return None, None, "name"
    if shape.get("type") not in ("Polygon", "MultiPolygon"):
        return zone, None, "type"
    try:
        polygons = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
        rings = [[(float(corner[0]), float(corner[1])) for corner in ring] for polygon in polygons for ring in polygon]
    except (KeyError, IndexError, TypeError, ValueError):
        return zone, None, "coordinates"
    if not rings or any(len(ring) < 4 or ring[0] != ring[-1] for ring in rings):
        return zone, None, "ring"
    if not all(math.isfinite(x) and math.isfinite(y) and abs(x) <= 180 and abs(y) <= 90 for ring in rings for x, y in ring):
        return zone, None, "coordinates"
    return zone, rings, None


def read_boundaries(spark: SparkSession, path: str, name: str = "tzid", most_bytes: int = 1 << 30, most_ratio: float = 200.0) -> DataFrame:
    """archive, position, zone, rings, fault for each feature of the one GeoJSON file in each archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "position", "zone", "rings", "fault"]
        for pdf in batches:
            for where, packed in zip(pdf["path"], pdf["content"]):
                archive_name, features, fault = where.rsplit("/", 1)[-1], None, None
                try:
                    archive = zipfile.ZipFile(io.BytesIO(packed))
                    found = [n for n in archive.namelist() if n.lower().endswith((".json", ".geojson"))]
                    fault = archive_fault(archive.infolist(), most_bytes, most_ratio) or (None if len(found) == 1 else "no_member")
                    document = None if fault else json.loads(archive.read(found[0]))
                    features = document.get("features") if isinstance(document, dict) and document.get("type") == "FeatureCollection" else None
                except (zipfile.BadZipFile, ValueError):
                    fault = "broken"
                if not isinstance(features, list) or not features:
                    yield pd.DataFrame([(archive_name, None, None, None, fault or "collection")], columns=columns)
                    continue
                for i, feature in enumerate(features):
                    yield pd.DataFrame([(archive_name, i, *boundary(feature, name))], columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, position long, zone string, rings array<array<array<double>>>, fault string")


def zone_shapes(features: DataFrame) -> DataFrame:
    """zone, rings of the boundaries, as zones.located takes them. ValueError if one has a fault or a zone comes twice; of the corners none comes here."""
    assert_empty(features.filter("fault is not null").select("archive", "position", "zone", "fault"), "faulty boundaries")
    assert_empty(conflicts(features, ["zone"], ["position"]), "zones that come twice")
    return features.select("zone", "rings")


def places(rows: DataFrame) -> DataFrame:
    """Distinct normal records of places with n_rows, how often each came, and reject_reason.

    rows has icao, iata, name, country, lat and lon as text; blank codes are null, and a place needs one of the two.
    """
    icao, iata, country = (F.nullif(code(F.col(c)), F.lit("")).alias(c) for c in ("icao", "iata", "country"))
    name = F.nullif(F.trim(F.regexp_replace("name", r"\s+", " ")), F.lit("")).alias("name")
    lat, lon = (F.trim(F.col(c)).try_cast("double").alias(c) for c in ("lat", "lon"))
    plain = rows.select(icao, iata, name, country, lat, lon)
    fits = lambda c, pattern: F.col(c).isNull() | F.col(c).rlike(pattern)
    rules = [
        ("no_code", F.coalesce("icao", "iata").isNotNull()), ("icao", fits("icao", "^[A-Z0-9]{4}$")), ("iata", fits("iata", "^[A-Z]{3}$")),
        ("name", F.col("name").isNotNull()), ("country", F.col("country").rlike("^[A-Z]{2}$")), ("coordinates", F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)),
    ]
    return audited(plain.groupBy(*plain.columns).agg(F.count("*").alias("n_rows")), rules)


def place_index(checked: DataFrame) -> DataFrame:
    """The accepted places; ValueError if a code stands for two different ones."""
    good = checked.filter("reject_reason is null").drop("reject_reason")
    for key in ("icao", "iata"):
        assert_empty(conflicts(good.filter(F.col(key).isNotNull()), [key], ["name", "country", "lat", "lon"]), f"{key} codes of several places")
    return good
