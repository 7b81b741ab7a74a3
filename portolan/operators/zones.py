"""Which zone holds a point, for any number of zones, corners and points.

Zones are rings of corners. A grid is laid over them: cells that an edge touches are border cells of its zone, and of the others
those whose centre lies inside are inner ones, told by the crossings of one line through each row of cells. A point
meets its cell by an equi-join. In an inner cell it is in the zone; only in a border cell it is tested exactly, against the
edges of that zone which reach the point's narrow band of latitudes, again by an equi-join. No task holds all corners,
and none of them come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.geo import destination
from portolan.operators.running import settled

#: How far a cell's cover reaches beyond an edge, in degrees, so that rounding leaves no border cell out.
MARGIN = 1e-9


def edges(zones: DataFrame) -> DataFrame:
    """zone, x1, y1, x2, y2 for each side of each ring of (zone, rings of (x, y)); open rings are closed."""
    ring = zones.select("zone", F.explode("rings").alias("ring"))
    ends = F.concat("ring", F.slice("ring", 1, 1))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(F.element_at(ends, i).alias("a"), F.element_at(ends, i + 1).alias("b")))
    sides = ring.filter(F.size("ring") > 0).select("zone", F.explode(pairs).alias("s"))
    x = lambda end, i: F.get(F.col(f"s.{end}"), F.lit(i))
    return sides.select("zone", x("a", 0).alias("x1"), x("a", 1).alias("y1"), x("b", 0).alias("x2"), x("b", 1).alias("y2")).filter("x1 <> x2 or y1 <> y2")


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def crossing(y: Column) -> Column:
    """Where an edge crosses the horizontal through y, and null where it does not: of an edge's ends the upper one is not its own."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when((y1 > y) != (y2 > y), (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def cover(sides: DataFrame, size: float) -> DataFrame:
    """zone, cx, cy, inner: the cells of a grid that a zone's edges touch (inner is false), and those that lie in it whole."""
    columns = sides.withColumn("cx", F.explode(_cells(F.least("x1", "x2") - MARGIN, F.greatest("x1", "x2") + MARGIN, size)))
    # the part of the edge within the column
    at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (F.greatest(F.least(x, F.greatest("x1", "x2")), F.least("x1", "x2")) - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    left, right = F.coalesce(at(F.col("cx") * size - MARGIN), F.col("y1")), F.coalesce(at((F.col("cx") + 1) * size + MARGIN), F.col("y2"))
    border = columns.select("zone", "cx", F.explode(_cells(F.least(left, right) - MARGIN, F.greatest(left, right) + MARGIN, size)).alias("cy")).distinct()
    rows = sides.withColumn("cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    crossed = rows.withColumn("x", crossing((F.col("cy") + 0.5) * size)).filter("x is not null")
    along = Window.partitionBy("zone", "cy").orderBy("x")
    spans = crossed.select("zone", "cy", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("nth")).filter("nth % 2 = 1 and to is not null")
    first, last = F.ceil(F.col("x") / size - 0.5).cast("long"), F.floor(F.col("to") / size - 0.5).cast("long")  # cells whose centre is between
    inner = spans.filter(first <= last).select("zone", F.explode(F.sequence(first, last)).alias("cx"), "cy").distinct().join(border, ["zone", "cx", "cy"], "left_anti")
    return border.withColumn("inner", F.lit(False)).unionByName(inner.withColumn("inner", F.lit(True)))


def holding(points: DataFrame, zones: DataFrame, size: float, band: float, broadcast_rows: int = 500_000) -> DataFrame:
    """x, y, n_zones, zone (the first by name) for each distinct point (x, y); a zone holds what lies in an odd number of its rings or on an edge."""
    sides = settled(edges(zones), "zone-edges")
    cells = settled(cover(sides, size), "zone-cells")
    bands = sides.withColumn("band_", F.explode(_cells(F.least("y1", "y2") - MARGIN, F.greatest("y1", "y2") + MARGIN, band)))
    small = F.broadcast if cells.count() <= broadcast_rows else (lambda df: df)
    at = points.select("x", "y").distinct().withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    met = at.join(small(cells), ["cx", "cy"])
    tested = met.filter("not inner").select("x", "y", "zone", F.floor(F.col("y") / band).cast("long").alias("band_")).join(bands, ["zone", "band_"])
    x, y = F.col("x"), F.col("y")
    turn = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    on = (F.abs(turn) < 1e-12) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    exact = tested.groupBy("x", "y", "zone").agg(F.sum(F.coalesce(x < crossing(y), F.lit(False)).cast("long")).alias("right_"), F.max(on).alias("on_")).filter("on_ or right_ % 2 = 1")
    return met.filter("inner").select("x", "y", "zone").unionByName(exact.select("x", "y", "zone")).groupBy("x", "y").agg(F.count("*").alias("n_zones"), F.min("zone").alias("zone"))


def located(points: DataFrame, zones: DataFrame, lat: str, lon: str, guard_km: float = 1.0, bearings: int = 8, size: float = 1.0, band: float = 0.0625) -> DataFrame:
    """points with zone and disposition, by zones (zone, rings of (lon, lat)) each of which comes once.

    `resolved` if the point and all guards on a ring around it lie in one and the same zone; `near_border` if only the point
    does; `overlap` if several hold it, `outside` if none does, `invalid` without finite coordinates. Edges belong to their zones. Repeated
    points are looked up once. No zones at all leave every point outside; an empty table gives an empty result.
    """
    asked = points.select(F.col(lat).cast("double").alias("a_"), F.col(lon).cast("double").alias("o_")).distinct()
    asked = asked.filter("a_ between -90 and 90 and o_ between -180 and 180")  # NaN is above all numbers
    probes = [F.struct(F.col("o_").alias("x"), F.col("a_").alias("y"), F.lit(True).alias("home"))]
    for k in range(bearings):
        y, x = destination(F.col("a_"), F.col("o_"), F.lit(360.0 * k / bearings), F.lit(float(guard_km)))
        probes.append(F.struct(x.alias("x"), y.alias("y"), F.lit(False).alias("home")))
    probes = asked.select("a_", "o_", F.explode(F.array(*probes)).alias("p")).select("a_", "o_", "p.*")
    found = probes.join(holding(probes, zones, size, band), ["x", "y"], "left")
    home = F.max(F.when(F.col("home"), F.col("zone")))
    told = found.groupBy("a_", "o_").agg(
        home.alias("zone_"), F.max(F.when(F.col("home"), F.coalesce("n_zones", F.lit(0)))).alias("n_"),
        F.min(F.coalesce("n_zones", F.lit(0))).alias("least_"), F.max(F.coalesce("n_zones", F.lit(0))).alias("most_"), F.min("zone").alias("first_"), F.max("zone").alias("last_"),
    )
    one = (F.col("n_") == 1) & (F.col("least_") == 1) & (F.col("most_") == 1) & (F.col("first_") == F.col("last_"))
    fate = F.when(F.col("n_") == 0, "outside").when(F.col("n_") > 1, "overlap").when(one, "resolved").otherwise("near_border")
    told = told.select(F.col("a_"), F.col("o_"), F.when(one, F.col("zone_")).alias("zone"), fate.alias("disposition"))
    joined = points.join(told, (F.col(lat).cast("double") == F.col("a_")) & (F.col(lon).cast("double") == F.col("o_")), "left").drop("a_", "o_")
    return joined.withColumn("disposition", F.coalesce("disposition", F.lit("invalid")))
