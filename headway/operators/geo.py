"""Positions on the earth to distances along a route: great circles, and map matching by grid cells.

Everything is built from Spark's own functions, row by row where positions are
concerned, so a stream of positions may be matched too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH_M = 6_371_008.8
#: Side of a grid cell in degrees, about 200 m from south to north.
CELL = 0.002
#: A position farther from its route than so many metres is not on it.
REACH_M = 60.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places, along a great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    up, across = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(up * up + F.cos(a) * F.cos(b) * across * across)))


def edges(shapes: DataFrame) -> DataFrame:
    """(route_id, pt_seq, lat, lon, to_lat, to_lon, start_m, length_m): the pieces of each route's line (route_id, pt_seq, lat, lon) between points that differ, with how far along the line they begin."""
    w = Window.partitionBy("route_id").orderBy("pt_seq")
    rows = shapes.filter("lat is not null and lon is not null").withColumns({"to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w)}).filter("to_lat is not null")
    rows = rows.withColumn("length_m", haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))).filter("length_m > 0")
    return rows.withColumn("start_m", F.coalesce(F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("route_id", "pt_seq", "lat", "lon", "to_lat", "to_lon", "start_m", "length_m")


def cell_of(degrees: Column, cell: float) -> Column:
    return F.floor(degrees / cell)


def cells(lines: DataFrame, cell: float = CELL, reach_m: float = REACH_M) -> DataFrame:
    """(route_id, _y, _x, near): for each grid cell that a route (edges) comes within reach of, the pieces that do.

    A piece is listed in the cells of its box, widened by the reach; long ones
    are cut first, so the box of a slanting line doesn't fill.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("to_lat") - F.col("lat")), F.abs(F.col("to_lon") - F.col("lon"))) / cell)).cast("int")
    rows = lines.withColumn("_of", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    between = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_of")
    for name, a, b in (("lat", "lat", "to_lat"), ("lon", "lon", "to_lon")):
        rows = rows.withColumns({f"_{name}0": F.least(between(a, b, F.col("_k")), between(a, b, F.col("_k") + 1)), f"_{name}1": F.greatest(between(a, b, F.col("_k")), between(a, b, F.col("_k") + 1))})
    up = reach_m / EARTH_M * 57.29577951308232
    across = up / F.greatest(F.cos(F.radians(F.greatest(F.abs("_lat0"), F.abs("_lat1")))), F.lit(0.01))
    rows = rows.withColumn("_y", F.explode(F.sequence(cell_of(F.col("_lat0") - up, cell), cell_of(F.col("_lat1") + up, cell))))
    rows = rows.withColumn("_x", F.explode(F.sequence(cell_of(F.col("_lon0") - across, cell), cell_of(F.col("_lon1") + across, cell))))
    piece = F.struct("start_m", "length_m", "lat", "lon", "to_lat", "to_lon")
    return rows.groupBy("route_id", "_y", "_x").agg(F.sort_array(F.collect_set(piece)).alias("near"))


def match(fixes: DataFrame, shapes: DataFrame, cell: float = CELL, reach_m: float = REACH_M) -> DataFrame:
    """fixes (route_id, lat, lon and more) with `dist_m`, how far along its route's line the nearest place is, and `off_m`, how far away that is.

    Positions that are unknown, of routes without a line, or farther off than
    the reach go; where a line passes the same place twice the earlier pass
    counts.  Columns of these two names are replaced.
    """
    grid = cells(edges(shapes), cell, reach_m)
    rows = fixes.drop("dist_m", "off_m").filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    rows = rows.withColumns({"_y": cell_of(F.col("lat"), cell), "_x": cell_of(F.col("lon"), cell)}).join(grid, ["route_id", "_y", "_x"])
    per_degree = EARTH_M / 57.29577951308232

    def place(e: Column) -> Column:
        """The nearest place of a piece, on the plane that touches the earth there."""
        squeeze = F.cos(F.radians(e["lat"]))
        bx, by = (e["to_lon"] - e["lon"]) * squeeze, e["to_lat"] - e["lat"]
        px, py = (F.col("lon") - e["lon"]) * squeeze, F.col("lat") - e["lat"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / (bx * bx + by * by)))
        off = F.sqrt(F.pow(px - t * bx, F.lit(2)) + F.pow(py - t * by, F.lit(2))) * per_degree
        return F.struct(F.round(off, 3).alias("off_m"), (e["start_m"] + t * e["length_m"]).alias("dist_m"))

    rows = rows.withColumn("_at", F.array_min(F.transform("near", place)))
    return rows.withColumns({"dist_m": F.col("_at.dist_m"), "off_m": F.col("_at.off_m")}).filter(F.col("off_m") <= reach_m).drop("_y", "_x", "near", "_at")
