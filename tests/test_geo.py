"""Great circles and map matching on hand-made lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from headway.operators import geo
from headway.sources import fixes as src


def test_haversine(spark):
    one = lambda *p: spark.range(1).select(geo.haversine(*map(F.lit, p))).first()[0]
    assert one(0.0, 0.0, 0.0, 90.0) == pytest.approx(math.pi / 2 * geo.EARTH_M)
    assert one(37.5, 127.0, 37.5, 127.0) == 0.0
    assert one(-30.0, 179.9, -30.0, -179.9) == pytest.approx(0.2 * math.pi / 180 * math.cos(math.radians(30)) * geo.EARTH_M, rel=1e-5)
    assert one(90.0, 0.0, -90.0, 50.0) == pytest.approx(math.pi * geo.EARTH_M)


#: A line with a long piece, a short one, a doubled point and a sharp turn.
LINE = [(37.50, 127.00), (37.50, 127.02), (37.5002, 127.0201), (37.5002, 127.0201), (37.49, 127.03), (37.4905, 127.01)]


def shapes(spark, points=LINE):
    return spark.createDataFrame([("r", k, *p) for k, p in enumerate(points)], src.SHAPES)


def test_distance_along_the_line_is_within_a_metre(spark):
    """Places at known distances, up to 30 m to the side of pieces whose neighbours are farther away; and places nowhere near."""
    rng, rows, want = random.Random(2), [], {}
    pieces = geo.edges(shapes(spark)).orderBy("start_m").collect()
    assert [round(p["start_m"]) for p in pieces][:2] == [0, round(2 * math.pi * geo.EARTH_M / 360 * 0.02 * math.cos(math.radians(37.5)))] and len(pieces) == 4
    for k, p in enumerate([pieces[0], pieces[2], pieces[3]]):
        for _ in range(60):
            t, side = rng.uniform(0.1, 0.9), rng.uniform(-30, 30)
            squeeze = math.cos(math.radians(p["lat"]))
            dx, dy = (p["to_lon"] - p["lon"]) * squeeze, p["to_lat"] - p["lat"]
            n = math.hypot(dx, dy)
            off = side / geo.EARTH_M * 180 / math.pi
            i = len(rows)
            rows.append(("r", 1, i, None, 1.0, p["lat"] + t * dy + off * dx / n, p["lon"] + (t * dx - off * dy / n) / squeeze))
            want[i] = (p["start_m"] + t * p["length_m"], abs(side))
    far = [("r", 1, 9001, None, 1.0, 37.6, 127.0), ("r", 1, 9002, None, 1.0, None, 127.0), ("none", 1, 9003, None, 1.0, 37.5, 127.0), ("r", 1, 9004, None, 1.0, float("nan"), 127.0), ("r", 1, 9005, None, 1.0, 37.4991, 127.005)]
    frame = spark.createDataFrame(rows + far, src.GPS).withColumn("dist_m", F.lit("old"))
    got = {r["fix_id"]: (r["dist_m"], r["off_m"]) for r in geo.match(frame, shapes(spark)).collect()}
    assert got.keys() == want.keys()
    for i, (d, off) in want.items():
        assert got[i][0] == pytest.approx(d, abs=1) and got[i][1] == pytest.approx(off, abs=0.5)


def test_matching_is_row_by_row_and_finds_all_that_a_search_finds(spark):
    rng = random.Random(5)
    rows = [("r", 1, i, None, 1.0, rng.uniform(37.488, 37.502), rng.uniform(126.999, 127.031)) for i in range(3000)]
    frame = spark.createDataFrame(rows, src.GPS)
    found = geo.match(frame, shapes(spark))
    got = {r["fix_id"]: r["off_m"] for r in found.collect()}
    wide = {r["fix_id"]: r["off_m"] for r in geo.match(frame, shapes(spark), cell=1.0).collect()}
    assert got == wide and 100 < len(got) < 3000
    assert "BatchEvalPython" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def test_streams_and_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([("r", 1, 1, None, 1.0, 37.5, 127.001)], src.GPS)
    frame.write.parquet(f"{tmp_path}/gps")
    shapes(spark).write.parquet(f"{tmp_path}/shapes")
    lines = src.read_shapes(spark, f"{tmp_path}/shapes")
    assert geo.match(src.read_gps(spark, f"{tmp_path}/gps", streaming=True), lines).isStreaming
    assert geo.match(src.read_gps(spark, f"{tmp_path}/gps"), lines).count() == 1
    assert geo.match(frame.limit(0), lines).count() == 0 and geo.match(frame, lines.limit(1)).count() == 0
