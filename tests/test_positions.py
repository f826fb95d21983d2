"""Jitter and jumps of positions: trips, monotone distances, and the rejection of single fixes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from headway.operators import anomaly, prep, travel
from headway.plans import prepared
from headway.sources import fixes as src

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
#: Seconds and metres of one bus: 15 m/s with a halt of 20 s at 900 m, and 12.5 m/s on the last segment.
CLEAN = [(t, 15 * t if t <= 60 else 900 if t <= 80 else 900 + 15 * (t - 80) if t <= 120 else 1500 + 12.5 * (t - 120)) for t in range(0, 161, 10)]
TIMES = [33.333333, 53.333333, 33.333333, 40.0]


def landed(spark, rows):
    """(vehicle, seconds, metres), with the speed that the metres give, in the landed schema."""
    out, last = [], {}
    for i, (v, t, d) in enumerate(rows):
        t0, d0 = last.get(v, (t, d))
        speed = 3.6 * max(0.0, d - d0) / (t - t0) if t > t0 and 0 <= d - d0 <= 400 else 0.0
        last[v] = (t, d)
        out.append(("r", v, i, DAY + datetime.timedelta(seconds=t), float(speed), float(d)))
    return spark.createDataFrame(out, src.FIXES).withColumn("u", F.unix_micros("ts"))


@pytest.fixture
def line(spark):
    return spark.createDataFrame([("r", k, 500.0) for k in range(4)], src.SEGMENTS)


def times(spark, line, rows, clean):
    found = travel.travel_times(travel.segment_crossings(prepared.in_place(landed(spark, rows), clean), line))
    return {(r["vehicle_id"], r["trip"], r["seg_seq"]): r["x"] for r in found.collect()}


def changed(at, metres):
    return [(t, metres if t == at else d) for t, d in CLEAN]


@pytest.mark.parametrize("at, metres", [(None, 0), (70, 899), (70, 850), (100, 1199)])
def test_jitter_leaves_the_four_times(spark, line, at, metres):
    got = times(spark, line, [(1, t, d) for t, d in changed(at, metres)], None)
    assert got.keys() == {(1, 0, k) for k in range(4)}
    assert [got[1, 0, k] for k in range(4)] == pytest.approx(TIMES, abs=1)


def fleet():
    """Twenty buses in light jitter; the second trip of each begins at 0 after a layover."""
    rng = random.Random(3)
    return [(v, t + 1000 * trip, round(max(0.0, d + rng.gauss(0, 1.5)), 2)) for v in range(20) for trip in range(2) for t, d in CLEAN]


@pytest.mark.parametrize("score", [anomaly.by_reconstruction, anomaly.by_displacement])
@pytest.mark.parametrize("at, metres", [(50, 1990), (70, 0), (110, 200), (130, 9000)])
def test_a_jump_goes_and_the_times_stay(spark, line, score, at, metres):
    """One fix far ahead or behind, in one bus of many: it is the one rejected, no trip ends there, and its neighbours' times are the clean ones."""
    rows = fleet()
    k = next(i for i, (v, t, _) in enumerate(rows) if (v, t) == (3, at))
    clean = times(spark, line, rows, lambda m: m)
    rows[k] = (3, at, metres)
    least = 100.0 if score is anomaly.by_reconstruction else 40.0**2
    clear = lambda m: anomaly.reject_fixes(m, score, level=None, least=least)
    moved = travel.with_trips(landed(spark, rows))
    assert {r["trip"] for r in moved.filter("vehicle_id = 3").collect()} == {0, 1}
    gone = {r["fix_id"] for r in moved.collect()} - {r["fix_id"] for r in clear(moved).collect()}
    assert gone == {k}
    got = times(spark, line, rows, clear)
    assert got.keys() == clean.keys() and max(abs(got[key] - clean[key]) for key in clean) < 6
    assert all(got[key] == clean[key] for key in clean if key[0] != 3)


def test_one_bus_alone(spark, line):
    """The rejection learns from a single bus' 17 fixes too; the quantile of all scores doesn't take a clean fix."""
    rows = [(1, t, d) for t, d in CLEAN]
    got = times(spark, line, rows, anomaly.reject_fixes)
    assert [got[1, 0, k] for k in range(4)] == pytest.approx(TIMES, abs=1e-6)
    got = times(spark, line, [(1, t, d) for t, d in changed(50, 1990)], anomaly.reject_fixes)
    assert [got[1, 0, k] for k in range(4)] == pytest.approx(TIMES, abs=1)


def test_an_abnormal_speed_goes(spark):
    rows = landed(spark, fleet()).withColumn("speed_kmh", F.when(F.col("fix_id") == 40, 900.0).otherwise(F.col("speed_kmh")))
    moved = travel.with_trips(rows)
    kept = anomaly.reject_fixes(moved, level=None)
    assert {r["fix_id"] for r in moved.collect()} - {r["fix_id"] for r in kept.collect()} == {40}


def test_prepare_by_default_keeps_no_false_time(spark, line):
    rows = fleet()
    rows[next(i for i, (v, t, _) in enumerate(rows) if (v, t) == (3, 50))] = (3, 50, 1990)
    found = prepared.prepare(landed(spark, rows), line, 5, 0.99, prep.persistence_mse)
    assert all(r["p10"] > 25 for r in found.baseline.collect()) and found.samples.filter("x < 25").count() == 0


def test_trips(spark):
    """Two trips of two fixes, a change of route, a null distance, equal times, and no rows."""
    rows = [(1, 0, 0), (1, 10, 200), (1, 20, 0), (1, 30, 200), (2, 0, 900), (2, 0, 900), (2, 10, 890), (2, 20, 10)]
    got = travel.with_trips(landed(spark, rows)).orderBy("fix_id").collect()
    assert [r["trip"] for r in got] == [0, 0, 1, 1, 0, 0, 0, 1]
    other = landed(spark, rows[:2]).withColumn("route_id", F.concat(F.lit("r"), "fix_id"))
    assert [r["trip"] for r in travel.with_trips(other).orderBy("fix_id").collect()] == [0, 1]
    assert anomaly.reject_fixes(travel.with_trips(landed(spark, rows)).limit(0)).count() == 0
    assert travel.with_trips(landed(spark, rows).withColumn("dist_m", F.lit(None).cast("double"))).count() == 0
