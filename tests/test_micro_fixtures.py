"""Hand-computed cases for each transit operator."""

import pytest
from pyspark.sql import functions as F

from headway.functions import scalars
from headway.operators import delay, prep, quantiles, recovery, safezone, stops, travel
from headway.plans import prepared
from headway.sources import fixes as src


def fixes(spark, rows):
    """(seconds, speed, distance) of vehicle 1."""
    return spark.createDataFrame([(1, i, t * 1_000_000, float(v) if v is not None else None, d) for i, (t, v, d) in enumerate(rows)], "vehicle_id long, fix_id long, u long, speed_kmh double, dist_c long")


def test_hysteresis_and_episode(spark):
    speeds = [12, 6, 4, 7, 9, 11, 6]
    states = stops.stop_state(fixes(spark, [(5 * i, v, 0) for i, v in enumerate(speeds)]))
    assert [r["stopped"] for r in states.orderBy("u").collect()] == [0, 0, 1, 1, 1, 0, 0]
    (e,) = stops.stop_episodes(states).collect()
    assert (e["enter_u"], e["exit_u"], e["dwell_s"], e["n_fixes"], e["enter_fix_id"]) == (10_000_000, 25_000_000, 15.0, 3, 2)


def test_null_speed_keeps_the_state_and_data_may_end_in_a_stop(spark):
    states = stops.stop_state(fixes(spark, [(0, None, 0), (5, 5.0, 0), (10, None, 0), (15, 10.0, 0), (20, 1, 0), (25, 2, 0)]))
    assert [r["stopped"] for r in states.orderBy("u").collect()] == [0, 1, 1, 0, 1, 1]
    assert sorted((r["enter_u"], r["dwell_s"]) for r in stops.stop_episodes(states).collect()) == [(5_000_000, 10.0), (20_000_000, 5.0)]


def test_hysteresis_equals_a_loop(spark):
    import random

    random.seed(3)
    speeds = [random.choice([None, 3, 5, 6, 8, 10, 12]) for _ in range(300)]
    state, want = 0, []
    for v in speeds:
        state = 1 if v is not None and v <= 5 else 0 if v is not None and v >= 10 else state
        want.append(state)
    got = stops.stop_state(fixes(spark, [(i, v, 0) for i, v in enumerate(speeds)])).orderBy("u").collect()
    assert [r["stopped"] for r in got] == want


def test_resample_and_crossing(spark):
    f = fixes(spark, [(0, 0, 0), (12, 0, 120)])
    got = prep.resample_linear(f, 5, "dist_c").orderBy("k").collect()
    assert [(r["k"] * 5, r["value"]) for r in got] == [(0, 0.0), (5, 50.0), (10, 100.0)]
    assert prep.resample_linear(f, 5, "dist_c", max_gap_s=10).count() == 0
    (c,) = prep.estimate_crossings(f, 80).collect()
    assert (c["boundary"], c["cross_s"]) == (1, 8.0)


def test_windows_and_persistence_error(spark):
    f = fixes(spark, [(i, v, 0) for i, v in enumerate([1, 2, 4, 7])])
    w = prep.persistence_mse(prep.sequence_windows(f, 3)).orderBy("u").collect()
    assert [(r["xs"], r["mse"]) for r in w] == [([1.0, 2.0, 4.0], 2.5), ([2.0, 4.0, 7.0], 6.5)]
    assert prep.sequence_windows(f, 2, stride=2).count() == 2


def test_ema(spark):
    rows = spark.createDataFrame([(1, i, i, x) for i, x in enumerate([50.0, 100.0, 0.0])], "vehicle_id long, fix_id long, u long, raw_pct double")
    assert [r["ema_pct"] for r in delay.ema(rows).orderBy("u").collect()] == [50.0, 60.0, 48.0]


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.2, 1.0])
def test_long_ema_equals_the_recursion(spark, alpha):
    """5,000 rows of a vehicle, and one of two rows; nulls keep the value."""
    xs = [float(i * 37 % 101) if i % 11 else None for i in range(5000)]
    y, want = None, []
    for x in xs:
        y = y if x is None else x if y is None else alpha * x + (1 - alpha) * y
        want.append(y)
    rows = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(xs)] + [(2, 0, 0, 3.0), (2, 1, 1, 4.0)], "vehicle_id long, fix_id long, u long, raw_pct double")
    got = [r["ema_pct"] for r in delay.ema(rows, alpha).orderBy("vehicle_id", "u").collect()]
    assert got[0] is None and got[1:5000] == pytest.approx(want[1:], abs=6e-7) and got[5000:] == pytest.approx([3.0, 3 + alpha], abs=6e-7)


def test_channel_edges(spark):
    rows = spark.createDataFrame([(11.9,), (12.0,), (86.0,), (86.1,)], "p double")
    assert [r[0] for r in rows.select(scalars.channel(F.col("p"))).collect()] == ["anomaly_low", "micro", "micro", "anomaly_high"]


def test_percentile_lookup(spark):
    live = spark.createDataFrame([("r", 1, x) for x in (-1.0, 37.5, 100.0, 0.0)], "route_id string, seg_seq int, x double")
    base = spark.createDataFrame([("r", 1, [float(i) for i in range(101)])], "route_id string, seg_seq int, q array<double>")
    got = {r["x"]: r["raw_pct"] for r in quantiles.raw_pct(live, base).collect()}
    assert got == {-1.0: 0.0, 37.5: 37.5, 100.0: 100.0, 0.0: 0.0}
    at = base.select(*[scalars.quantile_at(F.col("q"), F.lit(p)) for p in (0.0, 37.5, 100.0)]).first()
    assert tuple(at) == (0.0, 37.5, 100.0)


def test_unknown_values_have_no_percentile(spark):
    live = spark.createDataFrame([("r", 1, None), ("r", 1, float("nan"))], "route_id string, seg_seq int, x double")
    base = spark.createDataFrame([("r", 1, [float(i) for i in range(101)])], "route_id string, seg_seq int, q array<double>")
    rows = quantiles.raw_pct(live, base).select("raw_pct", scalars.channel(F.col("raw_pct")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(None, None)] * 2


def test_exact_quantiles_equal_percentile(spark):
    """Groups of one value, of many equal ones, of a null key, with nulls and NaN, and one much larger than the others."""
    import random

    random.seed(7)
    rows = [("one", 4.0), ("same", 2.0)] + [("same", 2.0)] * 50 + [(None, float(i * 7 % 31)) for i in range(200)] + [("none", None), ("nan", float("nan"))]
    rows += [("hot", random.choice([random.gauss(0, 9), 1.5, random.expovariate(0.1)])) for _ in range(5000)] + [("hot", None), ("hot", float("nan"))]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    levels = [0.0, 0.011, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(table, ("g",), "x", levels).collect()}
    usable = table.filter("x is not null and not isnan(x)")
    want = {r["g"]: (r["n"], r["q"]) for r in usable.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, levels))).alias("q")).collect()}
    assert got.keys() == want.keys() == {"one", "same", None, "hot"}
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], abs=1e-9)
    assert quantiles.exact_quantiles(table, (), "x", [0.5]).first()["q"][0] == pytest.approx(usable.agg(F.percentile("x", F.lit(0.5))).first()[0])
    assert quantiles.exact_quantiles(table.limit(0), ("g",), "x", [0.5]).count() == 0


def zone(spark, lo, hi):
    return spark.createDataFrame([("g", lo, hi)], "grp string, lo int, hi int")


def test_zone_intersection(spark):
    assert tuple(safezone.intersect_zones(zone(spark, 12, 86), zone(spark, 5, 95)).first()) == ("g", 12, 86)
    assert tuple(safezone.intersect_zones(zone(spark, 10, 20), zone(spark, 30, 40)).first()) == ("g", None, None)


def test_normal_sample_is_unbounded_and_a_kink_ends_the_zone(spark):
    from statistics import NormalDist

    n = NormalDist()
    xs = [n.inv_cdf((i + 0.5) / 2000) for i in range(2000)]
    rows = [("plain", x) for x in xs] + [("kink", x if x < 1.2 else 1.2 + 9 * (x - 1.2)) for x in xs]
    qq = safezone.qq_points(spark.createDataFrame(rows, "route_id string, x double"))
    got = {r["grp"]: (r["lo"], r["hi"]) for r in safezone.zone_inflection(qq).collect()}
    assert got["plain"] == (1, 99) and got["kink"][0] == 1 and 84 <= got["kink"][1] <= 90


def plan(spark, total_s, products, caps):
    rows = [(1, "r", 0, int(total_s * 1000), k, 100.0 - c, 100.0, float(w), 1.0) for k, (w, c) in enumerate(zip(products, caps), 1)]
    return spark.createDataFrame(rows, "vehicle_id long, route_id string, cur int, total_ms long, seg_seq int, p10 double, p50 double, p_stop double, mean_dwell_s double")


@pytest.mark.parametrize("weights, cap, want", [((1, 2, 3), None, [10, 20, 30]), ((0, 0, 0), None, [20, 20, 20]), ((1, 2, 3), "q50-q10", [10, 15, 15])])
def test_allocation(spark, weights, cap, want):
    got = recovery.allocate(plan(spark, 60, weights, (15, 15, 15)), cap=cap).orderBy("seg_seq").collect()
    assert [r["recovery"] for r in got] == want


def test_negative_delay_needs_no_recovery(spark):
    assert {r["recovery"] for r in recovery.allocate(plan(spark, -5, (1, 2), (9, 9))).collect()} == {0.0}


def test_propagation_and_eta(spark):
    p = plan(spark, 90, (1, 2, 3), (50, 50, 50)).withColumn("recovery", F.col("seg_seq") * 10.0)
    rows = recovery.eta(recovery.propagate(p)).orderBy("seg_seq").collect()
    assert [r["delay_after"] for r in rows] == [80.0, 60.0, 30.0]
    assert [r["eta_s"] for r in rows] == [90.0, 170.0, 240.0]


def test_eta_with_progress_and_pace(spark):
    """Half of the current segment is left; at the vehicle's percentile or at the median."""
    base = spark.createDataFrame([("r", k, 90.0, 100.0, [float(50 + i) for i in range(101)]) for k in range(3)], "route_id string, seg_seq int, p10 double, p50 double, q array<double>")
    stats = spark.createDataFrame([("r", 1, 1.0, 5.0)], "route_id string, seg_seq int, p_stop double, mean_dwell_s double")
    state = spark.createDataFrame([(1, "r", 0, 0, 0.5, 70.0), (2, "r", 2, 0, 0.5, 70.0), (3, "x", 0, 0, 0.5, 70.0), (4, "r", 0, 0, None, 70.0)], "vehicle_id long, route_id string, seg_seq int, total_ms long, progress double, ema_pct double")
    of = lambda pace: {(r["vehicle_id"], r["seg_seq"]): r["eta_s"] for r in recovery.eta(recovery.allocate(recovery.remaining(state, base, stats, pace))).collect()}
    assert of("median") == {(1, 1): 150.0, (1, 2): 250.0, (4, 1): 100.0, (4, 2): 200.0}
    assert of("ema") == {(1, 1): 180.0, (1, 2): 300.0, (4, 1): 120.0, (4, 2): 240.0}


def test_calibrated_zone_gates(spark):
    live = spark.createDataFrame([(1, i, i, r, float(p), float(p), float(p), [float(k) for k in range(101)]) for i, (r, p) in enumerate([("a", 30), ("a", 90), ("b", 30), ("c", 10)])], "vehicle_id long, fix_id long, u long, route_id string, x double, raw_pct double, ema_pct double, q array<double>")
    zones = spark.createDataFrame([("a", 40, 95), ("b", None, None)], "grp string, lo int, hi int")
    rows = delay.delays(delay.with_zone(live, zones), F.col("lo"), F.col("hi")).orderBy("u").collect()
    assert [(r["channel"], r["anomaly_step"], r["micro_step"]) for r in rows] == [("anomaly_low", -10_000, 0), ("micro", 0, 40_000), ("micro", 0, -20_000), ("anomaly_low", -2_000, 0)]


def landed(spark, rows):
    """(vehicle, seconds, speed, metres) in the landed schema, with u."""
    import datetime

    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    out = [("r", v, i, t0 + datetime.timedelta(seconds=t), float(s), None if d is None else float(d)) for i, (v, t, s, d) in enumerate(rows)]
    return spark.createDataFrame(out, src.FIXES).withColumn("u", F.unix_micros("ts"))


@pytest.fixture
def segments(spark):
    return spark.createDataFrame([("r", 0, 100.0), ("r", 1, 50.0), ("r", 2, 100.0)], src.SEGMENTS)


def test_landed_fixes_give_travel_times(spark, segments):
    """A trip of 10 m/s with a halt, and a second one that begins inside segment 0; by hand."""
    rows = [(1, 0, 36, 0), (1, 10, 36, 100), (1, 12, 36, 120), (1, 22, 0, 120), (1, 35, 36, 250)]
    rows += [(1, 100, 36, 40), (1, 120, 36, 240), (2, 0, 36, 90), (2, 5, 36, None), (2, 10, 36, 160)]
    moved = travel.with_trips(landed(spark, rows))
    assert [r["trip"] for r in moved.filter("vehicle_id = 1").orderBy("u").collect()] == [0, 0, 0, 0, 0, 1, 1]
    crossed = travel.segment_crossings(moved, segments)
    at = {(r["vehicle_id"], r["trip"], r["seg_seq"]): tuple(None if r[c] is None else (r[c] - 1704067200000000) / 1e6 for c in ("enter_u", "leave_u")) for r in crossed.collect()}
    assert at == {(1, 0, 0): (0, 10), (1, 0, 1): (10, 25), (1, 0, 2): (25, 35), (1, 1, 0): (None, 106), (1, 1, 1): (106, 111), (1, 1, 2): (111, None), (2, 0, 0): (None, 1.428571), (2, 0, 1): (1.428571, 8.571429), (2, 0, 2): (8.571429, None)}
    got = {(r["vehicle_id"], r["trip"], r["seg_seq"]): r["x"] for r in travel.travel_times(crossed).collect()}
    assert got == {(1, 0, 0): 10.0, (1, 0, 1): 15.0, (1, 0, 2): 10.0, (1, 1, 1): 5.0, (2, 0, 1): pytest.approx(7.142858)}
    here = {(r["vehicle_id"], r["fix_id"]): (r["seg_seq"], r["progress"]) for r in travel.with_progress(landed(spark, rows), segments).collect()}
    assert here[1, 0] == (0, 0.0) and here[1, 1] == (1, 0.0) and here[1, 2] == (1, 0.4) and here[1, 6] == (2, 0.9) and (1, 4) not in here
    (c,) = prep.estimate_crossings(moved.filter("vehicle_id = 2"), 100, "dist_m").collect()
    assert (c["boundary"], round(c["cross_s"] - 1704067200, 3)) == (1, 1.429)


@pytest.mark.parametrize("model", [False, True])
def test_five_stages_reach_a_baseline(spark, segments, model):
    """Vehicles at 10 m/s that halt at 120 m from second 12 to 32; one reports a wild speed in segment 2 and loses that travel time."""
    rows = []
    for v in range(12):
        for t in sorted([*range(0, 46, 5), 12, 32]):
            d = 10 * t if t <= 12 else 120 if t <= 32 else 120 + 10 * (t - 32)
            rows.append((v, t, 400 if (v, t) == (3, 35) else 0 if 12 < t <= 32 else 36, d))
    how = {} if model else {"score": prep.persistence_mse}
    found = prepared.prepare(landed(spark, rows), segments, 1, 0.99, clean=None, **how)
    samples = {(r["vehicle_id"], r["seg_seq"]): (r["x"], r["pct"]) for r in found.samples.collect()}
    want = {(v, k): ((10.0, 25.0, 10.0)[k], (0.0, 100.0, 0.0)[k]) for v in range(12) for k in range(3) if (v, k) != (3, 2)}
    assert samples == want
    assert {r["seg_seq"]: (r["n"], r["p10"], r["p50"], r["p90"]) for r in found.baseline.collect()} == {0: (12, 10.0, 10.0, 10.0), 1: (12, 25.0, 25.0, 25.0), 2: (11, 10.0, 10.0, 10.0)}
    # The speed is at most 5 km/h from second 15 on and at least 10 at second 33.
    assert {r["seg_seq"]: (r["n_traversals"], r["p_stop"], r["mean_dwell_s"]) for r in found.stats.collect()} == {0: (12, 0.0, 0.0), 1: (12, 1.0, 18.0), 2: (11, 0.0, 0.0)}


def test_persistence_error_equals_that_of_the_windows(spark):
    """To the last bit, with nulls, NaN, equal times, and vehicles of fewer values than a window."""
    import random

    rng = random.Random(4)
    draw = lambda: rng.choice([None, float("nan"), 0.0, *[rng.expovariate(0.02)] * 40])
    rows = [(v, i, i // 2, draw()) for v in range(9) for i in range(v * 6)]
    series = spark.createDataFrame(rows, "vehicle_id long, fix_id long, u long, speed_kmh double").repartition(3)
    known = lambda found: sorted((r["vehicle_id"], r["fix_id"], repr(r["mse"])) for r in found.collect() if r["mse"] is not None)
    found = prep.persistence_error(series)
    assert known(found) == known(prep.persistence_mse(prep.sequence_windows(series))) != []
    assert known(found) == known(prep.persistence_mse(prep.sequence_windows(series, short=True)))
    assert found.count() == len(rows)


def test_quantiles_of_stored_rows_are_the_same(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.0, -0.0, 7.0, -1e300, *[round(rng.gauss(0, 90), 1)] * 60])) for _ in range(3000)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for keys, levels in (((), [0.99]), (("g",), [0.0, 0.37, 0.5, 1.0])):
        of = lambda stored: sorted(map(repr, quantiles.exact_quantiles(table, keys, "x", levels, stored=stored).collect()))  # noqa: E731, B023
        assert of(True) == of(False) != []


def test_series_without_a_window_lose_no_point(spark, segments):
    """No error, no cut: every point of the grid and every travel time stays."""
    rows = [(v, t, 36, 10 * t) for v in range(3) for t in range(0, 12, 2)]
    found = prepared.prepare(landed(spark, rows), segments, 1, 0.99, prep.persistence_error, clean=None)
    assert sorted((r["vehicle_id"], r["dist_m"]) for r in found.grid.collect()) == [(v, 10.0 * t) for v in range(3) for t in range(10)]
    assert [(r["seg_seq"], r["n"]) for r in found.baseline.collect()] == [(0, 3)]


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, name, other=None):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        src.scratch(Session())


def test_stop_statistics(spark):
    t = spark.createDataFrame([("r", 1, 1, i) for i in range(4)] + [("r", 2, 1, 9)], "route_id string, seg_seq int, vehicle_id long, fix_id long")
    e = spark.createDataFrame([(1, 0, 10.0), (1, 2, 30.0)], "vehicle_id long, enter_fix_id long, dwell_s double")
    got = {r["seg_seq"]: (r["n_traversals"], r["p_stop"], r["mean_dwell_s"]) for r in stops.segment_stop_stats(t, e).collect()}
    assert got == {1: (4, 0.5, 20.0), 2: (1, 0.0, 0.0)}


def test_grid_holds_the_published_pair_and_orders_ties(spark):
    f = fixes(spark, [(60 * i, [20, 4, 4, 7, 12, 3][i % 6], 0) for i in range(60)])
    got = stops.grid_search(f, [5.0, 20.0], [10.0], 30, 120).collect()
    assert [(r["enter"], r["exit"]) for r in got] == [(5.0, 10.0)]
    assert got[0]["score"] == pytest.approx(got[0]["long_share"] - got[0]["short_share"])


def test_landed_files_round_trip(spark, tmp_path):
    import datetime

    rows = [("r", 1, 1, datetime.datetime(2024, 1, 1), 3.0, 4.0)]
    spark.createDataFrame(rows, src.FIXES).write.parquet(f"{tmp_path}/fixes")
    spark.createDataFrame([("r", 1, 10.0)], src.SEGMENTS).write.parquet(f"{tmp_path}/segments")
    assert src.read_fixes(spark, f"{tmp_path}/fixes").first()["u"] == 1704067200000000
    assert src.read_fixes(spark, f"{tmp_path}/fixes", streaming=True).isStreaming
    assert src.read_segments(spark, f"{tmp_path}/segments").count() == 1
    assert src.for_route(src.read_fixes(spark, f"{tmp_path}/fixes"), "x").count() == 0
