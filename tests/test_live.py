"""Landed fixes through both streams against their batch twin: order, lateness, jumps, expiry, initial state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from headway.operators import delay, recovery, stops, travel
from headway.plans import live
from headway.sources import fixes as src
from headway.streaming import agent, traversal

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
LENGTHS = [500.0, 700.0, 400.0, 600.0]
STATE = ["vehicle_id", "route_id", "seg_seq", "progress", "stopped", "now_u", "now_pct", "pending_ms", "ema_pct", "anomaly_ms", "micro_ms"]


def buses(seed, n, hours=1.0):
    """(vehicle, second, speed, metres): buses of different pace that halt, wait, roll back a little and begin new trips; reports about every 15 seconds."""
    rng, out = random.Random(seed), []
    for v in range(n):
        t, d, wait, pace = rng.randint(0, 300), 0.0, 0, rng.uniform(5, 14)
        while t < hours * 3600:
            step = rng.randint(8, 22)
            moving = wait <= 0
            out.append((v, t, pace * 3.6 if moving else 0.0, round(d + rng.uniform(-2, 2) * (d > 5), 2)))
            t += step
            wait -= step
            if moving:
                d += pace * step
                if rng.random() < 0.08:
                    wait = rng.choice([20, 40, 300])
            if d > sum(LENGTHS):
                d, pace = 0.0, rng.uniform(5, 14)
    return out


def landed(spark, rows, first=0):
    out = [("r", v, first + i, DAY + datetime.timedelta(seconds=t), float(s), None if d is None else float(d)) for i, (v, t, s, d) in enumerate(rows)]
    return spark.createDataFrame(out, src.FIXES)


def land(spark, place, frame):
    frame.coalesce(1).write.mode("append").parquet(place)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Every micro-batch starts a Python worker for each partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([("r", k, m) for k, m in enumerate(LENGTHS)], src.SEGMENTS)


@pytest.fixture(scope="module")
def baseline(spark, segments):
    from headway.operators import quantiles

    past = landed(spark, buses(1, 30)).withColumn("u", F.unix_micros("ts"))
    moved = travel.monotone(travel.with_trips(past))
    return src.table(quantiles.segment_baseline(travel.travel_times(travel.segment_crossings(moved, segments))), "baseline")


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame([("r", k, 0.5, 10.0 * k) for k in range(4)], "route_id string, seg_seq int, p_stop double, mean_dwell_s double")


#: A fix of another vehicle so late that all others are folded to their end.
FLUSH = [(99, 3600 * 30, 0.0, 1.0)]


def compare(spark, run, twin):
    last = {}
    for r in spark.read.schema(f"{agent.OUT}, batch bigint").parquet(run).orderBy("batch").collect():
        last[r["vehicle_id"]] = r
    got = {v: tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in STATE)) for v, r in last.items() if v != 99}
    want = {r["vehicle_id"]: tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in STATE)) for r in twin.collect() if r["vehicle_id"] != 99}
    inside = {v for v, r in want.items() if r[5] is not None}
    assert inside and {v: got[v] for v in inside} == {v: want[v] for v in inside}
    ended = lambda r: (r[1], r[2], r[8], r[9], r[10])
    assert {v: ended(r) for v, r in got.items()} == {v: ended(r) for v, r in want.items()}
    return want


def test_streams_equal_their_batch_twin(spark, tmp_path, segments, baseline, stats):
    """Two landings, out of order by up to ten minutes, with jumps, nulls, an unknown route and reports that come too late."""
    place, rows = str(tmp_path), buses(2, 12)
    rng = random.Random(4)
    for i in rng.sample(range(len(rows)), 12):
        v, t, s, d = rows[i]
        rows[i] = (v, t, s, d + rng.choice([4000, 9000]))
    rows += [(3, 1000, 5.0, None)]
    frame = landed(spark, rows)
    frame = frame.withColumn("speed_kmh", F.when(F.col("fix_id") % 13 == 0, None).otherwise(F.col("speed_kmh")))
    shuffled = sorted(frame.collect(), key=lambda r: r["ts"] + datetime.timedelta(seconds=rng.randint(0, 550)))
    cuts = [0, len(shuffled) // 2, len(shuffled)]
    run = live.Live(f"{place}/run")
    for a, b in zip(cuts, cuts[1:]):
        land(spark, f"{place}/in", spark.createDataFrame(shuffled[a:b] + [("nowhere", 5, 10**6, shuffled[a]["ts"], 1.0, 1.0)], src.FIXES))
        live.run(spark, f"{place}/in", segments, baseline, stats, run, max_files=1)
    late = landed(spark, [(v, 30, 1.0, 1999.0) for v in range(4)], 10**7)
    land(spark, f"{place}/in", late)
    query = live.run(spark, f"{place}/in", segments, baseline, stats, run, max_files=1)
    assert traversal.dropped(query) == 4
    land(spark, f"{place}/in", landed(spark, FLUSH, 10**8))
    live.run(spark, f"{place}/in", segments, baseline, stats, run, max_files=1)
    states = agent.agent_stream(live.read_traversals(spark, run, streaming=True), baseline)
    agent.run(states, agent.landing(f"{place}/states"), f"{place}/cp")
    whole = frame.withColumn("u", F.unix_micros("ts"))
    want = compare(spark, f"{place}/states", live.landed_state(whole, segments, baseline))
    assert sum(r[9] for r in want.values()) > 0 and any(r[7] for r in want.values())

    # What was published last is what the twin's states give.
    seen = {}
    for r in spark.read.parquet(run.arrivals).orderBy("batch").collect():
        seen.setdefault((r["vehicle_id"], r["batch"]), {})[r["seg_seq"]] = round(r["eta_s"], 4)
    twin = live.landed_state(whole, segments, baseline).withColumn("total_ms", F.col("anomaly_ms") + F.col("micro_ms") + F.col("pending_ms"))
    arrive = {}
    for r in recovery.eta(recovery.allocate(recovery.remaining(twin.filter("now_u is not null"), baseline, stats))).collect():
        arrive.setdefault(r["vehicle_id"], {})[r["seg_seq"]] = round(r["eta_s"], 4)
    final = {v: seen[v, max(b for w, b in seen if w == v)] for v in arrive}
    assert final == arrive


def test_a_long_wait_shows_before_the_segment_ends(spark, tmp_path, segments, baseline, stats):
    """A bus that stands in its second segment: its percentile and pending delay grow while its sums don't, and it stands."""
    rows = [(1, t, 30.0 if t < 80 else 0.0, min(8.0 * t, 640.0)) for t in range(0, 1200, 20)]
    place, run = str(tmp_path), live.Live(f"{tmp_path}/run")
    for part in (rows, [(1, 1400, 0.0, 640.0)], FLUSH):
        land(spark, f"{place}/in", landed(spark, part, part[0][1]))
        live.run(spark, f"{place}/in", segments, baseline, stats, run)
    found = [r for r in live.read_traversals(spark, run).orderBy("u").collect() if r["vehicle_id"] == 1]
    assert [r["seg_seq"] for r in found if r["kind"] == "whole"] == [0]
    waited = [r for r in found if r["kind"] == "now"]
    assert [r["x"] for r in waited][-1] == 1400 - 62.5 and all(r["stopped"] == 1 and r["seg_seq"] == 1 for r in waited)
    agent.run(agent.agent_stream(live.read_traversals(spark, run, streaming=True), baseline), agent.landing(f"{place}/states"), f"{place}/cp")
    (state,) = spark.read.parquet(f"{place}/states").filter("vehicle_id = 1").collect()
    assert state["now_pct"] == 100.0 and state["pending_ms"] > 100_000


def test_a_parked_vehicle_is_forgotten(spark, tmp_path, segments):
    """Hours later its state is gone: a new report begins at trip 0 again."""
    place = str(tmp_path)
    for i, part in enumerate(([(1, t, 30.0, 8.0 * t) for t in range(0, 100, 20)], FLUSH, [(1, 3600 * 31, 30.0, 50.0), (1, 3600 * 31 + 20, 30.0, 210.0)], [(99, 3600 * 60, 0.0, 1.0)])):
        land(spark, f"{place}/in", landed(spark, part, 1000 * i))
        agent.run(traversal.traversals(src.read_fixes(spark, f"{place}/in", streaming=True), segments), agent.landing(f"{place}/out"), f"{place}/cp")
    rows = spark.read.parquet(f"{place}/out").filter("vehicle_id = 1 and kind = 'now'").orderBy("u").collect()
    assert [(r["trip"], r["x"]) for r in rows][-1] == (0, None) and {r["trip"] for r in rows} == {0}
    store = spark.read.format("statestore").option("stateVarName", "trip").load(f"{place}/cp")
    assert {r["key"][0] for r in store.select("key").collect()} <= {99}


def test_the_stream_goes_on_from_the_batch_twins_state(spark, tmp_path):
    """The agent over days n + 1 from the state of days 1 to n equals the agent over all days."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", agent.PROVIDER)
    base = spark.createDataFrame([("r", s, [float(i) / 2 + s for i in range(101)]) for s in range(4)], "route_id string, seg_seq int, q array<double>")
    rows = [(i % 3, i, DAY + datetime.timedelta(seconds=30 * i), int(1e6) * (30 * i + 1), "r", i % 4, float(i * 37 % 53), float(i * 5 % 17)) for i in range(90)]
    shape = "vehicle_id long, fix_id long, ts timestamp, u long, route_id string, seg_seq int, x double, speed_kmh double"
    from headway.operators import quantiles

    def batch(some):
        done = stops.stop_state(delay.delays(delay.ema(quantiles.raw_pct(spark.createDataFrame(some, shape), base))))
        return delay.latest(done.select("vehicle_id", "u", "fix_id", "route_id", "seg_seq", "stopped", "ema_pct", "anomaly_ms", "micro_ms"))

    spark.createDataFrame(rows[60:], shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    states = agent.agent_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), base, initial=batch(rows[:60]))
    agent.run(states, agent.landing(f"{tmp_path}/out"), f"{tmp_path}/cp")
    cols = ["vehicle_id", "u", "seg_seq", "stopped", F.round("ema_pct", 5).alias("e"), "anomaly_ms", "micro_ms"]
    got, want = (sorted(map(tuple, rows.select(cols).collect())) for rows in (spark.read.parquet(f"{tmp_path}/out"), batch(rows)))
    assert got == want


def test_vehicles_of_one_bucket_share_a_key_and_nothing_else(spark, tmp_path, segments):
    """A bus, another of its bucket that is parked and forgotten, and one of the next bucket; the state has a key for each bucket."""
    from headway.streaming.buckets import BUCKETS

    place, other = str(tmp_path), 1 + BUCKETS
    parts = [
        [(v, t, 30.0, (8.0 + v % 3) * t) for v in (1, 2, other) for t in range(0, 200, 20)],
        [(v, 3600 * 30 + t, 30.0, 8.0 * t) for v in (1, 2) for t in range(0, 200, 20)],
        [(v, 3600 * 30 + 1200, 0.0, 1900.0) for v in (1, 2)],
    ]
    for i, part in enumerate(parts):
        land(spark, f"{place}/in", landed(spark, part, 1000 * i))
        agent.run(traversal.traversals(src.read_fixes(spark, f"{place}/in", streaming=True), segments), agent.landing(f"{place}/out"), f"{place}/cp")
    rows = spark.read.parquet(f"{place}/out").filter("kind = 'whole'").collect()
    got = sorted((r["vehicle_id"], r["seg_seq"], r["x"]) for r in rows if r["u"] < (DAY + datetime.timedelta(hours=1)).timestamp() * 1e6)
    want = sorted((v, k, m / (8.0 + v % 3)) for v in (1, 2, other) for k, m in enumerate(LENGTHS) if sum(LENGTHS[: k + 1]) <= (8.0 + v % 3) * 180)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    store = spark.read.format("statestore").option("stateVarName", "trip").load(f"{place}/cp")
    found = store.selectExpr("key", "explode_outer(list_element)" if dict(store.dtypes).get("list_element", "").startswith("array") else "list_element as col")
    assert sorted((r["key"][0], r["col"]["vehicle_id"]) for r in found.collect()) == [(1, 1), (2, 2)]
