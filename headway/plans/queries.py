"""Transit queries over the driver's tables: compositions of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.scalars import channel
from headway.operators import anomaly, asof, delay, geo, prep, quantiles, recovery, safezone, stops, travel
from headway.plans import prepared
from headway.sources import fixes as src
from headway.streaming import agent, traversal

ROUTE = "click"
SPACING = 50_000
STEP_S = 3600
ENTERS, EXITS = [3.0, 5.0, 8.0], [8.0, 10.0, 15.0]
SHORT_S, LONG_S = 7200.0, 43_200.0
TOLS = [0.5, 1.0, 2.0, 4.0]
SPECTRUM = [i / 4 for i in range(1, 25)]
REJECT = 0.99
RESUMED_DAY = 26


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_fixes(spark, sf_dir)


def q_source_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.with_distance(base(spark, sf_dir)).select("route_id", "vehicle_id", "fix_id", "u", "speed_kmh", "seg_seq", "time_bucket", "dist_c", "history")


def q_source_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_segments(spark, sf_dir)


def q_travel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.travel_samples(base(spark, sf_dir)).drop("progress")


def q_route_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.for_route(base(spark, sf_dir), ROUTE).select("route_id", "vehicle_id", "fix_id", "u", "speed_kmh")


def q_stop_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prep.estimate_crossings(src.with_distance(base(spark, sf_dir)), SPACING)
    return found.withColumn("cross_s", F.round("cross_s", 3))


def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.resample_linear(base(spark, sf_dir), STEP_S).withColumn("value", F.round("value", 6))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.sequence_windows(base(spark, sf_dir).select("vehicle_id", "fix_id", "u", "speed_kmh", "history"))


def q_seq_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), 4)
    return windows(spark, sf_dir).select("vehicle_id", F.col("fix_id").alias("end_fix_id"), F.get("xs", F.lit(0)).alias("first_x"), F.element_at("xs", -1).alias("last_x"), total.alias("sum_x"))


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("vehicle_id", "fix_id", "u", "speed_kmh", "history")
    return prep.persistence_error(rows).filter("mse is not null").withColumn("mse", F.round("mse", 4))


def q_mse_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence(spark, sf_dir).select("vehicle_id", F.col("fix_id").alias("end_fix_id"), "mse")


def q_outlier_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = src.table(persistence(spark, sf_dir).select("vehicle_id", "fix_id", "history", "mse"), "scored")
    kept = anomaly.reject(base(spark, sf_dir), scored, anomaly.threshold(scored.filter("history"), REJECT))
    return kept.select("vehicle_id", "fix_id", "speed_kmh")


def q_ae_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = windows(spark, sf_dir)
    model = anomaly.fit_autoencoder(xs.filter("history"))
    return anomaly.reconstruction_mse(xs.filter("not history"), model).select("vehicle_id", F.col("fix_id").alias("end_fix_id"), "mse")


def q_ae_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes that the autoencoder, which learns from the history, leaves; the threshold is the history's."""
    xs = windows(spark, sf_dir)
    scored = anomaly.reconstruction_mse(xs, anomaly.fit_autoencoder(xs.filter("history")))
    scored = src.table(scored.select("vehicle_id", "fix_id", "history", "mse"), "scored")
    kept = anomaly.reject(base(spark, sf_dir), scored, anomaly.threshold(scored.filter("history"), REJECT))
    return kept.select("vehicle_id", "fix_id", "speed_kmh")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.stop_state(base(spark, sf_dir).select("vehicle_id", "fix_id", "u", "speed_kmh", "history"))


def q_stop_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("vehicle_id", "fix_id", "speed_kmh", "stopped")


def q_stop_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.stop_episodes(states(spark, sf_dir)).select("vehicle_id", "enter_u", "exit_u", "n_fixes", "dwell_s")


def q_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.grid_search(base(spark, sf_dir), ENTERS, EXITS, SHORT_S, LONG_S)


def q_quantile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.normalize(src.travel_samples(base(spark, sf_dir)))
    return out.select("vehicle_id", "time_bucket", "fix_id", "x", F.round("pct", 6).alias("pct"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.segment_baseline(src.travel_samples(base(spark, sf_dir)))


def q_segment_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).drop("q")


def qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safezone.qq_points(src.travel_samples(base(spark, sf_dir)))


def q_qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qq(spark, sf_dir)


def q_qq_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safezone.zone_curvature(qq(spark, sf_dir))


def q_qq_inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safezone.zone_inflection(qq(spark, sf_dir))


def q_qq_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safezone.sensitivity(qq(spark, sf_dir), TOLS)


def q_zone_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tolerance that each method's spectrum suggests, and its zone."""
    return safezone.plateaus(safezone.sensitivity(qq(spark, sf_dir), SPECTRUM))


def q_safe_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    live = src.travel_samples(base(spark, sf_dir), history=False)
    return quantiles.raw_pct(live, known if known is not None else baseline(spark, sf_dir))


def daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, seg_seq, since_u, day_p50, day_n): each day's median and number of samples, in force from the next midnight (UTC) on."""
    days = base(spark, sf_dir).withColumn("since_u", F.expr("(u div 86400000000 + 1) * 86400000000"))
    return days.groupBy("route_id", "seg_seq", "since_u").agg(F.round(F.percentile("speed_kmh", F.lit(0.5)), 6).alias("day_p50"), F.count(F.lit(1)).alias("day_n"))


def q_asof_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with the newest daily median of its segment that was known then."""
    rows = base(spark, sf_dir).select("vehicle_id", "fix_id", "route_id", "seg_seq", "u", "speed_kmh")
    return asof.as_of(rows, daily_medians(spark, sf_dir), ("route_id", "seg_seq"), "u", "since_u", ("since_u", "day_p50", "day_n")).drop("u")


def q_sketch_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of the history, merged from sketches by segment and day."""
    return quantiles.merged_baseline(src.table(quantiles.daily_sketches(src.travel_samples(base(spark, sf_dir))), "sketches"))


def q_raw_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("vehicle_id", "fix_id", "x", "raw_pct")


def q_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("vehicle_id", "fix_id", channel(F.col("raw_pct")).alias("channel"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = qq(spark, sf_dir)
    return safezone.intersect_zones(safezone.zone_curvature(points), safezone.zone_inflection(points))


def q_channel_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by each route's own calibrated zone."""
    rows = delay.with_zone(scored(spark, sf_dir), zones(spark, sf_dir))
    return rows.select("vehicle_id", "fix_id", "lo", "hi", channel(F.col("raw_pct"), F.col("lo"), F.col("hi")).alias("channel"))


def q_dual_delay_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both delays with each route's own calibrated zone as the gate."""
    rows = delay.delays(delay.ema(delay.with_zone(scored(spark, sf_dir), zones(spark, sf_dir))), F.col("lo"), F.col("hi"))
    return rows.select("vehicle_id", "fix_id", "channel", "anomaly_ms", "micro_ms", "total_ms")


def q_ema_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delay.ema(scored(spark, sf_dir)).select("vehicle_id", "fix_id", "ema_pct")


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delay.delays(delay.ema(scored(spark, sf_dir)))


def q_anomaly_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed(spark, sf_dir).select("vehicle_id", "fix_id", "anomaly_ms")


def q_micro_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed(spark, sf_dir).select("vehicle_id", "fix_id", "micro_ms")


def q_dual_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed(spark, sf_dir).select("vehicle_id", "fix_id", "channel", "anomaly_ms", "micro_ms", "total_ms")


def agent_state(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Batch twin of the streaming agent: each vehicle's last live state."""
    return folded(scored(spark, sf_dir, known))


def folded(rows: DataFrame, exact: str | None = None) -> DataFrame:
    """Each vehicle's last state after its scored samples; here the samples are speeds too.  exact: a column for the smoothed percentile before its rounding."""
    live = delay.delays(delay.ema(rows, exact=exact)).filter("raw_pct is not null").withColumn("speed_kmh", F.col("x"))
    rows = stops.stop_state(live).select("vehicle_id", "fix_id", "u", "route_id", "seg_seq", "progress", "stopped", "ema_pct", "anomaly_ms", "micro_ms", "total_ms", *([exact] if exact else []))
    return delay.latest(rows)


def q_agent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_state(spark, sf_dir).select("vehicle_id", F.col("u").alias("last_u"), "route_id", "seg_seq", "progress", "stopped", "ema_pct", "anomaly_ms", "micro_ms")


def stop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    traversals = base(spark, sf_dir).filter("history").select("route_id", "seg_seq", "vehicle_id", "fix_id")
    return stops.segment_stop_stats(traversals, stops.stop_episodes(states(spark, sf_dir)))


def q_stop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_stats(spark, sf_dir)


def plan(spark: SparkSession, sf_dir: str, pace: str = "median") -> DataFrame:
    """What is ahead of each vehicle; the baseline is made once, for the live percentiles and for the segments ahead."""
    known = src.table(baseline(spark, sf_dir), "baseline")
    return recovery.remaining(agent_state(spark, sf_dir, known), known, stop_stats(spark, sf_dir), pace)


def q_recovery_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.allocate(plan(spark, sf_dir), cap=None).select("vehicle_id", "route_id", "seg_seq", "weight", "recovery")


def q_recovery_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.allocate(plan(spark, sf_dir)).select("vehicle_id", "route_id", "seg_seq", "weight", "recovery")


def q_recovery_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery by water-filling: all of the delay that the segments' room can take."""
    return recovery.water_fill(plan(spark, sf_dir)).select("vehicle_id", "route_id", "seg_seq", "room", F.round("weight", 6).alias("weight"), F.round("filled", 5).alias("recovery"))


def q_delay_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.propagate(recovery.allocate(plan(spark, sf_dir))).select("vehicle_id", "route_id", "seg_seq", "delay_after")


def q_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.eta(recovery.allocate(plan(spark, sf_dir))).select("vehicle_id", "route_id", "seg_seq", "eta_s")


def q_eta_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals at each vehicle's own pace: quantiles at its smoothed percentile instead of medians."""
    return recovery.eta(recovery.allocate(plan(spark, sf_dir, "ema"))).select("vehicle_id", "route_id", "seg_seq", "remaining_current", "pace_s", "eta_s")


def q_prepared_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five preparation stages over the adapter's reports as one line of ten segments; rejection by the persistence error, which SQL can check."""
    fixes = src.line_fixes(src.dealt(base(spark, sf_dir)))
    found = prepared.prepare(fixes, src.line_segments(spark), STEP_S, REJECT, lambda w: prep.persistence_error(w).withColumn("mse", F.round("mse", 4)), clean=None)
    return found.baseline.drop("q").join(found.stats, ["route_id", "seg_seq"])


def q_map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on the earth as distances along the line."""
    found = geo.match(src.gps_fixes(base(spark, sf_dir)), src.line_shape(spark))
    return found.select("vehicle_id", "fix_id", F.round("dist_m", 1).alias("dist_m"), F.round("off_m", 1).alias("off_m"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's reports with GPS noise, in place: trips, no jumps, distances that never fall."""
    moved = travel.with_trips(src.jittered_fixes(base(spark, sf_dir)), top_ms=60.0)
    return travel.monotone(anomaly.reject_fixes(moved, anomaly.by_displacement, level=None, least=10_000.0))


def q_fixes_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes that rejection leaves, with their trips and monotone distances."""
    return noisy(spark, sf_dir).select("vehicle_id", "fix_id", "trip", F.round("dist_m", 2).alias("dist_m"))


def q_jitter_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the segments' travel times from noisy reports."""
    samples = travel.travel_times(travel.segment_crossings(src.table(noisy(spark, sf_dir), "noisy"), src.line_segments(spark)))
    return quantiles.segment_baseline(samples).drop("q")


def run_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From history and live fixes to recovery, propagation and arrivals for every vehicle and segment ahead."""
    return recovery.eta(recovery.propagate(recovery.allocate(plan(spark, sf_dir))))


def q_flagship_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tick with the delay recovered by water-filling."""
    rows = recovery.eta(recovery.propagate(recovery.water_fill(plan(spark, sf_dir))))
    return rows.select("vehicle_id", "route_id", "seg_seq", F.round("filled", 4).alias("recovery"), *[F.round(c, 4).alias(c) for c in ("delay_after", "eta_s")])


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_tick(spark, sf_dir).select("vehicle_id", "route_id", "cur", "seg_seq", "total_ms", "remaining_current", "recovery", "delay_after", "eta_s")


def q_agent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming agent run over the live fixes to their end; rows as q_agent_state."""
    return agent.run_to_end(spark, sf_dir, baseline(spark, sf_dir))


def q_traversal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the stream of noisy landed reports saw passed whole; a last report of another vehicle, a day later, lets it fold all."""
    place = f"{src.scratch(spark)}/landed-{uuid.uuid4().hex}"
    fixes = src.jittered_fixes(base(spark, sf_dir)).drop("u")
    last = fixes.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).filter("ts is not null")
    last = last.select(F.lit("line").alias("route_id"), F.lit(-1).cast("bigint").alias("vehicle_id"), F.lit(-1).cast("bigint").alias("fix_id"), "ts", F.lit(0.0).alias("speed_kmh"), F.lit(0.0).alias("dist_m"))
    fixes.unionByName(last).write.parquet(f"{place}/fixes")
    stream = src.read_fixes(spark, f"{place}/fixes", streaming=True)
    rows = traversal.traversals(stream, src.line_segments(spark), traversal.Traversals(top_ms=60.0))
    agent.run(rows, agent.landing(f"{place}/traversals"), f"{place}/checkpoint")
    found = spark.read.schema(f"{traversal.OUT}, batch bigint").parquet(f"{place}/traversals")
    return found.filter("kind = 'whole'").select("vehicle_id", "trip", "seg_seq", "u", "fix_id", "x")


def q_agent_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming agent over the reports from day 26 on, begun from the batch twin's state of the live days before; rows as q_agent_state."""
    early = F.dayofmonth(F.timestamp_micros("u")) < RESUMED_DAY
    known = src.table(baseline(spark, sf_dir), "baseline")
    live = src.travel_samples(base(spark, sf_dir), history=False)
    before = src.table(folded(quantiles.raw_pct(live.filter(early), known), exact="exact"), "before")
    later = agent.live_samples(spark, sf_dir).filter(~early)
    states = agent.run_to_end(spark, sf_dir, known, later, before.drop("total_ms", "ema_pct").withColumnRenamed("exact", "ema_pct"))
    # Vehicles without later reports keep their state.
    kept = before.select("vehicle_id", F.col("u").alias("last_u"), *states.columns[2:]).join(states.select("vehicle_id"), "vehicle_id", "left_anti")
    return states.unionByName(kept)


def q_eta_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival estimates that the stream published to its sink."""
    return agent.publish_eta(spark, sf_dir, baseline(spark, sf_dir), stop_stats(spark, sf_dir))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
