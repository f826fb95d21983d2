"""Landed position reports to states and published arrivals: two streams with a table between them, and their batch twin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions.scalars import HI, ms
from headway.operators import delay, quantiles, stops, travel
from headway.sources.fixes import read_fixes, table
from headway.streaming import agent, traversal


@dataclass
class Live:
    """Folders of one live run: traversals, states, arrivals, and both streams' checkpoints."""

    place: str

    @property
    def traversals(self) -> str:
        return f"{self.place}/traversals"

    @property
    def arrivals(self) -> str:
        return f"{self.place}/eta"


def read_traversals(spark: SparkSession, live: Live, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{traversal.OUT}, batch bigint").parquet(live.traversals).drop("batch")


def run(spark: SparkSession, fixes_dir: str, segments: DataFrame, baseline: DataFrame, stats: DataFrame, live: Live, max_files: int | None = None, folder: traversal.Traversals | None = None):
    """Take both streams to the end of what has landed; the first one's query.  A later call goes on where this one ended."""
    fixes = read_fixes(spark, fixes_dir, streaming=True, max_files=max_files)
    first = agent.run(traversal.traversals(fixes, segments, folder), agent.landing(live.traversals), f"{live.place}/checkpoint-traversals")
    states = agent.agent_stream(read_traversals(spark, live, streaming=True), baseline)
    agent.write_eta(states, live.arrivals, baseline, stats, f"{live.place}/checkpoint-states").awaitTermination()
    return first


def landed_state(fixes: DataFrame, segments: DataFrame, baseline: DataFrame, **trips) -> DataFrame:
    """Batch twin of both streams: each vehicle's state after all fixes (columns of agent.STATE that are known in batch)."""
    moved = table(travel.monotone(travel.with_trips(fixes, jumps=False, **trips)), "moved")
    crossed = table(travel.segment_crossings(moved, segments), "crossed")
    samples = travel.travel_times(crossed).withColumn("fix_id", F.col("seg_seq").cast("bigint"))
    rows = delay.delays(delay.ema(quantiles.raw_pct(samples, baseline))).filter("raw_pct is not null")
    done = delay.latest(rows.select("vehicle_id", "u", "fix_id", F.col("route_id").alias("_route"), F.col("seg_seq").alias("_seg"), "ema_pct", "anomaly_ms", "micro_ms"))
    stands = F.col("dist_m") == F.min("dist_m").over(Window.partitionBy("vehicle_id", "trip"))
    last = delay.latest(stops.stop_state(moved).withColumn("stands", stands).select("vehicle_id", "u", "fix_id", "route_id", "trip", "dist_m", "stopped", "stands"))
    here = travel.with_progress(last, segments).join(crossed.select("vehicle_id", "trip", "seg_seq", "enter_u"), ["vehicle_id", "trip", "seg_seq"], "left")
    # A bus that stands where its trip began, at a segment's start, enters it when it leaves.
    began = F.when(F.col("stands") & (F.col("progress") == 0), 0.0)
    here = quantiles.raw_pct(here.withColumn("x", F.coalesce((F.col("u") - F.col("enter_u")) / 1e6, began)), baseline)
    over = F.when(F.col("raw_pct") > HI, ms(F.col("x") - F.get("q", F.lit(HI)))).otherwise(F.lit(0))
    here = here.select("vehicle_id", "route_id", "seg_seq", "progress", "stopped", F.col("u").alias("now_u"), F.col("raw_pct").alias("now_pct"), over.alias("pending_ms"))
    out = here.join(done.drop("fix_id"), "vehicle_id", "full")
    return out.select(
        "vehicle_id",
        "u",
        F.coalesce("route_id", "_route").alias("route_id"),
        F.coalesce("seg_seq", "_seg").alias("seg_seq"),
        "stopped",
        "ema_pct",
        F.coalesce("anomaly_ms", F.lit(0)).alias("anomaly_ms"),
        F.coalesce("micro_ms", F.lit(0)).alias("micro_ms"),
        "progress",
        "now_u",
        "now_pct",
        F.coalesce("pending_ms", F.lit(0)).alias("pending_ms"),
    )
