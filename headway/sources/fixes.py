"""Position reports, route segments and travel-time samples, and the adapter that reads `events` as position reports.

In production an external poller lands the two public services' answers as
files; `read_fixes` and `read_segments` read those, in batch or as a stream.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIXES = "route_id string, vehicle_id bigint, fix_id bigint, ts timestamp, speed_kmh double, dist_m double"
GPS = "route_id string, vehicle_id bigint, fix_id bigint, ts timestamp, speed_kmh double, lat double, lon double"
SHAPES = "route_id string, pt_seq int, lat double, lon double"
SEGMENTS = "route_id string, seg_seq int, length_m double"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Days of the month up to this one are history, later ones live.
HISTORY_DAYS = 20
#: Order of a vehicle's fixes everywhere; fix_id breaks ties.
ORDER = ["u", "fix_id"]


def by_vehicle() -> Window:
    return Window.partitionBy("vehicle_id").orderBy(*ORDER)


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, for streams' checkpoints, sinks and tables; on a local master, as in tests, a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder, so that nothing that reads it twice computes it twice."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(fixes: DataFrame) -> DataFrame:
    """fixes by vehicle over all shuffle partitions: a fix that becomes many rows does so where it lies, so the fixes' own size mustn't make them fewer."""
    return fixes.repartition(int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vehicle_id")


def read_fixes(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Landed position reports (FIXES), with `u`, their time in microseconds; a stream takes at most max_files files into a micro-batch."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(FIXES).parquet(path).withColumn("u", F.unix_micros("ts"))


def read_gps(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Landed positions on the earth (GPS), with `u`; operators.geo.match gives them a distance along their route."""
    return (spark.readStream if streaming else spark.read).schema(GPS).parquet(path).withColumn("u", F.unix_micros("ts"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Landed route lines (SHAPES): points in order."""
    return spark.read.schema(SHAPES).parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Landed route segments (SEGMENTS), a dimension of fixed size for each route."""
    return spark.read.schema(SEGMENTS).parquet(path)


def adapt(events: DataFrame) -> DataFrame:
    """`events` as position reports; row by row, so batch and stream share it."""
    events.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_type").alias("route_id"),
        F.col("user_id").alias("vehicle_id"),
        F.col("event_id").alias("fix_id"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("u"),
        F.col("value").alias("speed_kmh"),
        F.expr("cast(cast(get_json_object(props, '$.k') as int) div 10 as int)").alias("seg_seq"),
        F.expr("cast(cast(get_json_object(props, '$.k') as int) % 10 as double) / 10").alias("progress"),
        F.expr("cast(hour(ts) div 6 as int)").alias("time_bucket"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        (F.dayofmonth("ts") <= HISTORY_DAYS).alias("history"),
    )


def event_fixes(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    # A stream takes a pattern: without one it would need a folder.
    path = f"{sf_dir}/events.parque[t]" if streaming else f"{sf_dir}/events.parquet"
    return adapt((spark.readStream if streaming else spark.read).schema(EVENTS).parquet(path))


def with_distance(fixes: DataFrame) -> DataFrame:
    """fixes with `dist_c`, the distance along the route in integer hundredths, a running sum that no engine rounds."""
    return fixes.withColumn("dist_c", F.sum("cents").over(by_vehicle().rowsBetween(Window.unboundedPreceding, 0)))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, segment and the mean of its samples in hundredths as a length."""
    fixes = event_fixes(spark, sf_dir)
    return fixes.groupBy("route_id", "seg_seq").agg(F.count(F.lit(1)).alias("n_fixes"), (F.sum("cents") / F.count("cents") / 100).alias("length_m"))


def travel_samples(fixes: DataFrame, history: bool = True) -> DataFrame:
    """Travel-time samples of the history (or the live) period."""
    return fixes.filter("history" if history else "not history").select("route_id", "seg_seq", "time_bucket", "vehicle_id", "fix_id", "u", "progress", F.col("speed_kmh").alias("x"))


def for_route(df: DataFrame, route_id: str) -> DataFrame:
    return df.filter(F.col("route_id") == route_id)


def line_fixes(fixes: DataFrame) -> DataFrame:
    """The adapter's fixes in the landed schema: every vehicle runs along one line, its distance the running sum."""
    moved = with_distance(fixes)
    return moved.select(F.lit("line").alias("route_id"), "vehicle_id", "fix_id", "ts", "u", "speed_kmh", (F.col("dist_c") / 100.0).alias("dist_m"))


def jittered_fixes(fixes: DataFrame, every_s: int = 10, length_m: float = 5000.0) -> DataFrame:
    """The adapter's fixes as a bus line with GPS noise, in the landed schema: a report every ten seconds, trips that begin anew after length_m, every fifth fix 2 m back and every 97th 5 km ahead."""
    moved = with_distance(fixes).withColumn("u", F.row_number().over(by_vehicle()) * (every_s * 1_000_000))
    noise = F.when(F.col("fix_id") % 97 == 0, 5000.0).otherwise(0.0) - F.when(F.col("fix_id") % 5 == 0, 2.0).otherwise(0.0)
    place = (F.col("dist_c") % int(length_m * 100)) / 100.0 + noise
    return moved.select(F.lit("line").alias("route_id"), "vehicle_id", "fix_id", F.timestamp_micros("u").alias("ts"), "u", "speed_kmh", place.alias("dist_m"))


def line_shape(spark: SparkSession, n: int = 10) -> DataFrame:
    """The line on the earth: n zigzag pieces of about 485 m to the north."""
    k = F.col("id")
    return spark.range(n + 1).select(F.lit("line").alias("route_id"), k.cast("int").alias("pt_seq"), (37.5 + 0.003 * k).alias("lat"), (127.0 + 0.004 * (k % 2)).alias("lon"))


def gps_fixes(fixes: DataFrame, n: int = 10) -> DataFrame:
    """The adapter's fixes as positions on line_shape: the distance, in pieces of 500 and from the start again after the last, with up to 22 m off to the north or south."""
    moved = with_distance(fixes).withColumn("_s", (F.col("dist_c") % (n * 50_000)) / 50_000.0)
    k, share = F.floor("_s"), F.col("_s") - F.floor("_s")
    lat = 37.5 + 0.003 * (k + share) + 0.0001 * (F.col("fix_id") % 5 - 2)
    lon = 127.0 + 0.004 * (k % 2 + share * (1 - 2 * (k % 2)))
    return moved.select(F.lit("line").alias("route_id"), "vehicle_id", "fix_id", "ts", "u", "speed_kmh", lat.alias("lat"), lon.alias("lon"))


def line_segments(spark: SparkSession, n: int = 10, length_m: float = 500.0) -> DataFrame:
    """The line's segments: n of one length."""
    return spark.range(n).select(F.lit("line").alias("route_id"), F.col("id").cast("int").alias("seg_seq"), F.lit(float(length_m)).alias("length_m"))
