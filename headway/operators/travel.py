"""From landed position reports to travel times: trips, crossings of segment ends, and the times between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.prep import pairs
from headway.sources.fixes import ORDER, by_vehicle


#: A fall of the distance by more than so many metres ends a trip; smaller ones are jitter.
FALL_M = 100.0
#: No bus goes faster, in metres per second: a fix that needs more is out of place.
TOP_MS = 40.0


def with_trips(fixes: DataFrame, distance: str = "dist_m", fall_m: float = FALL_M, top_ms: float = TOP_MS, jumps: bool = True) -> DataFrame:
    """fixes with `trip`, from 0 for each vehicle: a new one where the route changes, or where the distance falls by more than fall_m and stays there.

    Falls up to fall_m are jitter.  One fix out of place ends no trip: a fall
    from a fix that could only be reached faster than top_ms is measured from the
    fix before it, and a fall that the next fix makes up for, again faster than
    top_ms, is none.  Rows without a time or distance go, and with jumps=False
    those fixes that are reached and left faster than top_ms in turn.
    """
    w = by_vehicle()
    usable = fixes.filter(F.col("u").isNotNull() & F.col(distance).isNotNull() & ~F.isnan(distance))
    s, far = F.col(distance), lambda a, b: F.greatest(b - a, F.lit(1_000_000)) / 1e6 * top_ms
    rows = usable.withColumn("_new", F.when(F.lag("u").over(w).isNotNull() & ~F.col("route_id").eqNullSafe(F.lag("route_id").over(w)), 1).otherwise(0))
    rows = rows.withColumn("_before", F.when(F.col("_new") == 0, F.lag(distance).over(w)))
    rows = rows.withColumn("_wild", F.coalesce(s - F.col("_before") > far(F.lag("u").over(w), F.col("u")), F.lit(False)))
    held = F.when(F.lag("_wild").over(w), F.lag("_before").over(w)).otherwise(F.col("_before"))
    back = F.lead("_wild").over(w) & (F.lead(distance).over(w) >= held - fall_m) & (F.lead("_new").over(w) == 0)
    fallen = (F.col("_new") == 0) & F.coalesce(s < held - fall_m, F.lit(False)) & ~F.coalesce(back, F.lit(False))
    ahead = F.col("_wild") & (F.lead("_new").over(w) == 0) & (s - F.lead(distance).over(w) > far(F.col("u"), F.lead("u").over(w)))
    behind = (F.col("_new") == 0) & (s < held - fall_m) & back
    rows = rows.withColumn("_turn", F.when(fallen, 1).otherwise(F.col("_new"))).withColumn("_jump", F.coalesce(ahead | behind, F.lit(False)))
    rows = rows.withColumn("trip", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (rows if jumps else rows.filter("not _jump")).drop("_new", "_before", "_wild", "_turn", "_jump")


def monotone(moved: DataFrame, distance: str = "dist_m") -> DataFrame:
    """moved (with_trips) with the distance replaced by the farthest one of its trip so far: a bus that seems to roll back stands."""
    w = Window.partitionBy("vehicle_id", "trip").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn(distance, F.max(distance).over(w))


def bounds(segments: DataFrame) -> DataFrame:
    """(route_id, bounds): a row for each route with its segments (seg_seq, start_m, end_m) in order."""
    w = Window.partitionBy("route_id").orderBy("seg_seq")
    rows = segments.withColumn("end_m", F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start_m", F.lag("end_m", 1, 0.0).over(w))
    return rows.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seg_seq", "start_m", "end_m"))).alias("bounds"))


def segment_at(found: Column, distance: Column) -> Column:
    """The segment that holds a distance, starts included and ends not; null outside of all."""
    return F.get(F.filter(found, lambda b: (b["start_m"] <= distance) & (distance < b["end_m"])), F.lit(0))["seg_seq"]


def segment_crossings(fixes: DataFrame, segments: DataFrame) -> DataFrame:
    """(route_id, vehicle_id, trip, seg_seq, enter_u, leave_u) for the segments that a trip (with_trips) entered or left, times in microseconds, null where not seen.

    A place inside the pair i, i+1 belongs to (s_i, s_i+1]; its time is linear
    between the two.  Where a trip begins at such a place, it is entered by the
    last fix there.
    """
    first = F.col("dist_m") == F.min("dist_m").over(Window.partitionBy("vehicle_id", "trip"))
    moves = pairs(fixes.withColumn("first", first), "dist_m", "trip").filter("trip = next_trip and next_dist_m > dist_m")
    moves = moves.join(bounds(segments), "route_id")
    passed = lambda b: ((b > F.col("dist_m")) | (F.col("first") & (b == F.col("dist_m")))) & (b <= F.col("next_dist_m"))
    hit = F.explode(F.filter("bounds", lambda b: passed(b["start_m"]) | passed(b["end_m"]))).alias("b")
    rows = moves.select("route_id", "vehicle_id", "trip", "dist_m", "next_dist_m", "u", "next_u", "first", hit)
    time = lambda d: F.col("u") + F.round((d - F.col("dist_m")) / (F.col("next_dist_m") - F.col("dist_m")) * (F.col("next_u") - F.col("u"))).cast("bigint")
    enter, leave = (F.when(passed(F.col(f"b.{c}")), time(F.col(f"b.{c}"))) for c in ("start_m", "end_m"))
    rows = rows.select("route_id", "vehicle_id", "trip", "b.seg_seq", enter.alias("enter_u"), leave.alias("leave_u"))
    return rows.groupBy("route_id", "vehicle_id", "trip", "seg_seq").agg(F.min("enter_u").alias("enter_u"), F.min("leave_u").alias("leave_u"))


def travel_times(crossings: DataFrame) -> DataFrame:
    """(route_id, seg_seq, time_bucket, vehicle_id, trip, u, x): seconds between the ends of each segment that was passed whole; u is when it was left, the bucket six hours (UTC) of when it was entered."""
    whole = crossings.filter("enter_u is not null and leave_u is not null")
    bucket = F.expr("cast((enter_u div 3600000000) % 24 div 6 as int)").alias("time_bucket")
    return whole.select("route_id", "seg_seq", bucket, "vehicle_id", "trip", F.col("leave_u").alias("u"), ((F.col("leave_u") - F.col("enter_u")) / 1e6).alias("x"))


def with_progress(fixes: DataFrame, segments: DataFrame) -> DataFrame:
    """fixes with `seg_seq` and `progress`, the share of the segment that lies behind; row by row, so a stream may be given.  Fixes outside of all segments go."""
    rows = fixes.join(bounds(segments), "route_id")
    here = F.get(F.filter("bounds", lambda b: (b["start_m"] <= F.col("dist_m")) & (F.col("dist_m") < b["end_m"])), F.lit(0))
    rows = rows.withColumn("_b", here).filter("_b is not null")
    share = (F.col("dist_m") - F.col("_b.start_m")) / (F.col("_b.end_m") - F.col("_b.start_m"))
    return rows.withColumn("seg_seq", F.col("_b.seg_seq")).withColumn("progress", share).drop("_b", "bounds")
