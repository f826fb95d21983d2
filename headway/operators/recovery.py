"""Recovery of a delay over the remaining segments, its propagation, and arrival estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.scalars import quantile_at


def remaining(state: DataFrame, baseline: DataFrame, stats: DataFrame, pace: str = "median") -> DataFrame:
    """A row for each vehicle and segment ahead of it on its route, with p10, p50, stop statistics, and the time that is expected for it and for what is left of the current one.

    A segment without stop statistics counts as one without stops.  The expected
    time `pace_s` is the median, or with pace="ema" the segment's quantile at
    the vehicle's smoothed percentile; `remaining_current` is that time of the
    current segment for the share of it (1 - `progress`) that lies ahead, 0 where
    a state has no progress or its segment no baseline.
    """
    ahead = baseline.select("route_id", "seg_seq", "p10", "p50", *(["q"] if pace == "ema" else []))
    ahead = ahead.join(stats.select("route_id", "seg_seq", "p_stop", "mean_dwell_s"), ["route_id", "seg_seq"], "left").fillna(0.0, ["p_stop", "mean_dwell_s"])
    progress = F.coalesce("progress", F.lit(1.0)) if "progress" in state.columns else F.lit(1.0)
    now = state.select("vehicle_id", "route_id", F.col("seg_seq").alias("cur"), F.col("total_ms"), progress.alias("progress"), *(["ema_pct"] if pace == "ema" else []))
    rows = now.join(ahead, (now["route_id"] == ahead["route_id"]) & (ahead["seg_seq"] >= now["cur"]))
    expected = F.round(quantile_at(F.col("q"), F.col("ema_pct")), 6) if pace == "ema" else F.col("p50")
    rows = rows.withColumn("pace_s", expected)
    here = F.max(F.when(F.col("seg_seq") == F.col("cur"), (1 - F.col("progress")) * F.col("pace_s"))).over(Window.partitionBy("vehicle_id"))
    rows = rows.withColumn("remaining_current", F.round(F.coalesce(here, F.lit(0.0)), 6)).filter("seg_seq > cur")
    return rows.select("vehicle_id", now["route_id"], "cur", "total_ms", "seg_seq", "p10", "p50", "p_stop", "mean_dwell_s", "pace_s", "remaining_current")


def allocate(plan: DataFrame, weight_mode: str = "direct", cap: str | None = "q50-q10") -> DataFrame:
    """plan with `weight`, `share` and `recovery` in seconds.

    The delay above 0 is shared by weight = p_stop * mean_dwell_s (or its
    inverse), equally if all are 0.  The cap keeps each segment above its own
    p10; what it cuts off stays as delay.
    """
    product = F.col("p_stop") * F.col("mean_dwell_s")
    weight = product if weight_mode == "direct" else 1 / (1 + product)
    w = Window.partitionBy("vehicle_id")
    total, budget = F.sum("weight").over(w), F.greatest(F.lit(0), F.col("total_ms")) / 1000
    share = F.when(total > 0, budget * F.col("weight") / F.when(total > 0, total)).otherwise(budget / F.count(F.lit(1)).over(w))
    out = plan.withColumn("weight", weight).withColumn("share", F.round(share, 6))
    return out.withColumn("recovery", F.round(F.least("share", F.col("p50") - F.col("p10")), 6) if cap else F.col("share"))


def water_fill(plan: DataFrame) -> DataFrame:
    """plan with `room`, `weight`, `filled` and `recovery` in seconds: the delay above 0 shared by weight, no segment over its room, and what one can't take given on to the others.

    A segment's room is what it may be driven faster than its median, p50 - p10.
    Its weight grows with the room and with the time that stops take there, room *
    (1 + p_stop * mean_dwell_s).  All segments rise together, recovery = level *
    weight, until they are full; the level at which the delay is used up follows
    from the segments in the order in which they fill.  So the recoveries' sum is
    the delay or all the room there is, whichever is less.  `filled` is the
    recovery before its rounding to 6 places: who wants fewer rounds that one, as
    rounding twice takes values just under a half up.
    """
    room = F.greatest(F.lit(0.0), F.col("p50") - F.col("p10"))
    out = plan.withColumn("room", F.round(room, 6)).withColumn("weight", F.col("room") * (1 + F.col("p_stop") * F.col("mean_dwell_s")))
    out = out.withColumn("_full", F.when(F.col("weight") > 0, F.round(F.col("room") / F.when(F.col("weight") > 0, F.col("weight")), 12)))
    w = Window.partitionBy("vehicle_id")
    filling = w.orderBy(F.asc_nulls_first("_full"), "seg_seq")
    budget = F.greatest(F.lit(0), F.col("total_ms")) / 1000
    before = F.coalesce(F.sum("room").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", F.when(F.col("_full").isNotNull(), (budget - before) / F.when(open_ > 0, open_)))
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(w)
    out = out.withColumn("_level", level)
    share = F.when(F.col("_level").isNull(), F.col("room")).otherwise(F.least("room", F.greatest(F.lit(0.0), F.col("_level") * F.col("weight"))))
    return out.withColumn("filled", share).withColumn("recovery", F.round("filled", 6)).drop("_full", "_level")


def propagate(plan: DataFrame) -> DataFrame:
    """plan with `delay_after`: the delay left after each segment's recovery, never under 0."""
    run = Window.partitionBy("vehicle_id").orderBy("seg_seq").rowsBetween(Window.unboundedPreceding, 0)
    left = F.greatest(F.lit(0), F.col("total_ms")) / 1000 - F.sum("recovery").over(run)
    return plan.withColumn("delay_after", F.round(F.greatest(F.lit(0.0), left), 6))


def eta(plan: DataFrame) -> DataFrame:
    """plan with `eta_s`, seconds from now to the end of each segment ahead: what is left of the current one, then expected times less what is recovered, none below p10 on that account.

    `now` holds the delay already.  Without columns `pace_s` and
    `remaining_current`, medians count and nothing is left of the current segment.
    """
    run = Window.partitionBy("vehicle_id").orderBy("seg_seq").rowsBetween(Window.unboundedPreceding, 0)
    pace = F.col("pace_s") if "pace_s" in plan.columns else F.col("p50")
    left = F.col("remaining_current") if "remaining_current" in plan.columns else F.lit(0.0)
    each = F.greatest(pace - F.col("recovery"), F.least("p10", pace))
    return plan.withColumn("eta_s", F.round(left + F.sum(each).over(run), 6))
