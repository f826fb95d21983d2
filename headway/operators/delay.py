"""Dual delay: percentile smoothing, channels, and the anomaly and micro accumulators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.scalars import HI, LO, channel, ms, quantile_at
from headway.sources.fixes import ORDER, by_vehicle

ALPHA = 0.2
#: What earlier terms of the smoothing weigh together at most, which is under the resolution of a double.
REST = 1e-17


def ema(series: DataFrame, alpha: float = ALPHA, value: str = "raw_pct", name: str = "ema_pct", exact: str | None = None) -> DataFrame:
    """series with y = alpha * x + (1 - alpha) * y_before for each vehicle, y = x at first, rounded to 6 places; a null keeps y.

    `exact` names a column for y before the rounding, from which a stream can go on.
    The sum of all terms down to REST, for any alpha: each row folds `near` terms,
    and then those folds of `far` rows that lie `near` apart, so that a row costs
    about two square roots of the number of terms and no history becomes one array.
    """
    keep = 1 - alpha
    terms = max(1, math.ceil(math.log(REST) / math.log(keep))) if 0 < keep < 1 else 1
    near = math.ceil(math.sqrt(terms))
    far = math.ceil(terms / near)
    x, run = F.col(value), by_vehicle().rowsBetween(Window.unboundedPreceding, 0)
    fold = lambda xs, factor: F.aggregate(xs, F.lit(0.0), lambda y, v: v + y * factor)
    out = series.withColumn("_i", F.count(value).over(run)).withColumn("_none", x.isNull())
    out = out.withColumn("_term", F.when(F.col("_i") == 1, x).otherwise(x * alpha))
    # The windows below split a vehicle's rows further, so they find them where they are.
    one = Window.partitionBy("vehicle_id", "_none").orderBy(*ORDER).rowsBetween(-(near - 1), 0)
    out = out.withColumn("_near", fold(F.collect_list("_term").over(one), keep)).withColumn("_rest", F.col("_i") % near)
    apart = Window.partitionBy("vehicle_id", "_none", "_rest").orderBy(*ORDER).rowsBetween(-(far - 1), 0)
    out = out.withColumn("_y", F.when(~F.col("_none"), fold(F.collect_list("_near").over(apart), keep**near)))
    y = F.last("_y", ignorenulls=True).over(run)
    out = out.withColumn(exact, y) if exact else out
    return out.withColumn(name, F.round(y, 6)).drop("_i", "_none", "_term", "_near", "_rest", "_y")


def delays(live: DataFrame, lo: float | Column = LO, hi: float | Column = HI, gate_on: str = "raw_pct") -> DataFrame:
    """live (with x, q, raw_pct, ema_pct) with channel, each fix's anomaly_ms and micro_ms, and their running sums.

    Outside the zone the excess over its edge counts as anomaly (negative if
    time was made up); inside, the smoothed percentile's distance from the
    median counts as micro.  A fix without a percentile has no channel and adds
    nothing.  The zone's edges may be columns of whole percentiles.
    """
    q, ch = F.col("q"), channel(F.col(gate_on), lo, hi)
    out = live.withColumn("channel", ch)
    edge = lambda e: F.get(q, e.cast("int") if isinstance(e, Column) else F.lit(int(e)))
    high, low = ms(F.col("x") - edge(hi)), ms(F.col("x") - edge(lo))
    out = out.withColumn("anomaly_step", F.when(F.col("channel") == "anomaly_high", high).when(F.col("channel") == "anomaly_low", low).otherwise(F.lit(0)).cast("bigint"))
    drift = ms(quantile_at(q, F.col("ema_pct")) - F.get(q, F.lit(50)))
    out = out.withColumn("micro_step", F.when(F.col("channel") == "micro", drift).otherwise(F.lit(0)).cast("bigint"))
    run = by_vehicle().rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({"anomaly_ms": F.sum("anomaly_step").over(run), "micro_ms": F.sum("micro_step").over(run)}).withColumn("total_ms", F.col("anomaly_ms") + F.col("micro_ms"))


def with_zone(live: DataFrame, zones: DataFrame, lo: int = LO, hi: int = HI) -> DataFrame:
    """live with `lo` and `hi`, its route's calibrated zone (grp, lo, hi); the given one where the route has none."""
    found = zones.select(F.col("grp").alias("_grp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    out = live.join(found, live["route_id"] == found["_grp"], "left")
    return out.withColumns({"lo": F.coalesce("_lo", F.lit(lo)), "hi": F.coalesce("_hi", F.lit(hi))}).drop("_grp", "_lo", "_hi")


def latest(rows: DataFrame) -> DataFrame:
    """Each vehicle's last row, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c != "vehicle_id"]
    return rows.groupBy("vehicle_id").agg(F.max_by(F.struct(*rest), F.struct("u", "fix_id")).alias("s")).select("vehicle_id", "s.*")
