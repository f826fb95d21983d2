"""Stops: a two-threshold state, its episodes, the choice of thresholds, and stop statistics by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.sources.fixes import ORDER

ENTER, EXIT = 5.0, 10.0


def stop_state(series: DataFrame, enter=ENTER, exit_=EXIT, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """series with `stopped`: 1 from a speed of at most `enter` until one of at least `exit_`; a null speed keeps the state, which begins as 0.

    The thresholds may be numbers or columns.
    """
    w = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    column = lambda x: x if not isinstance(x, (int, float)) else F.lit(float(x))
    mark = F.when(F.col("speed_kmh") <= column(enter), 1).when(F.col("speed_kmh") >= column(exit_), 0)
    return series.withColumn("stopped", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))


def stop_episodes(states: DataFrame, keys: tuple[str, ...] = ("vehicle_id",), entry: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of state 1: (keys, enter_u, enter_fix_id, exit_u, n_fixes, entry, dwell_s).  A run ends at the next fix after it, or at its last one when data ends.  entry: columns of the fix that begins it."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    change = F.when(F.col("stopped") != F.coalesce(F.lag("stopped").over(w), F.lit(0)), 1).otherwise(0)
    runs = states.withColumn("_next", F.lead("u").over(w)).withColumn("_change", change)
    runs = runs.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.first(F.when(F.col("_change") == 1, F.col(c)), ignorenulls=True)
    out = runs.filter("stopped = 1").groupBy(*keys, "_run").agg(
        F.min("u").alias("enter_u"),
        first("fix_id").alias("enter_fix_id"),
        F.max(F.coalesce("_next", "u")).alias("exit_u"),
        F.count(F.lit(1)).alias("n_fixes"),
        *[first(c).alias(c) for c in entry],
    )
    return out.withColumn("dwell_s", (F.col("exit_u") - F.col("enter_u")) / 1e6).drop("_run")


def grid_search(series: DataFrame, enters: list[float], exits: list[float], short_s: float, long_s: float) -> DataFrame:
    """(enter, exit, n_episodes, short_share, long_share, score) for each pair with enter < exit, best first.

    The score is the share of episodes of at least long_s less that of episodes
    under short_s; ties go to the smaller thresholds.  All pairs share one
    shuffle and sort by vehicle: their states are columns of the same windows.
    """
    grid = [(float(a), float(b)) for a in enters for b in exits if a < b]
    w = Window.partitionBy("vehicle_id").orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.select("vehicle_id", *ORDER, "speed_kmh").withColumn("_next", F.lead("u").over(w))
    mark = lambda a, b: F.when(F.col("speed_kmh") <= a, 1).when(F.col("speed_kmh") >= b, 0)
    rows = rows.withColumns({f"_s{k}": F.coalesce(F.last(mark(a, b), ignorenulls=True).over(run), F.lit(0)) for k, (a, b) in enumerate(grid)})
    rows = rows.withColumns({f"_c{k}": F.when(F.col(f"_s{k}") != F.coalesce(F.lag(f"_s{k}").over(w), F.lit(0)), 1).otherwise(0) for k in range(len(grid))})
    rows = rows.withColumns({f"_r{k}": F.sum(f"_c{k}").over(run) for k in range(len(grid))})
    pairs = F.array(*[F.struct(F.lit(a).alias("enter"), F.lit(b).alias("exit"), F.col(f"_s{k}").alias("s"), F.col(f"_r{k}").alias("run")) for k, (a, b) in enumerate(grid)])
    rows = rows.select("vehicle_id", "u", "_next", F.explode(F.filter(pairs, lambda p: p["s"] == 1)).alias("p"))
    episodes = rows.groupBy("vehicle_id", "p.enter", "p.exit", "p.run").agg(((F.max(F.coalesce("_next", "u")) - F.min("u")) / 1e6).alias("dwell_s"))
    share = lambda c: F.avg(c.cast("double"))
    out = episodes.groupBy("enter", "exit").agg(F.count(F.lit(1)).alias("n_episodes"), share(F.col("dwell_s") < short_s).alias("short_share"), share(F.col("dwell_s") >= long_s).alias("long_share"))
    return out.withColumn("score", F.col("long_share") - F.col("short_share")).orderBy(F.desc("score"), "enter", "exit")


def segment_stop_stats(traversals: DataFrame, episodes: DataFrame, keys: tuple[str, ...] = ("vehicle_id", "fix_id")) -> DataFrame:
    """(route_id, seg_seq, n_traversals, p_stop, mean_dwell_s): share of traversals in which a stop began, and mean dwell, 0 without stops.

    Episodes belong to the traversal of the same keys (enter_fix_id reads as
    fix_id).  Microseconds are summed as integers, so the mean doesn't depend on
    their order.
    """
    began = episodes.withColumnRenamed("enter_fix_id", "fix_id") if "fix_id" in keys else episodes
    began = began.groupBy(*keys).agg(F.count(F.lit(1)).alias("_stops"), F.sum(F.round(F.col("dwell_s") * 1e6).cast("bigint")).alias("_us"))
    joined = traversals.join(began, list(keys), "left")
    return joined.groupBy("route_id", "seg_seq").agg(
        F.count(F.lit(1)).alias("n_traversals"),
        F.avg(F.col("_stops").isNotNull().cast("double")).alias("p_stop"),
        F.coalesce(F.try_divide(F.sum("_us").cast("double"), F.sum("_stops").cast("double")) / 1e6, F.lit(0.0)).alias("mean_dwell_s"),
    )
