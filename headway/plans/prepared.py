"""The five preparation stages as one run: landed reports and segments to a baseline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators import anomaly, prep, quantiles, stops, travel
from headway.sources.fixes import dealt, table


@dataclass
class Prepared:
    """Travel times (x, and pct among those of vehicle and time of day), grid points left, stop episodes, stop statistics and baseline by segment."""

    samples: DataFrame
    grid: DataFrame
    episodes: DataFrame
    stats: DataFrame
    baseline: DataFrame


def by_autoencoder(windows: DataFrame) -> DataFrame:
    """windows with `mse`, the error of a GRU autoencoder that learned from them."""
    return anomaly.reconstruction_mse(windows, anomaly.fit_autoencoder(windows.filter("xs is not null")))


def in_place(fixes: DataFrame, clean: Callable[[DataFrame], DataFrame] | None = anomaly.reject_fixes) -> DataFrame:
    """fixes with their trips and, on each, distances that never fall, without the fixes that `clean` finds out of place (None: no such step)."""
    moved = travel.with_trips(fixes)
    return travel.monotone(clean(moved) if clean else moved)


def prepare(fixes: DataFrame, segments: DataFrame, step_s: int = 5, level: float = 0.99, score: Callable[[DataFrame], DataFrame] = by_autoencoder, max_gap_s: int | None = None, clean: Callable[[DataFrame], DataFrame] | None = anomaly.reject_fixes) -> Prepared:
    """Fixes out of place go; then crossings, resampling, rejection, stops, quantiles, in this order.

    `clean` looks at single fixes before anything is formed of them (in_place),
    `score` at windows of the uniform series after it: it is given every point, `xs`
    being null for those that end no full window, and adds `mse`, null for the same.  A grid point that ends a window whose error is above the level's quantile is
    rejected, and so is the travel time of the segment in which it lies on that
    trip.  Stops are found on the points that are left.
    """
    moved = dealt(table(in_place(fixes, clean), "moved")) if clean else in_place(dealt(fixes), None)
    samples = travel.travel_times(travel.segment_crossings(moved, segments))
    timed = lambda points: points.withColumns({"u": F.col("k") * (step_s * 1_000_000), "fix_id": F.col("k")})
    grid = prep.resample_columns(moved, step_s, ("speed_kmh", "dist_m"), ("route_id", "trip"), max_gap_s)
    # Points keep their errors, so nothing is joined to find those above the cut.
    scored = timed(table(score(prep.sequence_windows(timed(grid), short=True)).select(*grid.columns, "mse"), "grid"))
    cut = table(anomaly.threshold(scored, level), "cut")
    clean = anomaly.above(scored, cut, kept=True).drop("mse")
    place = lambda rows: rows.join(travel.bounds(segments), "route_id").withColumn("seg_seq", travel.segment_at(F.col("bounds"), F.col("dist_m"))).drop("bounds")
    bad = place(anomaly.above(scored, cut))
    samples = table(quantiles.normalize(samples.join(bad.select("vehicle_id", "trip", "seg_seq"), ["vehicle_id", "trip", "seg_seq"], "left_anti")), "samples")
    found = stops.stop_episodes(stops.stop_state(clean), entry=("route_id", "trip", "dist_m"))
    begun, episodes = place(found), found.drop("route_id", "trip", "dist_m")
    stats = stops.segment_stop_stats(samples, begun.select("vehicle_id", "trip", "seg_seq", "dwell_s"), ("vehicle_id", "trip", "seg_seq"))
    return Prepared(samples, clean, episodes, stats, quantiles.segment_baseline(samples))
