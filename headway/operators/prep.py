"""Preparation: stop crossings, resampling, sequence windows and the persistence error.

All of it works on one partitioning by vehicle, so Spark shuffles once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.scalars import mse
from headway.sources.fixes import by_vehicle

LENGTH = 12


def pairs(fixes: DataFrame, *columns: str) -> DataFrame:
    """Each fix with the next one's values in `next_<column>`; a vehicle's last fix goes."""
    w = by_vehicle()
    out = fixes.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("u", *columns)})
    return out.filter("next_u is not null")


def estimate_crossings(fixes: DataFrame, spacing: int, distance: str = "dist_c") -> DataFrame:
    """When each vehicle passed every multiple of `spacing` along its route.

    A boundary d inside the pair i, i+1 belongs to (s_i, s_i+1], and its time is
    linear between the two.  Pairs that don't move forward pass nothing.
    """
    k0, k1 = F.floor(F.col(distance) / spacing) + 1, F.floor(F.col(f"next_{distance}") / spacing)
    inside = pairs(fixes, distance).withColumn("k0", k0).withColumn("k1", k1).filter("k0 <= k1")
    rows = inside.withColumn("boundary", F.explode(F.sequence("k0", "k1")))
    share = (F.col("boundary") * spacing - F.col(distance)) / (F.col(f"next_{distance}") - F.col(distance))
    return rows.select("vehicle_id", "boundary", ((F.col("u") + share * (F.col("next_u") - F.col("u"))) / 1e6).alias("cross_s"))


def resample_columns(fixes: DataFrame, step_s: int, columns: tuple[str, ...], keep: tuple[str, ...] = (), max_gap_s: int | None = None) -> DataFrame:
    """(vehicle_id, k, keep, columns): linear interpolation at the multiples k of step_s from the epoch.

    The pair i, i+1 owns the grid points in [t_i, t_i+1).  Pairs further apart
    than max_gap_s, or of different values of the columns `keep`, give none.
    """
    step = step_s * 1_000_000
    rows = pairs(fixes, *columns, *keep)
    for c in keep:
        rows = rows.filter(F.col(c).eqNullSafe(F.col(f"next_{c}")))
    if max_gap_s is not None:
        rows = rows.filter(F.col("next_u") - F.col("u") <= max_gap_s * 1_000_000)
    rows = rows.withColumn("k0", F.expr(f"(u + {step} - 1) div {step}")).withColumn("k1", F.expr(f"(next_u - 1) div {step}")).filter("k0 <= k1")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1")))
    share = (F.col("k") * step - F.col("u")) / (F.col("next_u") - F.col("u"))
    return rows.select("vehicle_id", "k", *keep, *[(F.col(c) + share * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in columns])


def resample_linear(fixes: DataFrame, step_s: int = 5, value: str = "speed_kmh", max_gap_s: int | None = None) -> DataFrame:
    """(vehicle_id, k, value): one column on the grid; see resample_columns."""
    return resample_columns(fixes, step_s, (value,), max_gap_s=max_gap_s).withColumnRenamed(value, "value")


def sequence_windows(series: DataFrame, length: int = LENGTH, value: str = "speed_kmh", stride: int = 1, short: bool = False) -> DataFrame:
    """series with `xs`, the last `length` values in order, for rows that have so many; every stride-th of a vehicle's.  short: the other rows stay too, with a null."""
    w = by_vehicle()
    out, whole = series.withColumn("xs", F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))), F.size("xs") == length
    out = out.withColumn("xs", F.when(whole, F.col("xs"))) if short else out.filter(whole)
    return out if stride == 1 else out.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % stride == 0).drop("_n")


def persistence_mse(windows: DataFrame) -> DataFrame:
    """windows with `mse`, the error of the reconstruction that repeats the previous value."""
    n = F.size("xs")
    return windows.withColumn("mse", mse(F.slice("xs", F.lit(2), n - 1), F.slice("xs", F.lit(1), n - 1)))


def persistence_error(series: DataFrame, length: int = LENGTH, value: str = "speed_kmh") -> DataFrame:
    """series, whole, with `mse` as persistence_mse has it for its windows, to the last bit; null for rows that end none.  No row holds its window."""
    w = by_vehicle()
    step = F.col(value) - F.lag(value).over(w)
    rows = series.withColumn("_step", step).withColumn("_square", F.col("_step") * F.col("_step"))
    # A step is known where both its values are, so length - 1 known steps are a window.
    last, n = w.rowsBetween(-(length - 2), 0), length - 1
    error = F.when(F.count("_square").over(last) == n, F.sum("_square").over(last) / n)
    return rows.withColumn("mse", error).drop("_step", "_square")
