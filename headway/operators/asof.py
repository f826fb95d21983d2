"""As-of join: each row with the newest version of its key that was in force at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time range in microseconds: a key's rows of one range meet in one task.
RANGE_U = 24 * 3600 * 1_000_000


def as_of(left: DataFrame, versions: DataFrame, keys: tuple[str, ...], time: str, since: str, columns: tuple[str, ...], range_u: int = RANGE_U) -> DataFrame:
    """left with `columns` of the version of the same keys with the greatest `since` that isn't after `time` (both whole numbers); null where there is none.

    Rows and versions are laid in one line and the last version looked back for,
    so neither side is broadcast and no pairs are made.  A key's line is cut into
    ranges of range_u, each of which begins with what was in force at its start,
    so a hot key's rows spread over its ranges.  Of versions of one time the one
    with the greatest columns counts; null keys meet null keys; rows without a
    time find nothing, versions without one are left out.
    """
    of = lambda c: F.expr(f"cast(floor({c} / {range_u}) as bigint)")
    found = versions.filter(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_t"), F.struct(*columns).alias("_v")).withColumn("_range", of("_t"))
    rows = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("_row")).withColumn("_range", of("_t"))
    last = found.groupBy(*keys, "_range").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    ranges = rows.select(*keys, "_range").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)).unionByName(last)
    ranges = ranges.groupBy(*keys, "_range").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranges.withColumn("_head", F.last("_last", ignorenulls=True).over(earlier)).filter("_head is not null").select(*keys, "_range", F.col("_head._v").alias("_v"))
    line = rows.withColumn("_order", F.lit(2)).unionByName(found.withColumn("_order", F.lit(1)), True).unionByName(heads.withColumn("_order", F.lit(0)), True)
    w = Window.partitionBy(*keys, "_range").orderBy(F.col("_order") > 0, "_t", "_order", "_v").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_met", F.last("_v", ignorenulls=True).over(w)).filter("_order = 2")
    return met.select("_row.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_met.{c}")).alias(c) for c in columns])
