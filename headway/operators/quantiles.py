"""Quantile normalisation, segment baselines and the running percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.scalars import percentile_of

SEGMENT = ("route_id", "seg_seq")
#: Bins of values for each factor of e.
BINS = 200


def normalize(samples: DataFrame, keys: tuple[str, ...] = ("vehicle_id", "time_bucket"), value: str = "x") -> DataFrame:
    """samples with `pct`, 100 * percent_rank of the value among those of its keys."""
    return samples.withColumn("pct", 100 * F.percent_rank().over(Window.partitionBy(*keys).orderBy(value)))


def exact_quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, levels: list[float], stored: bool = False) -> DataFrame:
    """(keys, n, q): for each group its number of values and the quantiles at the levels, linear between neighbours; nulls and NaN don't count.

    No task holds a group: equal values are counted, dealt into bins of about
    half a percent of their size, and the ranks of a level are looked up in
    their bins by running counts.  Groups without values are left out.  stored:
    rows are cheap to read, so they are read twice, first for the bins' counts and
    then for the values of the bins that a level's rank falls into, and no others
    are shuffled.  That pays for few levels.
    """
    x = F.col(value).cast("double")
    usable = rows.filter(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_v"))
    size = F.signum("_v") * F.log1p(F.abs("_v")) * BINS
    usable = usable.withColumn("_b", F.floor(F.greatest(F.least(size, F.lit(1e9)), F.lit(-1e9))))
    each = lambda found: found.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    binned = usable.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_in")) if stored else each(usable).groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"))
    binned = binned.withColumns({"_before": F.coalesce(F.sum("_in").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_of": F.sum("_in").over(whole)})
    wanted = F.expr(f"transform(array({', '.join(f'{float(p)!r}D' for p in levels)}), (p, i) -> named_struct('i', i, 'p', p))")
    at = lambda p: (F.col("_of") - 1) * p
    # Only bins that a wanted rank falls into are looked into.
    inside = lambda first, past: lambda w: (F.floor(at(w["p"])) < past) & (F.ceil(at(w["p"])) >= first)
    binned = binned.withColumn("_wanted", F.filter(wanted, inside(F.col("_before"), F.col("_before") + F.col("_in")))).filter(F.size("_wanted") > 0)
    binned = binned.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bin"), "_before", "_of", "_wanted")
    same = F.col("_b") == F.col("_bin")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    counted = each(usable.join(F.broadcast(binned), same, "left_semi") if stored else usable)
    run = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.join(binned, same).withColumn("_to", F.col("_before") + run).withColumn("_from", F.col("_to") - F.col("_n"))
    found = ranked.select(*keys, "_v", "_from", "_to", "_of", F.explode(F.filter("_wanted", inside(F.col("_from"), F.col("_to")))).alias("w"))
    held = lambda rank: (rank >= F.col("_from")) & (rank < F.col("_to"))
    ends = {"_low": held(F.floor(at(F.col("w.p")))), "_high": held(F.ceil(at(F.col("w.p"))))}
    found = found.groupBy(*keys).agg(F.max("_of").alias("n"), *[F.sort_array(F.collect_list(F.when(c, F.struct("w.i", "_v")))).alias(name) for name, c in ends.items()])
    between = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    q = F.transform(wanted, lambda w: F.get("_low", w["i"])["_v"] + between(w["p"]) * (F.get("_high", w["i"])["_v"] - F.get("_low", w["i"])["_v"]))
    return found.select(*keys, "n", q.alias("q"))


def segment_baseline(samples: DataFrame, keys: tuple[str, ...] = SEGMENT, value: str = "x") -> DataFrame:
    """(keys, n, p10, p50, p90, q): exact interpolated quantiles of the n values; q holds p0 to p100.

    Quantiles are rounded to 6 places once, here, so that later comparisons
    don't depend on the last bit.
    """
    out = exact_quantiles(samples, keys, value, [i / 100 for i in range(101)]).withColumn("q", F.transform("q", lambda v: F.round(v, 6)))
    return out.select(*keys, "n", *[F.element_at("q", i + 1).alias(f"p{i}") for i in (10, 50, 90)], "q")


#: Size of a sketch: ranks of a merged baseline are within RANK_ERROR of exact with high probability.
SKETCH_K = 400
RANK_ERROR = 0.01


def daily_sketches(samples: DataFrame, keys: tuple[str, ...] = SEGMENT, value: str = "x", k: int = SKETCH_K) -> DataFrame:
    """(keys, day, n, sketch): a KLL sketch of a day's values, day being that of `u` in UTC; nulls and NaN don't count.

    A day's sketches are made once and kept: baselines of any span are merged
    from them (merged_baseline) without the samples.  Sketches combine before the
    one shuffle, and a group is never more than its sketch.
    """
    x = F.col(value).cast("double")
    usable = samples.filter(x.isNotNull() & ~F.isnan(x)).withColumn("day", F.expr("cast(floor(u / 86400000000) as bigint)"))
    return usable.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged_baseline(sketches: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(keys, n, p10, p50, p90, q) from sketches (daily_sketches) of some days, each a value that was seen, at a rank within RANK_ERROR of the level's."""
    levels = F.array(*[F.lit(i / 100) for i in range(101)])
    out = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    out = out.withColumn("q", F.transform(F.kll_sketch_get_quantile_double("_s", levels), lambda v: F.round(v, 6)))
    return out.select(*keys, "n", *[F.element_at("q", i + 1).alias(f"p{i}") for i in (10, 50, 90)], "q")


def raw_pct(live: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = SEGMENT) -> DataFrame:
    """live with its segment's quantiles and `raw_pct`; samples of segments without a baseline go.

    A sample that is null or NaN has a null percentile.  Catalyst broadcasts the
    baseline if it is small: it has a row for each segment.
    """
    rows = live.join(baseline.select(*keys, "q"), list(keys)).withColumn("_n", F.size(F.filter("q", lambda v: v <= F.col("x"))))
    known = F.col("x").isNotNull() & ~F.isnan("x")
    return rows.withColumn("raw_pct", F.when(known, F.round(percentile_of(F.col("q"), F.col("x"), F.col("_n")), 6))).drop("_n")
