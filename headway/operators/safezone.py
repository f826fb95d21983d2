"""Safe-zone calibration from quantile-quantile curves.

A zone is the run of percentiles around p50 in which a derivative of the
empirical against the normal quantiles keeps within a tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.scalars import Z
from headway.operators.quantiles import exact_quantiles

TOL_INFLECTION, TOL_CURVATURE = 1.0, 2.0


def qq_points(samples: DataFrame, by: str = "route_id", value: str = "x") -> DataFrame:
    """(grp, i, z, emp, smooth, d1, d2): percentiles 1 to 99, their centred 5-point means and central differences; null where neighbours lack."""
    rows = exact_quantiles(samples.select(F.col(by).alias("grp"), value), ("grp",), value, [i / 100 for i in range(1, 100)]).withColumnRenamed("q", "e")
    rows = rows.select("grp", F.posexplode("e").alias("pos", "emp")).select("grp", (F.col("pos") + 1).alias("i"), F.element_at(F.array(*map(F.lit, Z)), F.col("pos") + 1).alias("z"), F.round("emp", 6).alias("emp"))
    w = Window.partitionBy("grp").orderBy("i")
    five = w.rowsBetween(-2, 2)
    rows = rows.withColumn("smooth", F.when(F.count("emp").over(five) == 5, F.round(F.avg("emp").over(five), 6)))
    slope = lambda c: (F.lead(c).over(w) - F.lag(c).over(w)) / (F.lead("z").over(w) - F.lag("z").over(w))
    return rows.withColumn("d1", F.round(slope("smooth"), 6)).withColumn("d2", F.round(slope("d1"), 6))


def zones(qq: DataFrame, method: str, tols: list[float]) -> DataFrame:
    """(grp, method, tol, lo, hi): p50's run without a violation; 1 and 99 read as unbounded."""
    middle = qq.filter("i = 50").select("grp", F.col("d1").alias("d50"))
    rows = qq.join(middle, "grp").withColumn("tol", F.explode(F.array(*[F.lit(float(t)) for t in tols])))
    if method == "inflection":
        far = F.abs(F.col("d1") / F.when(F.col("d50") != 0, F.col("d50")) - 1) > F.col("tol")
    else:
        far = F.abs(F.col("d2")) > F.col("tol") * F.col("d50")
    return rows.groupBy("grp", "tol").agg(
        F.coalesce(F.max(F.when(far & (F.col("i") < 50), F.col("i"))) + 1, F.lit(1)).alias("lo"),
        F.coalesce(F.min(F.when(far & (F.col("i") > 50), F.col("i"))) - 1, F.lit(99)).alias("hi"),
    ).select("grp", F.lit(method).alias("method"), "tol", "lo", "hi")


def zone_curvature(qq: DataFrame, tol: float = TOL_CURVATURE) -> DataFrame:
    """Where the second derivative stays within tol times p50's slope."""
    return zones(qq, "curvature", [tol])


def zone_inflection(qq: DataFrame, tol: float = TOL_INFLECTION) -> DataFrame:
    """Where the slope stays within tol of p50's, relatively."""
    return zones(qq, "inflection", [tol])


def sensitivity(qq: DataFrame, tols: list[float]) -> DataFrame:
    """Both methods side by side over the tolerances."""
    return zones(qq, "curvature", tols).unionByName(zones(qq, "inflection", tols))


def plateaus(spectrum: DataFrame) -> DataFrame:
    """(grp, method, tol, lo, hi, n_tols) from a sensitivity spectrum: for each group and method the tolerance to choose, the least of its plateau.

    A plateau is a run of neighbouring tolerances with one zone: there the zone
    is a property of the sample and not of the tolerance.  The longest one
    counts, of equal ones that of the least tolerance; unbounded zones (1 to 99)
    count only where there is no other.
    """
    w = Window.partitionBy("grp", "method").orderBy("tol")
    zone = F.struct("lo", "hi")
    rows = spectrum.withColumn("_new", F.when(zone == F.lag(zone).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy("grp", "method", "_run").agg(F.min("tol").alias("tol"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.lit(1)).alias("n_tols"))
    best = F.min_by(F.struct("tol", "lo", "hi", "n_tols"), F.struct((F.col("lo") == 1) & (F.col("hi") == 99), -F.col("n_tols"), "tol"))
    return runs.groupBy("grp", "method").agg(best.alias("b")).select("grp", "method", "b.*")


def intersect_zones(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, lo, hi): the common part of two zones, nulls where there is none."""
    both = a.select("grp", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")).join(b.select("grp", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")), "grp")
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    return both.select("grp", F.when(lo <= hi, lo).alias("lo"), F.when(lo <= hi, hi).alias("hi"))
