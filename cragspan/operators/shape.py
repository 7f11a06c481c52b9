"""Local geometry: covariance of each point's neighbourhood, its axes, and what follows from them.

Moments are one aggregation over the k-NN join; the axes of a symmetric 3 x 3 matrix have a closed
form, so everything stays a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.operators.neighbours import knn
from cragspan.plans.storage import materialise

_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
#: Eigenvalue shares below this count as this in the entropy.
LEAST_SHARE = 2.0**-52


def weights(near: DataFrame, sigma: float | None = None) -> DataFrame:
    """Neighbours ``(pid, nid, d2)`` with weight ``w`` = exp(-d2 / sigma^2), 1 for the nearest; without ``sigma`` the mean distance of all."""
    spread = near.agg(F.avg(F.sqrt("d2")).alias("_sigma")) if sigma is None else near.sparkSession.createDataFrame([(float(sigma),)], "_sigma double")
    w = F.when((F.col("d2") == 0) | (F.col("_sigma") == 0), 1.0).otherwise(F.exp(-F.col("d2") / (F.col("_sigma") * F.col("_sigma"))))
    return near.join(F.broadcast(spread)).withColumn("w", w).drop("_sigma")


def weighted_covariance(cloud: DataFrame, k: int, sigma: float | None = None) -> DataFrame:
    """As ``covariance``, with neighbours weighted about their weighted mean; the sum is divided by k, not by the weights."""
    near = weights(materialise(knn(cloud, cloud, k).select("pid", "nid", "d2"), "weighted"), sigma)
    at = cloud.select("pid", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    other = cloud.select(F.col("pid").alias("nid"), "x", "y", "z")
    off = near.join(at, "pid").join(other, "nid").select("pid", "w", *[(F.col(a) - F.col(f"p{a}")).alias(a) for a in "xyz"])
    w = F.col("w")
    sums = off.groupBy("pid").agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"m{a}") for a in "xyz"], *[F.sum(w * F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in _PAIRS])
    return materialise(sums.select("pid", *[((F.col(f"m{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") / w) / k).alias(f"c{a}{b}") for a, b in _PAIRS]), "moments")


def covariance(cloud: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """``(pid, cxx, cxy, cxz, cyy, cyz, czz)`` of the k nearest points, the point itself included, divided by their number; of all points or of those in ``wanted``."""
    asked = cloud if wanted is None else wanted
    near = knn(asked, cloud, k).select("pid", "nid")
    at = asked.select("pid", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    other = cloud.select(F.col("pid").alias("nid"), "x", "y", "z")
    # measured from the point, so that far coordinates lose no digits
    off = near.join(at, "pid").join(other, "nid").select("pid", *[(F.col(a) - F.col(f"p{a}")).alias(a) for a in "xyz"])
    sums = off.groupBy("pid").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], *[F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in _PAIRS])
    # written, as an aggregation with all that follows from it would outgrow the compiler
    return materialise(sums.select("pid", *[(F.col(f"m{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}")).alias(f"c{a}{b}") for a, b in _PAIRS]), "moments")


def eigenvalues(moments: DataFrame) -> DataFrame:
    """Adds l1 >= l2 >= l3 >= 0 by the trigonometric solution of the characteristic cubic."""
    c = {f"{a}{b}": F.col(f"c{a}{b}") for a, b in _PAIRS}
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    step = moments.withColumn("_q", q)
    d = {a: c[f"{a}{a}"] - F.col("_q") for a in "xyz"}
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    step = step.withColumn("_p", F.sqrt((d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] + 2 * off) / 6))
    det = d["x"] * (d["y"] * d["z"] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * d["z"] - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - d["y"] * c["xz"])
    cosine = F.coalesce(F.try_divide(det, 2 * F.col("_p") * F.col("_p") * F.col("_p")), F.lit(1.0))
    step = step.withColumn("_t", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / 3)
    high = F.col("_q") + 2 * F.col("_p") * F.cos("_t")
    low = F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_t") + 2 * math.pi / 3)
    zero = F.lit(0.0)
    return step.withColumns({"l1": F.greatest(high, zero), "l2": F.greatest(3 * F.col("_q") - high - low, zero), "l3": F.greatest(low, zero)}).drop("_q", "_p", "_t")


def normals_at(cloud: DataFrame, pids: DataFrame, k: int) -> DataFrame:
    """The normals of the points whose ids ``pids(pid)`` lists."""
    wanted = cloud.join(pids.select("pid").distinct(), "pid", "left_semi")
    return normals(wanted, k, moments=covariance(cloud, k, wanted))


def weighted_normals(cloud: DataFrame, k: int, sigma: float | None = None, viewpoint: tuple[float, float, float] | None = None) -> DataFrame:
    """As ``normals``, from neighbours weighted by their distance."""
    return normals(cloud, k, viewpoint, weighted_covariance(cloud, k, sigma))


def normals(cloud: DataFrame, k: int, viewpoint: tuple[float, float, float] | None = None, moments: DataFrame | None = None) -> DataFrame:
    """``(pid, nx, ny, nz, curvature)``: the axis of least spread, turned to the viewpoint or else upwards.

    Of the cross products of the rows of C - l3 I the longest is the axis; a neighbourhood without
    a single least axis (all points equal, or on a line) gets the vertical (0, 0, 1).
    """
    m = eigenvalues(covariance(cloud, k) if moments is None else moments)
    rows = [[F.col("cxx") - F.col("l3"), F.col("cxy"), F.col("cxz")], [F.col("cxy"), F.col("cyy") - F.col("l3"), F.col("cyz")], [F.col("cxz"), F.col("cyz"), F.col("czz") - F.col("l3")]]

    def product(a: list[Column], b: list[Column]) -> Column:
        n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        return F.struct((n[0] * n[0] + n[1] * n[1] + n[2] * n[2]).alias("size"), *[v.alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)])

    best = m.withColumn("_n", F.greatest(product(rows[0], rows[1]), product(rows[0], rows[2]), product(rows[1], rows[2])))
    clear = F.col("_n.size") > 1e-24 * F.pow(F.col("l1"), 4.0)
    unit = [F.when(clear, F.col(f"_n.n{c}") / F.sqrt("_n.size")).otherwise(F.lit(1.0 if c == "z" else 0.0)).alias(f"n{c}") for c in "xyz"]
    found = best.select("pid", *unit, F.coalesce(F.try_divide(F.col("l3"), F.col("l1") + F.col("l2") + F.col("l3")), F.lit(0.0)).alias("curvature"))
    if viewpoint is None:
        turn = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    else:
        found = found.join(cloud.select("pid", "x", "y", "z"), "pid")
        towards = sum((F.col(f"n{c}") * (F.lit(float(v)) - F.col(c)) for c, v in zip("yz", viewpoint[1:], strict=True)), F.col("nx") * (F.lit(float(viewpoint[0])) - F.col("x")))
        turn = F.when(towards < 0, -1.0).otherwise(1.0)
    return found.withColumn("_turn", turn).select("pid", *[(F.col(f"n{c}") * F.col("_turn")).alias(f"n{c}") for c in "xyz"], "curvature")


def shape_features(cloud: DataFrame, k: int) -> DataFrame:
    """Eigenvalue features of each point's neighbourhood; 0 where all its points are equal."""
    m = eigenvalues(covariance(cloud, k))
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    total = l1 + l2 + l3

    def of(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    shares = [F.greatest(of(v, total), F.lit(LEAST_SHARE)) for v in (l1, l2, l3)]
    entropy = -(shares[0] * F.log(shares[0]) + shares[1] * F.log(shares[1]) + shares[2] * F.log(shares[2]))
    return m.select("pid", F.cbrt(l1 * l2 * l3).alias("omnivariance"), of(l1 - l3, l1).alias("anisotropy"), of(l1 - l2, l1).alias("linearity"), of(l2 - l3, l1).alias("planarity"), of(l3, l1).alias("sphericity"), of(l3, total).alias("surface_variation"), entropy.alias("eigenentropy"))


def density_summary(cells: DataFrame) -> DataFrame:
    """Mean, least, greatest and deviation of the densities of occupied cells."""
    d = F.col("density")
    return cells.agg(F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.stddev_pop(d).alias("std"), F.count("*").alias("cells"))


def segment_sizes(labels: DataFrame, label: str) -> DataFrame:
    """Points of each segment; negative labels are noise and left out."""
    return labels.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("points"))


#: Normals by name.
METHODS = {"pca": normals, "weighted_pca": weighted_normals}
