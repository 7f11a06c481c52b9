"""Samples of point clouds by cells, chance and density; neighbourhoods that follow the density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators import cloud as c
from cragspan.operators.neighbours import knn, local_density
from cragspan.plans.storage import materialise

#: The most neighbours of an adaptive search, and the bounds of an adaptive linking distance.
MOST_NEIGHBOURS = 128
LEAST_STRETCH, MOST_STRETCH = 0.5, 2.0


def voxel_index(axis: str, size: float) -> Column:
    """The cell along an axis; a coordinate that is not finite or too far for the cell raises."""
    v = F.col(axis)
    sound = (F.abs(v) / size <= 2.0**62) & ~F.isnan(v)
    return F.when(sound, F.floor(v / size).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"no cell for {axis} = "), F.coalesce(v.cast("string"), F.lit("null")))).cast("long"))


def voxel_all(cloud: DataFrame, size: float) -> DataFrame:
    """Every point, with its voxel."""
    return cloud.withColumns({f"v{a}": voxel_index(a, size) for a in "xyz"})


def stratified_random(cloud: DataFrame, size: float, each: int = 1, seed: int = 0) -> DataFrame:
    """Up to ``each`` points of every XY cell, those of the least hashes."""
    keyed = cloud.withColumns({"vx": voxel_index("x", size), "vy": voxel_index("y", size), "_h": F.xxhash64("pid", F.lit(seed))})
    order = Window.partitionBy("vx", "vy").orderBy("_h", "pid")
    return keyed.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).select("vx", "vy", "pid")


def stratified_centroid(cloud: DataFrame, size: float) -> DataFrame:
    """The point of every XY cell nearest to the mean of the cell's points, the least pid among equals."""
    keyed = cloud.withColumns({"vx": voxel_index("x", size), "vy": voxel_index("y", size)})
    mean = keyed.groupBy("vx", "vy").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    d2 = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))
    best = keyed.join(mean, ["vx", "vy"]).groupBy("vx", "vy").agg(F.min(F.struct(d2.alias("d2"), F.col("pid").alias("pid"))).alias("best"))
    return best.select("vx", "vy", "best.pid")


def keep_share(density: Column, target: float, least: float, most: float) -> Column:
    return F.greatest(F.least(F.coalesce(F.try_divide(F.lit(float(target)), density), F.lit(most)), F.lit(float(most))), F.lit(float(least)))


def density_sample(cloud: DataFrame, target: float, radius: float, least: float = 0.1, most: float = 1.0, seed: int = 0) -> DataFrame:
    """Points kept with the chance target / local density, within bounds; which ones follows from their ids."""
    chance = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = local_density(cloud, radius).select(F.col("pid").alias("_pid"), keep_share(F.col("density"), target, least, most).alias("_share"))
    return cloud.join(share, cloud["pid"] == F.col("_pid")).where(chance < F.col("_share")).select(*cloud.columns)


def _stretch(density: Column, factor: float) -> Column:
    return 1 + density / (density + 1) * (factor - 1)


def adaptive_k(cloud: DataFrame, k: int, radius: float, factor: float = 2.0) -> DataFrame:
    """``(pid, k)``: more neighbours where the cloud is denser, MOST_NEIGHBOURS at most."""
    return local_density(cloud, radius).select("pid", F.least(F.bround(k * _stretch(F.col("density"), factor)), F.lit(MOST_NEIGHBOURS)).cast("int").alias("k"))


def adaptive_radius(cloud: DataFrame, reach: float, radius: float, factor: float = 2.0) -> DataFrame:
    """``(pid, reach)``: a shorter reach where the cloud is denser."""
    return local_density(cloud, radius).select("pid", (reach / _stretch(F.col("density"), factor)).alias("reach"))


def adaptive_knn(cloud: DataFrame, k: int, radius: float, factor: float = 2.0) -> DataFrame:
    """The nearest neighbours of each point, as many as ``adaptive_k`` says for it."""
    each = adaptive_k(cloud, k, radius, factor)
    most = min(MOST_NEIGHBOURS, round(k * max(1.0, factor)))
    return knn(cloud, cloud, most, drop_self=True).join(each, "pid").where(F.col("rank") <= F.col("k")).drop("k")


def adaptive_eps(cloud: DataFrame, eps: float, k: int) -> DataFrame:
    """``(pid, eps)``: the linking distance stretched by a point's mean neighbour distance over the mean of all, within bounds."""
    each = knn(cloud, cloud, k, drop_self=True).groupBy("pid").agg(F.avg(F.sqrt("d2")).alias("_own"))
    whole = each.agg(F.avg("_own").alias("_all"))
    stretch = F.greatest(F.least(F.coalesce(F.try_divide("_own", "_all"), F.lit(1.0)), F.lit(MOST_STRETCH)), F.lit(LEAST_STRETCH))
    return each.join(F.broadcast(whole)).select("pid", (eps * stretch).alias("eps"))


def chained(cloud: DataFrame, steps: list[tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    """``(cloud, steps)``: filters ``(name, function of a cloud)`` one after the other, and a row for each with the points before and after it.

    Each filter's result is written, so that none is run twice."""
    counts, before = [], cloud.count()
    for k, (name, step) in enumerate(steps):
        cloud = materialise(step(cloud), "chained")
        after = cloud.count()
        counts.append((k, name, before, after))
        before = after
    return cloud, cloud.sparkSession.createDataFrame(counts, "step int, name string, before long, after long")


def masks(cloud: DataFrame, conditions: list[tuple[str, Column]]) -> DataFrame:
    """``cloud`` with a mask a condition: null where an earlier one had left the point out already."""
    left = F.lit(True)
    for name, condition in conditions:
        held = F.coalesce(condition, F.lit(False))
        cloud = cloud.withColumn(name, F.when(left, held))
        left = left & F.coalesce(F.col(name), F.lit(False))
    return cloud


#: Samplers by name.
METHODS = {
    "voxel_centroid": c.voxel_centroid, "voxel_closest": c.voxel_closest, "voxel_random": c.voxel_random, "voxel_all": voxel_all, "uniform": c.uniform_sample, "random": c.random_sample,
    "stratified_random": stratified_random, "stratified_centroid": stratified_centroid, "stratified_closest": c.stratified_closest, "density": density_sample,
}
