"""Filters, sampling, ground classification and statistics of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.functions.geometry import in_polygon
from cragspan.operators.ranks import least_hashes, quantiles


def pass_through(cloud: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    return cloud.where(F.col(axis).between(low, high))


def crop_box(cloud: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    for axis, a, b in zip("xyz", low, high, strict=True):
        cloud = cloud.where(F.col(axis).between(a, b))
    return cloud


def clip_polygon(cloud: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points inside; the polygon's box comes first, so that it reaches the scan."""
    if len(polygon) < 3:
        raise ValueError("a polygon needs three vertices")
    xs, ys = zip(*polygon, strict=True)
    boxed = cloud.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return boxed.where(in_polygon(F.col("x"), F.col("y"), polygon))


def cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / size).cast("long")


def voxel_centroid(cloud: DataFrame, size: float) -> DataFrame:
    return cloud.groupBy(*[cell(a, size).alias(f"v{a}") for a in "xyz"]).agg(*[F.avg(a).alias(a) for a in "xyz"])


def voxel_closest(cloud: DataFrame, size: float) -> DataFrame:
    """The point nearest to each voxel's centre, the least pid among equals."""
    off = [F.col(a) - (cell(a, size) + 0.5) * size for a in "xyz"]
    d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    key = F.struct(d2.alias("d2"), F.col("pid").alias("pid"), *[F.col(a).alias(a) for a in "xyz"])
    best = cloud.groupBy(*[cell(a, size).alias(f"v{a}") for a in "xyz"]).agg(F.min(key).alias("best"))
    return best.select("vx", "vy", "vz", "best.pid", *[f"best.{a}" for a in "xyz"])


def voxel_random(cloud: DataFrame, size: float, seed: int) -> DataFrame:
    key = F.struct(F.xxhash64("pid", F.lit(seed)).alias("h"), F.col("pid").alias("pid"))
    return cloud.groupBy(*[cell(a, size).alias(f"v{a}") for a in "xyz"]).agg(F.min(key).alias("best")).select("vx", "vy", "vz", "best.pid")


def stratified_closest(cloud: DataFrame, size: float, each: int = 1, places: int | None = None) -> DataFrame:
    """The points of every XY cell nearest to its centre at the cell's mean height, the least pid among equals; with
    ``places``, squared distances that agree to so many places count as equal."""
    keys = [cell("x", size).alias("vx"), cell("y", size).alias("vy")]
    mean = cloud.groupBy(*keys).agg(F.avg("z").alias("mz"))
    own = cloud.withColumns({"vx": cell("x", size), "vy": cell("y", size)}).join(mean, ["vx", "vy"])
    dx, dy, dz = F.col("x") - (F.col("vx") + 0.5) * size, F.col("y") - (F.col("vy") + 0.5) * size, F.col("z") - F.col("mz")
    order = Window.partitionBy("vx", "vy").orderBy("d2", "pid")
    d2 = dx * dx + dy * dy + dz * dz
    return own.withColumn("d2", d2 if places is None else F.round(d2, places)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("vx", "vy", "pid")


def uniform_sample(cloud: DataFrame, step: int, offset: int = 0) -> DataFrame:
    return cloud.where(F.col("pid") % step == offset % step).where(F.col("pid") >= offset)


def random_sample(cloud: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Exactly round(n * fraction) points, one at least, those of the least hashes."""
    n = cloud.count()
    if not n:
        return cloud
    return least_hashes(cloud, "pid", max(1, round(n * fraction)), seed)


def ground_elevation(cloud: DataFrame, size_x: float, size_y: float) -> DataFrame:
    """``cloud`` with its XY cell's minimum: aggregated first and joined back, so that a full cell is no bottleneck."""
    keyed = cloud.withColumns({"ci": cell("x", size_x), "cj": cell("y", size_y)})
    return keyed.join(keyed.groupBy("ci", "cj").agg(F.min("z").alias("ground")), ["ci", "cj"])


def grid_ground(cloud: DataFrame, size_x: float, size_y: float, threshold: float) -> DataFrame:
    return ground_elevation(cloud, size_x, size_y).where(F.col("z") - F.col("ground") <= threshold)


def cell_seeds(cloud: DataFrame, size: float) -> DataFrame:
    """The lowest point of each XY cell, the least pid among equals."""
    key = F.struct("z", "pid")
    return cloud.groupBy(cell("x", size).alias("ci"), cell("y", size).alias("cj")).agg(F.min(key).alias("m")).select("ci", "cj", "m.pid", "m.z")


def bounds(cloud: DataFrame) -> DataFrame:
    return cloud.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def attribute_statistics(table: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return table.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("std"), F.count(c).alias("count"))


def elevation_statistics(cloud: DataFrame) -> DataFrame:
    z = F.when(~F.isnan("z"), F.col("z"))
    (median,) = quantiles(cloud, "z", [0.5])
    return cloud.agg(F.min(z).alias("min"), F.max(z).alias("max"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"), F.lit(median).cast("double").alias("median"), (F.max(z) - F.min(z)).alias("range"), F.count(z).alias("count"))


def histogram(table: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal bins from minimum to maximum, the last one closed, with the cumulative share."""
    ends = table.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    bin_ = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counted = table.select(column).where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(bin_.alias("bin"), "n").agg(F.count("*").alias("count"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    return counted.select("bin", "count", (F.sum("count").over(upto) / F.col("n")).alias("cumulative"))


def moments(table: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return table.agg(F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), F.count(c).alias("n"))


def percentiles(table: DataFrame, column: str, at: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``(percentile, value)``."""
    found = quantiles(table, column, [p / 100 for p in at])
    return table.sparkSession.createDataFrame(list(zip(map(float, at), found, strict=True)), "percentile double, value double")


def whiskers(table: DataFrame, column: str) -> DataFrame:
    """Quartiles, their range, and the whiskers that reach 1.5 of it beyond them, but not past the least and greatest value."""
    low, q1, q2, q3, high = quantiles(table, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    if q1 is None:
        row = (None,) * 6
    else:
        row = (q1, q2, q3, q3 - q1, max(low, q1 - 1.5 * (q3 - q1)), min(high, q3 + 1.5 * (q3 - q1)))
    return table.sparkSession.createDataFrame([row], "q1 double, q2 double, q3 double, iqr double, low double, high double")


def density_map(cloud: DataFrame, resolution: float) -> DataFrame:
    """Points per occupied cell, counted from the least corner, and per unit of area."""
    low = cloud.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = [((F.col(a) - F.col(f"{a}0")) / resolution).cast("long").alias(n) for a, n in (("y", "row"), ("x", "column"))]
    return cloud.join(F.broadcast(low)).groupBy(*at).agg(F.count("*").alias("points"), (F.count("*") / (resolution * resolution)).alias("density"))


#: Class codes of airborne point clouds.
CLASS_CODES = {"ground": [2], "vegetation": [3, 4, 5], "building": [6], "water": [9], "noise": [7, 18], "wire": [13, 14]}


def class_predicates(cloud: DataFrame, column: str = "classification") -> DataFrame:
    return cloud.withColumns({f"is_{name}": F.col(column).isin(codes) for name, codes in CLASS_CODES.items()})
