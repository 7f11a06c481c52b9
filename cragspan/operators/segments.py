"""Segments of clouds: smooth regions, trees and buildings, and what is done with segment labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.operators.cloud import grid_ground
from cragspan.operators.neighbours import connected_components, dbscan, knn, nearest, radius_pairs, relative_height, spread_components
from cragspan.operators.shape import normals, shape_features
from cragspan.plans.storage import materialise


def numbered(labels: DataFrame, label: str, least: int) -> DataFrame:
    """``labels`` with segments of ``least`` points or more named by their least pid, the others -1."""
    sizes = labels.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("_n"))
    return labels.join(sizes, label, "left").withColumn(label, F.when(F.col("_n") >= least, F.col(label)).otherwise(F.lit(-1))).drop("_n")


def region_growing(cloud: DataFrame, k: int = 10, curvature: float = 0.05, angle: float = 15.0, least: int = 10, reach: float | None = None) -> DataFrame:
    """``(pid, segment)``: parts of smooth points (curvature up to ``curvature``) that links hold together, those of fewer than ``least`` points -1.

    Two smooth points are linked if they are at most ``reach`` apart (1.5 times the mean distance to k neighbours) and their
    normals, whatever their sign, differ by ``angle`` degrees at most.  Links go both ways, so the order of seeds doesn't matter; a rough
    point that starts a region of its own elsewhere is in none here.
    """
    shape = materialise(normals(cloud, k).where(F.col("curvature") <= curvature).join(cloud.select("pid", *"xyz"), "pid"), "smooth")
    if reach is None:
        mean = knn(cloud, cloud, k, drop_self=True).agg(F.avg(F.sqrt("d2"))).first()[0]
        reach = 1.5 * mean if mean else 1.0
    pairs = radius_pairs(shape, shape, reach).where("pid < nid").select("pid", "nid")
    for name, p in (("pid", "a"), ("nid", "b")):
        pairs = pairs.join(shape.select(F.col("pid").alias(name), *[F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"]), name)
    dot = F.abs(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz"))
    links = pairs.where(F.acos(F.least(dot, F.lit(1.0))) <= math.radians(angle)).select(F.col("pid").alias("a"), F.col("nid").alias("b"))
    roots = spread_components(links, shape).withColumnRenamed("root", "segment")
    return numbered(cloud.select("pid").join(roots, "pid", "left").select("pid", F.coalesce("segment", F.lit(-1)).alias("segment")), "segment", least)


def seeds(cloud: DataFrame, k: int = 10) -> DataFrame:
    """``(pid, curvature)``, flattest first, equal ones by pid."""
    return normals(cloud, k).select("pid", "curvature").orderBy("curvature", "pid")


def height_band(cloud: DataFrame, low: float, high: float, cell: float = 1.0, threshold: float = 0.2) -> DataFrame:
    """Points whose height over the nearest ground point (by the grid filter) is within ``low`` to ``high``."""
    ground = materialise(grid_ground(cloud, cell, cell, threshold).select("pid", *"xyz"), "band-ground")
    return cloud.join(relative_height(cloud, ground).where(F.col("height").between(low, high)).select("pid"), "pid", "left_semi")


def _kept(labels: DataFrame, feature: DataFrame, column: str, above: float, least: int) -> DataFrame:
    """Segments with ``least`` points and a mean of the feature above a bound keep their label."""
    good = labels.where("segment >= 0").join(feature.select("pid", column), "pid").groupBy("segment").agg(F.count("*").alias("n"), F.avg(column).alias("mean")).where((F.col("n") >= least) & (F.col("mean") > above))
    return labels.join(good.select("segment", F.lit(True).alias("_good")), "segment", "left").select("pid", F.when(F.col("_good"), F.col("segment")).otherwise(F.lit(-1)).alias("segment"))


def trees(cloud: DataFrame, low: float = 0.5, high: float = 50.0, eps: float = 0.5, least: int = 5, least_points: int = 10, k: int = 10, cell: float = 1.0) -> DataFrame:
    """``(pid, segment)`` of points in the height band: clusters whose mean verticality is above a half; others -1."""
    band = materialise(height_band(cloud, low, high, cell), "trees")
    upright = normals(band, k).select("pid", (1 - F.abs("nz")).alias("verticality"))
    return _kept(dbscan(band, eps, least).withColumnRenamed("cluster", "segment"), upright, "verticality", 0.5, least_points)


def buildings(cloud: DataFrame, low: float = 1.0, high: float = 100.0, k: int = 10, curvature: float = 0.02, angle: float = 10.0, least_points: int = 100, cell: float = 1.0) -> DataFrame:
    """``(pid, segment)`` of points in the height band: smooth regions whose mean planarity is above a half; others -1."""
    band = materialise(height_band(cloud, low, high, cell), "buildings")
    return _kept(region_growing(band, k, curvature, angle), shape_features(band, k), "planarity", 0.5, least_points)


def fill_noise(cloud: DataFrame, labels: DataFrame, label: str = "segment") -> DataFrame:
    """``labels(pid, segment)`` where noise (-1) takes the label of the nearest point that has one; without any, it stays."""
    placed = cloud.select("pid", *"xyz").join(labels.select("pid", label), "pid")
    near = nearest(placed.where(F.col(label) < 0), placed.where(F.col(label) >= 0)).select("pid", "nid")
    given = near.join(labels.select(F.col("pid").alias("nid"), F.col(label).alias("_given")), "nid").select("pid", "_given")
    return labels.join(given, "pid", "left").withColumn(label, F.coalesce("_given", label)).drop("_given")


def segment(cloud: DataFrame, labels: DataFrame, which: int, label: str = "segment") -> DataFrame:
    """The points of one segment."""
    return cloud.join(labels.where(F.col(label) == which).select("pid"), "pid", "left_semi")


#: Segmenters by name.
METHODS = {"region_growing": region_growing, "dbscan": dbscan, "connected_components": connected_components, "trees": trees, "buildings": buildings}
