"""Lines of sight over a mesh, with the earth's curvature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.operators.neighbours import radius_pairs
from cragspan.operators.terrain import locate
from cragspan.plans.storage import materialise

EARTH_RADIUS = 6_371_000.0
#: Points of one place that are paired at once, and places that are, about.
MEMBERS = 1_024
PLACES = 1_024


def line_of_sight(rays: DataFrame, faces: DataFrame, samples: int, size: float, radius: float = EARTH_RADIUS) -> DataFrame:
    """``rays(ray, x0, y0, z0, x1, y1, z1)``: least clearance over the mesh and whether it is nowhere negative.

    ``samples - 1`` points between the ends are looked at; a ray with none of them over the mesh is open, its clearance null.
    """
    parts = rays.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples - 1)))).withColumn("t", F.col("k") / samples)
    at = [(F.col(f"{a}0") + F.col("t") * (F.col(f"{a}1") - F.col(f"{a}0"))) for a in "xyz"]
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    sunk = length * length * F.col("t") * (1 - F.col("t")) / (2 * radius)
    points = parts.select(F.struct("ray", "k").alias("pid"), at[0].alias("x"), at[1].alias("y"), (at[2] - sunk).alias("sight"))
    met = locate(points, faces, size, "sight").select("pid.ray", (F.col("sight") - F.col("z")).alias("clearance"))
    worst = met.groupBy("ray").agg(F.min("clearance").alias("clearance"), F.count_if(F.col("clearance") < 0).alias("blocked"))
    found = rays.select("ray").join(worst.hint("merge"), "ray", "left")
    return found.select("ray", "clearance", F.coalesce("blocked", F.lit(0)).cast("long").alias("blocked"), (F.coalesce("blocked", F.lit(0)) == 0).alias("visible"))


def viewshed(observer: tuple[float, float, float], targets: DataFrame, faces: DataFrame, height: float, samples: int, size: float) -> DataFrame:
    """Which of ``targets(pid, x, y)``, raised over the mesh, an observer sees; targets off the mesh are left out."""
    ground = targets.select("pid", "x", "y").join(locate(targets, faces, size).hint("merge"), "pid")
    ends = {f"{a}0": F.lit(v) for a, v in zip("xyz", observer, strict=True)}
    rays = ground.select(F.col("pid").alias("ray"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("z") + height).alias("z1")).withColumns(ends)
    return line_of_sight(rays, faces, samples, size).select(F.col("ray").alias("pid"), "visible")


def _every_pair(places: DataFrame) -> DataFrame:
    """``(pid, nid)`` of all written ``places``, each with itself too: blocks of places meet blocks, so neither side is held whole."""
    blocks = math.ceil(places.count() / PLACES) or 1
    own, other = F.pmod(F.xxhash64("pid"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = places.select("pid", own.cast("int").alias("i"), other.alias("j"))
    b = places.select(F.col("pid").alias("nid"), own.cast("int").alias("j"), other.alias("i"))
    return a.join(b.hint("merge"), ["i", "j"]).select("pid", "nid")


def sights(points: DataFrame, faces: DataFrame, reach: float | None, height: float, samples: int, size: float) -> tuple[DataFrame, DataFrame]:
    """``(places, sights)``: the places ``(pid, x, y, z, last, lists)`` of ``points(pid, x, y)`` on the mesh, named by their least pid, and
    ``(ray, clearance, blocked, visible)`` from place ``ray.pid`` to place ``ray.nid``, each way that a lesser id looks to a greater one.

    All places are paired, each with itself if it has several points; a ``reach`` keeps those pairs only that are at most so far apart in plan.
    """
    points = points.where("abs(x) < double('inf') and abs(y) < double('inf')")
    places = points.groupBy("x", "y").agg(F.min("pid").alias("pid"), F.max("pid").alias("last"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("lists"))
    places = materialise(places, "places")
    ground = locate(places, faces, size).select("pid", (F.col("z") + height).alias("z"))
    placed = materialise(places.join(ground.hint("merge"), "pid"), "posts")
    ends = [placed.select(F.col("pid").alias(name), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "z", "last")]) for k, name in enumerate(("pid", "nid"))]
    pairs = _every_pair(placed) if reach is None else radius_pairs(placed, placed, reach, "xy").select("pid", "nid")
    rays = pairs.join(ends[0], "pid").join(ends[1], "nid").where("pid < last1").withColumn("ray", F.struct("pid", "nid"))
    return placed, materialise(line_of_sight(rays.select("ray", *[f"{c}{k}" for k in (0, 1) for c in "xyz"]), faces, samples, size), "sights")


def paired(points: DataFrame, placed: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs ``(a, b, clearance, visible)`` of ``points`` by the sights between their places: paired last, in lists of bounded numbers, and
    not shuffled as pairs."""
    owned = points.select(F.col("pid").alias("post"), "x", "y").join(placed.select("pid", "x", "y", "lists"), ["x", "y"])
    listed = owned.groupBy("pid", F.pmod(F.xxhash64("post"), "lists").alias("list")).agg(F.collect_list("post").alias("posts"))
    members = [materialise(listed, "members").select(F.col("pid").alias(f"{c}_at"), F.col("list").alias(f"{c}_list"), F.col("posts").alias(f"{c}s")) for c in "ab"]
    met = found.select(F.col("ray.pid").alias("a_at"), F.col("ray.nid").alias("b_at"), "clearance", "visible")
    met = met.join(members[0].hint("merge"), "a_at").join(members[1].hint("merge"), "b_at").repartition("a_at", "b_at", "a_list", "b_list")
    return met.withColumn("a", F.explode("as")).withColumn("b", F.explode("bs")).where("a < b").select("a", "b", "clearance", "visible")


def intervisibility(points: DataFrame, faces: DataFrame, reach: float | None, height: float, samples: int, size: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``points(pid, x, y)``, with the clearance of the sight between them, both ends ``height`` over the mesh, and
    whether they see each other; points off the mesh are left out.

    All points are paired; a ``reach`` keeps those pairs only that are at most so far apart in plan.
    """
    return paired(points, *sights(points, faces, reach, height, samples, size))


def network(points: DataFrame, faces: DataFrame, reach: float | None, height: float, samples: int, size: float) -> DataFrame:
    """The pairs of points that see each other."""
    return intervisibility(points, faces, reach, height, samples, size).where("visible").select("a", "b")
