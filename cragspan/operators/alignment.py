"""Road alignments: plan elements, vertical profiles, stations.

Stations meet elements by buckets of stations, an equi-join, so that long alignments spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clothoid(s: Column, radius: Column, length: Column) -> tuple[Column, Column]:
    """Offsets along and across the first tangent after ``s`` of a spiral from straight to ``radius``, by series."""
    theta = s * s / (2 * radius * length)
    along = sum(((-1) ** k / ((4 * k + 1) * math.factorial(2 * k)) * F.pow(theta, F.lit(2 * k)) for k in range(1, 9)), F.lit(1.0))
    across = sum(((-1) ** k / ((4 * k + 3) * math.factorial(2 * k + 1)) * F.pow(theta, F.lit(2 * k + 1)) for k in range(1, 9)), theta / 3)
    return s * along, s * across


def along(s: Column) -> tuple[Column, Column, Column]:
    """Point and signed curvature after ``s`` on a row's element ``(kind, x, y, heading, length, radius)``.

    Kinds are line, arc and spiral; angles are radians from east, and a positive radius turns left.
    """
    h, r = F.col("heading"), F.col("radius")
    u, v = clothoid(s, r, F.col("length"))
    arc, spiral = F.col("kind") == "arc", F.col("kind") == "spiral"
    x = F.when(arc, r * (F.sin(h + s / r) - F.sin(h))).when(spiral, u * F.cos(h) - v * F.sin(h)).otherwise(s * F.cos(h))
    y = F.when(arc, r * (F.cos(h) - F.cos(h + s / r))).when(spiral, u * F.sin(h) + v * F.cos(h)).otherwise(s * F.sin(h))
    bend = F.when(arc, 1 / r).when(spiral, s / (r * F.col("length"))).otherwise(F.lit(0.0))
    return F.col("x") + x, F.col("y") + y, bend


def _meet(stations: DataFrame, elements: DataFrame, size: float) -> DataFrame:
    """Each station with the first element that holds it; stations beyond all elements go."""
    end = F.col("start") + F.col("length")
    wide = elements.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(end / size))))
    both = stations.withColumn("_b", F.floor(F.col("station") / size)).join(wide, ["alignment", "_b"]).where((F.col("station") >= F.col("start")) & (F.col("station") <= end))
    inside = [c for c in elements.columns if c not in ("alignment", "start")]
    first = F.min_by(F.struct("start", *inside), F.col("start")).alias("_e")
    return both.groupBy("sid", "alignment", "station").agg(first).select("sid", "alignment", "station", "_e.*")


def station_points(stations: DataFrame, elements: DataFrame, size: float = 100.0) -> DataFrame:
    """``stations(sid, alignment, station)`` as points on ``elements(alignment, start, length, kind, x, y, heading, radius)``."""
    x, y, bend = along(F.col("station") - F.col("start"))
    return _meet(stations, elements, size).select("sid", x.alias("px"), y.alias("py"), bend.alias("curvature"))


def continuity(elements: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Gap from each element's end to the start of the next of its alignment, null after the last."""
    order = Window.partitionBy("alignment").orderBy("start")
    x, y, _ = along(F.col("length"))
    gap = F.hypot(F.lead("x").over(order) - F.col("_x"), F.lead("y").over(order) - F.col("_y"))
    return elements.withColumns({"_x": x, "_y": y}).select("alignment", "start", gap.alias("gap")).withColumn("joined", F.col("gap") <= tolerance)


def profile(pvis: DataFrame) -> DataFrame:
    """Grades and curves ``(alignment, start, length, length_in, z, g1, g2)`` from ``pvis(alignment, station, z, length_in, length_out)``.

    A grade is a curve whose grades are equal; curves of no length and grades between touching curves are left out.
    """
    order = Window.partitionBy("alignment").orderBy("station")
    to = F.lead("station").over(order)
    lined = pvis.withColumns({"_g2": (F.lead("z").over(order) - F.col("z")) / (to - F.col("station")), "_free": to - F.lead("length_in").over(order) - F.col("station") - F.col("length_out")})
    graded = lined.withColumn("_g1", F.lag("_g2").over(order))
    curves = graded.where("_g1 is not null and _g2 is not null and length_in + length_out > 0")
    curved = curves.select("alignment", (F.col("station") - F.col("length_in")).alias("start"), (F.col("length_in") + F.col("length_out")).alias("length"), "length_in", (F.col("z") - F.col("_g1") * F.col("length_in")).alias("z"), F.col("_g1").alias("g1"), F.col("_g2").alias("g2"))
    straight = graded.where("_free > 0").select("alignment", (F.col("station") + F.col("length_out")).alias("start"), F.col("_free").alias("length"), F.col("_free").alias("length_in"), (F.col("z") + F.col("_g2") * F.col("length_out")).alias("z"), F.col("_g2").alias("g1"), F.col("_g2").alias("g2"))
    return curved.unionByName(straight)


def profile_elevations(stations: DataFrame, elements: DataFrame, size: float = 100.0) -> DataFrame:
    """Elevation and grade of ``stations(sid, alignment, station)`` on a profile: two parabolas that touch at the PVI."""
    s, a, g1, g2 = F.col("station") - F.col("start"), F.col("length_in"), F.col("g1"), F.col("g2")
    b = F.col("length") - a
    mid = (g1 * a + g2 * b) / F.col("length")
    t = s - a
    z = F.when(s <= a, F.col("z") + g1 * s + (mid - g1) * s * s / (2 * a)).otherwise(F.col("z") + (g1 + mid) / 2 * a + mid * t + (g2 - mid) * t * t / (2 * b))
    grade = F.when(s <= a, g1 + (mid - g1) * s / a).otherwise(mid + (g2 - mid) * t / b)
    return _meet(stations, elements, size).select("sid", z.alias("elevation"), grade.alias("grade"))
