"""Profiles of a surface: stations along lines, across them, and beside them, with the surface's elevation at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators.terrain import locate


def _steps(length: Column, interval: float) -> Column:
    """0, interval, ... up to ``length``, which follows itself unless the last step is within 1e-9 of it."""
    count = F.floor(length / interval + 1e-9)
    even = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: i * F.lit(float(interval)))
    return F.when(length - count * interval > 1e-9, F.concat(even, F.array(length))).otherwise(even)


def _elevated(stations: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """``stations`` with z of the surface at their x and y, null beside it."""
    keyed = stations.withColumn("pid", F.struct("line", "station", "offset"))
    found = locate(keyed.select("pid", "x", "y"), faces, size).select("pid", "z")
    return keyed.join(found, "pid", "left").drop("pid")


def longitudinal(lines: DataFrame, faces: DataFrame, interval: float, size: float, offsets: list[float] | None = None) -> DataFrame:
    """``lines(line, x0, y0, x1, y1)``: line, offset, station, x, y and z from each line's start to its end, both included.

    With ``offsets`` there is a parallel profile for each, to the left where positive.
    """
    if interval <= 0:
        raise ValueError("the interval must be positive")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    laid = lines.withColumn("_l", length).where("_l > 0").withColumns({"_ux": (F.col("x1") - F.col("x0")) / F.col("_l"), "_uy": (F.col("y1") - F.col("y0")) / F.col("_l")})
    beside = laid.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in sorted(offsets or [0.0])]))).withColumn("station", F.explode(_steps(F.col("_l"), interval)))
    s, o = F.col("station"), F.col("offset")
    return _elevated(beside.select("line", "offset", "station", (F.col("x0") + s * F.col("_ux") - o * F.col("_uy")).alias("x"), (F.col("y0") + s * F.col("_uy") + o * F.col("_ux")).alias("y")), faces, size)


def _across(centres: DataFrame, interval: float, width: float) -> DataFrame:
    """Offsets to both sides of ``centres(line, station, x, y, ux, uy)``: 0, every interval and the width itself."""
    if interval <= 0 or width <= 0:
        raise ValueError("interval and width must be positive")
    side = _steps(F.lit(float(width)), interval)
    both = F.array_sort(F.array_distinct(F.concat(F.transform(side, lambda v: -v), side)))
    laid = centres.withColumn("offset", F.explode(F.transform(both, lambda v: v + 0.0))).withColumn("offset", F.when(F.col("offset") == 0, 0.0).otherwise(F.col("offset"))).distinct()
    o = F.col("offset")
    return laid.select("line", "station", "offset", (F.col("x") - o * F.col("uy")).alias("x"), (F.col("y") + o * F.col("ux")).alias("y"))


def transversal(lines: DataFrame, faces: DataFrame, station: float, interval: float, width: float, size: float) -> DataFrame:
    """The profile across each of ``lines(line, x0, y0, x1, y1)`` at ``station``, ``width`` to either side."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    laid = lines.withColumn("_l", length).where("_l > 0").withColumns({"ux": (F.col("x1") - F.col("x0")) / F.col("_l"), "uy": (F.col("y1") - F.col("y0")) / F.col("_l")})
    centres = laid.select("line", F.lit(float(station)).alias("station"), (F.col("x0") + station * F.col("ux")).alias("x"), (F.col("y0") + station * F.col("uy")).alias("y"), "ux", "uy")
    return _elevated(_across(centres, interval, width), faces, size)


def directed(axis: DataFrame) -> DataFrame:
    """``axis(line, ord, x, y)`` with the way along it, ``station``, and the unit vector from the vertex before to the one after (at the ends: along the first or last segment)."""
    order = Window.partitionBy("line").orderBy("ord")
    back, ahead = F.struct(F.lag("x").over(order).alias("x"), F.lag("y").over(order).alias("y")), F.struct(F.lead("x").over(order).alias("x"), F.lead("y").over(order).alias("y"))
    near = axis.withColumns({"_b": back, "_a": ahead})
    step = F.coalesce(F.hypot(F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y")), F.lit(0.0))
    dx = F.coalesce("_a.x", "x") - F.coalesce("_b.x", "x")
    dy = F.coalesce("_a.y", "y") - F.coalesce("_b.y", "y")
    size = F.hypot(dx, dy)
    return near.withColumn("_step", step).select("line", "ord", "x", "y", F.sum("_step").over(order).alias("station"), F.try_divide(dx, size).alias("ux"), F.try_divide(dy, size).alias("uy"))


def cross_sections(axis: DataFrame, faces: DataFrame, interval: float, width: float, size: float) -> DataFrame:
    """A profile across ``axis(line, ord, x, y)`` at each of its vertices, centred on the vertex; ``station`` is the way along the axis."""
    return _elevated(_across(directed(axis).where("ux is not null"), interval, width), faces, size)


#: Profiles by name.
METHODS = {"longitudinal": longitudinal, "transversal": transversal, "cross_section": cross_sections, "multi": longitudinal}
