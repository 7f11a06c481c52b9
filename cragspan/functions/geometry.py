"""Distances, vectors and triangles as column expressions; a point is a struct with x, y and z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | str, y: Column | str, z: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


def squared_distance(a: Column, b: Column, flat: bool = False) -> Column:
    d = [(a[k] - b[k]) * (a[k] - b[k]) for k in ("x", "y", "z")]
    return d[0] + d[1] if flat else d[0] + d[1] + d[2]


def distance(a: Column, b: Column, flat: bool = False) -> Column:
    return F.sqrt(squared_distance(a, b, flat))


def slope_percent(a: Column, b: Column) -> Column:
    """|dz| over the horizontal distance in percent; null where that is 0."""
    return F.try_divide(F.abs(b["z"] - a["z"]) * 100, distance(a, b, True))


def slope_angle(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b["z"] - a["z"], distance(a, b, True)))


def cross(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The normal of triangle a b c, twice its area long."""
    ux, uy, uz = (b[k] - a[k] for k in ("x", "y", "z"))
    vx, vy, vz = (c[k] - a[k] for k in ("x", "y", "z"))
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    n = cross(a, b, c)
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def projected_area(a: Column, b: Column, c: Column) -> Column:
    return F.abs(cross(a, b, c)[2]) / 2


def upward_normal(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The unit normal, turned to z >= 0; null for a degenerate triangle."""
    n = cross(a, b, c)
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    turn = F.when(n[2] < 0, -1.0).otherwise(1.0)
    return tuple(F.try_divide(k * turn, size) for k in n)


def triangle_slope(a: Column, b: Column, c: Column) -> Column:
    return F.degrees(F.acos(F.least(upward_normal(a, b, c)[2], F.lit(1.0))))


def triangle_aspect(a: Column, b: Column, c: Column) -> Column:
    """Clockwise from north in degrees; null where flat."""
    nx, ny, _ = upward_normal(a, b, c)
    return F.when((nx != 0) | (ny != 0), F.pmod(F.degrees(F.atan2(nx, ny)) + 360, F.lit(360.0)))


def hillshade(a: Column, b: Column, c: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    nx, ny, nz = upward_normal(a, b, c)
    zen, az = F.radians(F.lit(90.0 - altitude)), F.radians(F.lit(azimuth))
    light = (F.sin(zen) * F.sin(az), F.sin(zen) * F.cos(az), F.cos(zen))
    return 255 * F.greatest(F.lit(0.0), nx * light[0] + ny * light[1] + nz * light[2])


def barycentric(px: Column, py: Column, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Weights of (px, py) in the XY triangle; null for a degenerate one."""
    whole = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    w1 = F.try_divide((b["y"] - c["y"]) * (px - c["x"]) + (c["x"] - b["x"]) * (py - c["y"]), whole)
    w2 = F.try_divide((c["y"] - a["y"]) * (px - c["x"]) + (a["x"] - c["x"]) * (py - c["y"]), whole)
    return w1, w2, 1 - w1 - w2


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd test by edge crossings."""
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi == yj:
            continue
        meets = ((F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
        crossings = crossings + meets.cast("int")
    return crossings % 2 == 1


def base_code(code: Column) -> Column:
    """A field code without trailing digits; a code of digits stays."""
    bare = F.regexp_replace(code, "[0-9]+$", "")
    return F.when(bare == "", code).otherwise(bare)


def utm_zone(lat: Column, lon: Column) -> Column:
    """The zone number with the exceptions for south-west Norway and Svalbard."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = F.when((lon >= 0) & (lon < 9), 31).when((lon >= 9) & (lon < 21), 33).when((lon >= 21) & (lon < 33), 35).when((lon >= 33) & (lon < 42), 37)
    return F.when(norway, 32).when((lat >= 72) & (lat <= 84) & svalbard.isNotNull(), svalbard).otherwise(zone).cast("int")


def clamp(v: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("low is above high")
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def is_close(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
