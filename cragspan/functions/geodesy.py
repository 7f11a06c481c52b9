"""Geodetic coordinates on the WGS 84 ellipsoid as column expressions; angles in degrees, lengths in metres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cragspan.operators.survey import numbered
from cragspan.plans.storage import materialise

#: WGS 84 semi-major axis and flattening; the scale, false easting and false northing of UTM.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_NORTH = 0.9996, 500_000.0, 10_000_000.0
_E2 = FLATTENING * (2 - FLATTENING)
_THIRD = FLATTENING / (2 - FLATTENING)
#: Coefficients of the transverse Mercator series in the third flattening, to its fourth power.
_N1, _N2, _N3, _N4 = (_THIRD**k for k in (1, 2, 3, 4))
SERIES = (_N1 / 2 - 2 * _N2 / 3 + 5 * _N3 / 16 + 41 * _N4 / 180, 13 * _N2 / 48 - 3 * _N3 / 5 + 557 * _N4 / 1440, 61 * _N3 / 240 - 103 * _N4 / 140, 49561 * _N4 / 161280)
RADIUS = AXIS / (1 + _THIRD) * (1 + _N2 / 4 + _N4 / 64)


def geocentric(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-centred x, y and z."""
    p, q = F.radians(lat), F.radians(lon)
    n = AXIS / F.sqrt(1 - _E2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - _E2) + height) * F.sin(p)


def helmert(x: Column, y: Column, z: Column, shift: tuple[float, float, float], turn: tuple[float, float, float], scale: float) -> tuple[Column, Column, Column]:
    """Seven-parameter transformation, position-vector sense: shift in metres, turn in arc seconds, scale in parts per million."""
    rx, ry, rz = (math.radians(a / 3600) for a in turn)
    m = 1 + scale * 1e-6
    return shift[0] + m * (x - rz * y + ry * z), shift[1] + m * (rz * x + y - rx * z), shift[2] + m * (-ry * x + rx * y + z)


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone (north or south by the latitude's sign), by the series around the conformal sphere."""
    p = F.radians(lat)
    e = math.sqrt(_E2)
    tau = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    away = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(tau, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + tau * tau))
    north, east = xi, eta
    for k, a in enumerate(SERIES, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return UTM_EAST + UTM_SCALE * RADIUS * east, UTM_SCALE * RADIUS * north + F.when(lat < 0, UTM_NORTH).otherwise(0.0)


@F.pandas_udf(DoubleType())
def geodesic(lat0: pd.Series, lon0: pd.Series, lat1: pd.Series, lon1: pd.Series) -> pd.Series:
    """Length of the shortest line on the ellipsoid, by iterating the longitude on the auxiliary sphere.

    Null for nearly antipodal points, where the iteration does not settle.  It runs on Arrow batches, as unrolled
    column expressions would repeat every shared part.
    """
    b, f = AXIS * (1 - FLATTENING), FLATTENING
    u0, u1 = (np.arctan((1 - f) * np.tan(np.radians(v.to_numpy(float)))) for v in (lat0, lat1))
    wide = np.radians((lon1 - lon0).to_numpy(float))
    turn = wide
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(30):
            across = np.cos(u1) * np.sin(turn)
            up = np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * np.cos(turn)
            sine, cosine = np.hypot(across, up), np.sin(u0) * np.sin(u1) + np.cos(u0) * np.cos(u1) * np.cos(turn)
            sigma = np.arctan2(sine, cosine)
            alpha = np.where(sine > 0, np.cos(u0) * across / sine, 0.0)
            square = 1 - alpha * alpha
            m = np.where(square > 1e-15, cosine - 2 * np.sin(u0) * np.sin(u1) / square, 0.0)
            c = f / 16 * square * (4 + f * (4 - 3 * square))
            last, turn = turn, wide + (1 - c) * f * alpha * (sigma + c * sine * (m + c * cosine * (2 * m * m - 1)))
            moved = np.abs(turn - last)
            if not (moved > 1e-12).any():
                break
    w = square * (AXIS * AXIS - b * b) / (b * b)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    bend = small * sine * (m + small / 4 * (cosine * (2 * m * m - 1) - small / 6 * m * (4 * sine * sine - 3) * (4 * m * m - 3)))
    return pd.Series(b * big * (sigma - bend)).where(moved <= 1e-12)


def utm_from_epsg(code: Column) -> tuple[Column, Column]:
    """Zone and hemisphere of a WGS 84 UTM code, null for other codes."""
    known = code.between(32601, 32660) | code.between(32701, 32760)
    return F.when(known, code % 100), F.when(known, F.when(code < 32700, "N").otherwise("S"))


def local_plane(x: Column, y: Column, origin: tuple[float, float], turn: float, scale: float, false: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Plane coordinates about an origin, turned by ``turn`` degrees counter-clockwise, scaled and given a false origin."""
    c, s = math.cos(math.radians(turn)) * scale, math.sin(math.radians(turn)) * scale
    dx, dy = x - origin[0], y - origin[1]
    return false[0] + c * dx - s * dy, false[1] + s * dx + c * dy


#: Coefficients of the inverse series: to the conformal sphere, and from the conformal to the geodetic latitude.
BACK = (_N1 / 2 - 2 * _N2 / 3 + 37 * _N3 / 96 - _N4 / 360, _N2 / 48 + _N3 / 15 - 437 * _N4 / 1440, 17 * _N3 / 480 - 37 * _N4 / 840, 4397 * _N4 / 161280)
LATITUDE = (2 * _N1 - 2 * _N2 / 3 - 2 * _N3 + 116 * _N4 / 45, 7 * _N2 / 3 - 8 * _N3 / 5 - 227 * _N4 / 45, 56 * _N3 / 15 - 136 * _N4 / 35, 4279 * _N4 / 630)
#: Codes of geographic WGS 84 and of the web's Mercator plane; those of UTM are 32600 or 32700 and the zone.
GEOGRAPHIC, WEB_MERCATOR = 4326, 3857


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a place in a zone."""
    xi = (north - F.when(south, UTM_NORTH).otherwise(0.0)) / (UTM_SCALE * RADIUS)
    eta = (east - UTM_EAST) / (UTM_SCALE * RADIUS)
    up, away = xi, eta
    for k, b in enumerate(BACK, 1):
        up = up - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        away = away - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asin(F.sin(up) / F.cosh(away))
    lat = conformal
    for k, d in enumerate(LATITUDE, 1):
        lat = lat + d * F.sin(2 * k * conformal)
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(away), F.cos(up)))


def from_geocentric(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height, by Bowring's formula: under a tenth of a millimetre off near the earth's surface."""
    b = AXIS * (1 - FLATTENING)
    p = F.hypot(x, y)
    theta = F.atan2(z * AXIS, p * b)
    lat = F.atan2(z + (AXIS * AXIS - b * b) / b * F.pow(F.sin(theta), 3), p - _E2 * AXIS * F.pow(F.cos(theta), 3))
    n = AXIS / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    height = F.when(F.abs(F.cos(lat)) > 1e-3, p / F.cos(lat) - n).otherwise(F.abs(z) / F.abs(F.sin(lat)) - n * (1 - _E2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def transformed(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """x and y from one system to another; geographic coordinates are longitude and latitude in this order.

    Systems are WGS 84 geographic (4326), UTM (326zz and 327zz) and web Mercator (3857); any other code raises.
    """

    def zone_of(code: int) -> tuple[int, bool] | None:
        known = 32601 <= code <= 32660 or 32701 <= code <= 32760
        return (code % 100, code > 32700) if known else None

    for code in (source, target):
        if code not in (GEOGRAPHIC, WEB_MERCATOR) and zone_of(code) is None:
            raise ValueError(f"no transformation for code {code}")
    if source == target:
        return x, y
    if source == WEB_MERCATOR:
        lon, lat = F.degrees(x / AXIS), F.degrees(2 * F.atan(F.exp(y / AXIS)) - math.pi / 2)
    elif zone := zone_of(source):
        lat, lon = from_utm(x, y, F.lit(zone[0]), F.lit(zone[1]))
    else:
        lon, lat = x, y
    if target == WEB_MERCATOR:
        return AXIS * F.radians(lon), AXIS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    if zone := zone_of(target):
        east, north = utm(lat, lon, F.lit(zone[0]))
        side = F.when(lat < 0, UTM_NORTH).otherwise(0.0)
        return east, north - side + (UTM_NORTH if zone[1] else 0.0)
    return lon, lat


def transform_points(points, source: int, target: int):
    """A cloud or a survey in another system; all other columns stay."""
    x, y = transformed(F.col("x"), F.col("y"), source, target)
    return points.withColumns({"x": x, "y": y})


def transform_features(features, source: int, target: int):
    """Features whose vertices are in another system."""

    def moved(v: Column) -> Column:
        x, y = transformed(v["x"], v["y"], source, target)
        return v.withField("x", x).withField("y", y)

    return features.withColumn("vertices", F.transform("vertices", moved))


def transform_box(box: Column, source: int, target: int) -> Column:
    """A flat box in another system, by its two corners only."""
    low, high = transformed(box["min_x"], box["min_y"], source, target), transformed(box["max_x"], box["max_y"], source, target)
    return F.struct(*[f(low[k], high[k]).alias(f"{e}_{a}") for k, a in enumerate("xy") for e, f in (("min", F.least), ("max", F.greatest))])


def checked_position(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Latitude and longitude; null, not finite, or beyond 90 and 180 degrees raises."""

    def fit(v: Column, most: float, name: str) -> Column:
        sound = F.coalesce(F.abs(v) <= most, F.lit(False)) & ~F.isnan(v)
        return F.when(sound, v).otherwise(F.raise_error(F.concat(F.lit(f"not a {name}: "), F.coalesce(v.cast("string"), F.lit("null")))).cast("double"))

    return fit(lat, 90.0, "latitude"), fit(lon, 180.0, "longitude")


def helmert_at(x: Column, y: Column, z: Column, shift: tuple[float, float, float], turn: tuple[float, float, float], scale: float, rates: tuple[float, ...], epoch: float, when: Column) -> tuple[Column, Column, Column]:
    """The fourteen-parameter form: ``rates`` of shift, turn and scale a year since ``epoch``."""
    years = when - epoch
    s = [F.lit(v) + r * years for v, r in zip(shift, rates[:3], strict=True)]
    rx, ry, rz = ((F.lit(math.radians(v / 3600)) + math.radians(r / 3600) * years) for v, r in zip(turn, rates[3:6], strict=True))
    m = 1 + (F.lit(scale) + rates[6] * years) * 1e-6
    return s[0] + m * (x - rz * y + ry * z), s[1] + m * (rz * x + y - rx * z), s[2] + m * (-ry * x + rx * y + z)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("lat", "lon", "azimuth")]))
def geodesic_end(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Where a shortest line of the given azimuth (degrees from north) and length ends, and its azimuth there."""
    b, f = AXIS * (1 - FLATTENING), FLATTENING
    a1, s = np.radians(azimuth.to_numpy(float)), length.to_numpy(float)
    u = np.arctan((1 - f) * np.tan(np.radians(lat.to_numpy(float))))
    start = np.arctan2(np.tan(u), np.cos(a1))
    alpha = np.cos(u) * np.sin(a1)
    square = 1 - alpha * alpha
    w = square * (AXIS * AXIS - b * b) / (b * b)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    sigma = s / (b * big)
    for _ in range(30):
        m = np.cos(2 * start + sigma)
        bend = small * np.sin(sigma) * (m + small / 4 * (np.cos(sigma) * (2 * m * m - 1) - small / 6 * m * (4 * np.sin(sigma) ** 2 - 3) * (4 * m * m - 3)))
        last, sigma = sigma, s / (b * big) + bend
        if not (np.abs(sigma - last) > 1e-13).any():
            break
    m = np.cos(2 * start + sigma)
    across = np.cos(u) * np.cos(sigma) - np.sin(u) * np.sin(sigma) * np.cos(a1)
    end = np.arctan2(np.sin(u) * np.cos(sigma) + np.cos(u) * np.sin(sigma) * np.cos(a1), (1 - f) * np.hypot(alpha, np.sin(u) * np.sin(sigma) - np.cos(u) * np.cos(sigma) * np.cos(a1)))
    wide = np.arctan2(np.sin(sigma) * np.sin(a1), across)
    c = f / 16 * square * (4 + f * (4 - 3 * square))
    turn = wide - (1 - c) * f * alpha * (sigma + c * np.sin(sigma) * (m + c * np.cos(sigma) * (2 * m * m - 1)))
    east = lon.to_numpy(float) + np.degrees(turn)
    out = np.degrees(np.arctan2(alpha, -np.sin(u) * np.sin(sigma) + np.cos(u) * np.cos(sigma) * np.cos(a1)))
    return pd.DataFrame({"lat": np.degrees(end), "lon": (east + 180) % 360 - 180, "azimuth": out % 360})


#: Area of the ellipsoid divided by 4 pi, and the nodes and weights by which an edge is integrated.
_E = math.sqrt(_E2)
AUTHALIC = AXIS * AXIS / 2 * (1 + (1 - _E2) * math.atanh(_E) / _E)
NODES, WEIGHTS = np.polynomial.legendre.leggauss(20)


@F.pandas_udf(DoubleType())
def area_below(lat0: pd.Series, lon0: pd.Series, lat1: pd.Series, lon1: pd.Series) -> pd.Series:
    """The area between a shortest line and the equator in square metres, positive eastwards on the northern half.

    On the auxiliary sphere it is the closed form of the great circle's, times the authalic radius squared; what the
    ellipsoid adds is smooth along the line and is summed over 20 nodes.  Longitudes may differ by any number of turns; a
    line runs the shorter way round.  Nearly antipodal ends, whose line is not settled, give no number.
    """
    wide = np.radians(((lon1 - lon0).to_numpy(float) + 180) % 360 - 180)
    u0, u1 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(v.to_numpy(float)))) for v in (lat0, lat1))
    turn = wide
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            across = np.cos(u1) * np.sin(turn)
            sine, cosine = np.hypot(across, np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * np.cos(turn)), np.sin(u0) * np.sin(u1) + np.cos(u0) * np.cos(u1) * np.cos(turn)
            sigma = np.arctan2(sine, cosine)
            alpha = np.where(sine > 0, np.cos(u0) * across / sine, 0.0)
            square = 1 - alpha * alpha
            m = np.where(square > 1e-15, cosine - 2 * np.sin(u0) * np.sin(u1) / square, 0.0)
            c = FLATTENING / 16 * square * (4 + FLATTENING * (4 - 3 * square))
            last, turn = turn, wide + (1 - c) * FLATTENING * alpha * (sigma + c * sine * (m + c * cosine * (2 * m * m - 1)))
            moved = np.abs(turn - last)
            if not (moved > 1e-13).any():
                break
        t0, t1 = np.tan(u0 / 2), np.tan(u1 / 2)
        total = AUTHALIC * 2 * np.arctan2(np.tan(turn / 2) * (t0 + t1), 1 + t0 * t1)
        for node, weight in zip(NODES, WEIGHTS, strict=True):
            t = (node + 1) / 2
            z = np.where(sine > 1e-12, (np.sin((1 - t) * sigma) * np.sin(u0) + np.sin(t * sigma) * np.sin(u1)) / sine, np.sin(u0) + t * (np.sin(u1) - np.sin(u0)))
            flat = np.maximum(1 - z * z, 0.0)
            w = np.sqrt(1 - _E2 * flat)
            s = z / w
            under = AXIS * AXIS * (1 - _E2) / 2 * (s / (1 - _E2 * s * s) + np.arctanh(_E * s) / _E)
            total = total + weight / 2 * np.where(flat > 1e-18, (under * w - AUTHALIC * z) / flat, 0.0) * alpha * sigma
    return pd.Series(np.where(moved <= 1e-9, total, np.nan)).where(lambda v: v.notna(), None)


def polygon_areas(corners: DataFrame) -> DataFrame:
    """``(polygon, area)`` in square metres on the ellipsoid of ``corners(polygon, seq, lat, lon)``, joined by shortest lines in the order of ``seq``.

    ``seq`` is a whole number; the last corner joins the first.  The area is that of the side without the poles, or with one
    pole if the ring goes round it, whichever way round the ring runs; of a ring over the antimeridian as of any other.
    Fewer than three corners have area 0.
    """
    placed = numbered(corners.select("polygon", "seq", "lat", "lon"), "polygon", "seq", "n")
    size = placed.groupBy("polygon").agg(F.count("*").alias("size"))
    placed = materialise(placed.join(size, "polygon").select("polygon", "n", "size", "lat", "lon"), "rings")
    following = placed.select("polygon", F.when(F.col("n") == 1, F.col("size")).otherwise(F.col("n") - 1).alias("n"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    edges = placed.join(following, ["polygon", "n"])
    east = F.pmod(F.col("lon1") - F.col("lon") + 180, F.lit(360.0)) - 180
    sums = edges.groupBy("polygon").agg(F.sum(area_below("lat", "lon", "lat1", "lon1")).alias("s"), F.round(F.sum(east) / 360).alias("turns"))
    half = 2 * math.pi * AUTHALIC
    around = F.when(F.abs("turns") % 2 == 1, half - F.abs("s")).otherwise(F.abs("s"))
    return sums.select("polygon", around.alias("area"))
