"""Areas on the ellipsoid against closed forms and a fine sum of flat strips."""

import math

import pytest

from cragspan.functions import geodesy


def areas(spark, rings):
    rows = [(name, k, float(lat), float(lon)) for name, ring in rings.items() for k, (lat, lon) in enumerate(ring)]
    got = geodesy.polygon_areas(spark.createDataFrame(rows, "polygon string, seq long, lat double, lon double").repartition(3))
    return {r.polygon: r.area for r in got.collect()}


def below(lat):
    """The area between the equator and a parallel, for each radian of longitude."""
    e2 = geodesy.FLATTENING * (2 - geodesy.FLATTENING)
    e, s = math.sqrt(e2), math.sin(math.radians(lat))
    return geodesy.AXIS**2 * (1 - e2) / 2 * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)


def test_closed_forms(spark):
    octant = [(0, 0), (0, 90), (90, 0)]
    strip = [(0, 0), *[(0, k) for k in range(10, 90, 10)], (0, 90), (90, 90)]
    fine = [(lat, lon) for lat, lons in ((10.0, range(0, 2001)), (20.0, range(2000, -1, -1))) for lon in [k / 100 for k in lons]]
    rings = {
        "octant": octant, "turned": octant[::-1], "far": [(lat, lon + 720) for lat, lon in octant], "strip": strip,
        "cap": [(60, k / 20) for k in range(0, 7200)], "south": [(-60, -k / 20) for k in range(0, 7200)],
        "fine": fine, "over": [(lat, (lon + 170 + 180) % 360 - 180) for lat, lon in fine],
        "equator": [(0, 0), (0, 50), (0, 20)], "line": [(1, 1), (5, 9)], "one": [(4, 4)],
    }
    got = areas(spark, rings)
    eighth = math.pi * geodesy.AUTHALIC / 2
    for name in ("octant", "turned", "far", "strip"):
        assert got[name] == pytest.approx(eighth, rel=1e-9)
    cap = 2 * math.pi * (geodesy.AUTHALIC - below(60))
    assert got["cap"] == pytest.approx(cap, rel=1e-5) and got["south"] == pytest.approx(got["cap"], rel=1e-12)
    quad = math.radians(20) * (below(20) - below(10))
    assert got["fine"] == pytest.approx(quad, rel=1e-6) and got["over"] == pytest.approx(got["fine"], rel=1e-9)
    assert all(abs(got[n]) < 1.0 for n in ("equator", "line", "one"))
    assert geodesy.AUTHALIC * 4 * math.pi == pytest.approx(510065621724088.44, rel=1e-12)
