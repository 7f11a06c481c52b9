"""Every detector on a fixture that it hits: geometry, confidence, ids, and the sinks that take the rows."""

import itertools
import math
import sqlite3

import numpy as np
import pytest

from cragspan.operators import features
from cragspan.sinks import files, geopackage

SCHEMA = "pid long, x double, y double, z double, classification int, nx double, ny double, nz double"


def block(at, size, steps, code, height=0.0, nz=1.0):
    """Points of a box: steps along x, y and z."""
    (x0, y0), (sx, sy), (nx, ny, nh) = at, size, steps
    for i, j, k in itertools.product(range(nx), range(ny), range(nh)):
        yield x0 + sx * i / max(1, nx - 1), y0 + sy * j / max(1, ny - 1), height * k / max(1, nh - 1), code, nz


HITS = {
    "building": list(block((0, 0), (6, 6), (9, 9, 2), 6, 4.0)),
    "wall": list(block((100, 0), (6, 0.2), (16, 2, 2), 6, 2.0, 0.1)),
    "retaining_wall": list(block((200, 0), (6, 0.2), (16, 2, 2), 2, 1.0, 0.1)),
    "road": list(block((300, 0), (60, 4), (61, 5, 1), 11)),
    "parking": list(block((400, 0), (20, 18), (21, 19, 1), 11)),
    "driveway": list(block((500, 0), (10, 5), (13, 7, 1), 11)),
    "manhole": list(block((600, 0), (0.5, 0.5), (3, 3, 1), 1)),
    "inspection_chamber": list(block((700, 0), (1.2, 1.2), (4, 4, 1), 1)),
    "pole": list(block((800, 0), (0.1, 0.1), (2, 2, 20), 1, 11.0)),
    "light_pole": list(block((900, 0), (0.1, 0.1), (2, 2, 20), 1, 6.0)),
    "sign": list(block((1000, 0), (0.2, 0.1), (3, 2, 6), 1, 2.0)),
    "tree": list(block((1100, 0), (2, 2), (4, 4, 4), 5, 8.0)),
    "shrub": list(block((1200, 0), (1, 1), (4, 4, 2), 4, 1.0)),
    "grass": list(block((1300, 0), (12, 12), (13, 13, 1), 3)),
}


@pytest.fixture(scope="module")
def rows(spark):
    every = [p for k in HITS for p in HITS[k]]
    return spark.createDataFrame([(k, float(x), float(y), float(z), c, 0.0, math.sqrt(1 - nz * nz), float(nz)) for k, (x, y, z, c, nz) in enumerate(every)], SCHEMA).repartition(4)


def test_every_detector_hits(spark, rows, tmp_path):
    found = features.detected(rows)
    got = found.collect()
    assert {r.feature_type for r in got} == set(HITS)
    for name, points in HITS.items():
        mine = [r for r in got if r.feature_type == name and min(v.x for v in r.vertices) >= points[0][0] - 1 and max(v.x for v in r.vertices) <= points[-1][0] + 1]
        assert len(mine) == 1, name
        (r,) = mine
        p = np.array([q[:3] for q in points])
        category, kind, place = features.GEOMETRY[name]
        assert (r.category, r.geometry_type, r.confidence, r.attributes["point_count"]) == (category, kind, 1.0, str(len(p)))
        at = np.array([(v.x, v.y, v.z) for v in r.vertices])
        if kind == "polygon":
            assert r.closed and len(at) == 4 and np.allclose(at[:, 2], np.median(p[:, 2]))
            assert np.allclose(at[:, :2].min(0), p[:, :2].min(0)) and np.allclose(at[:, :2].max(0), p[:, :2].max(0))
        else:
            assert np.allclose(at, [p.mean(0) if place == "mean" else p[p[:, 2].argmin()]])
    for name in HITS:
        ids = sorted((r.first, r.feature_id) for r in got if r.feature_type == name)
        assert [i for _, i in ids] == list(range(1, len(ids) + 1))
    written = geopackage.write(found, str(tmp_path / "gpkg"), 32633).collect()
    total = 0
    for w in written:
        base = sqlite3.connect(tmp_path / "gpkg" / w.file)
        total += sum(base.execute(f'SELECT count(*) FROM "{t}"').fetchone()[0] for (t,) in base.execute("SELECT table_name FROM gpkg_contents"))
    assert total == len(got) == sum(w.features for w in written)
    files.write_dxf(found.selectExpr("geometry_type", "vertices", "closed", "cast(null as array<array<int>>) AS faces", "feature_type AS layer"), str(tmp_path / "dxf"))
    text = "".join(f.read_text() for f in (tmp_path / "dxf").iterdir() if f.suffix == ".dxf")
    assert text.count("LWPOLYLINE") == sum(r.geometry_type == "polygon" for r in got)


def test_medians(spark):
    r = np.random.default_rng(3)
    groups = {0: r.normal(0, 1, 501), 1: r.normal(5, 9, 400), 2: np.full(50, 3.25), 3: np.array([1.0, 2.0]), 4: np.array([7.0]), 5: np.concatenate([np.zeros(90), np.ones(90)])}
    table = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g int, z double")
    got = {m.g: m.median for m in features.medians(table, ["g"]).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})


def test_roofs(spark):
    """A gable of two planes that meet, a flat roof beside it, a few points too few, walls and ground."""
    s, rows = math.sqrt(0.5), []
    for i, j in itertools.product(range(11), range(11)):
        rows.append((i * 0.5, j * 0.5, 5 - abs(i - 5) * 0.5, 6, -s if i < 5 else s, 0.0, s))
        rows.append((50 + i * 0.5, j * 0.5, 3.0, 6, 0.0, 0.0, 1.0))
        rows.append((90 + i * 0.5, j * 0.5, 0.0, 2, 0.0, 0.0, 1.0))
        rows.append((70 + i * 0.5, j * 0.5, 0.0, 6, 1.0, 0.0, 0.1))
    rows += [(120 + k * 0.3, 0.0, 1.0, 6, 0.0, 0.0, 1.0) for k in range(20)]
    cloud = spark.createDataFrame([(k, *map(float, r[:3]), r[3], *map(float, r[4:])) for k, r in enumerate(rows)], SCHEMA)
    got = sorted(features.roofs(cloud).collect(), key=lambda r: r.feature_id)
    assert [int(r.attributes["point_count"]) for r in got] == [55, 121, 66]
    assert [round(float(r.attributes["mean_normal_x"]), 6) for r in got] == [round(-s, 6), 0.0, round(s, 6)]
    assert [len(r.faces) for r in got] == [2 * 4 * 10, 2 * 100, 2 * 5 * 10]
    assert all(max(max(f) for f in r.faces) < len(r.vertices) and r.geometry_type == "mesh" for r in got)
    with pytest.raises(ValueError):
        features.roofs(cloud, angle=0.0)
    assert features.roofs(cloud.limit(0)).count() == 0
