"""Ground windows, distances to meshes and registration against known answers."""

import numpy as np
import pytest

from cragspan.operators import ground, meshes, registration, terrain


def test_window_sizes():
    assert ground.window_sizes() == [3, 5, 9, 17, 33]
    assert ground.window_sizes(10) == [3, 5, 9]
    assert ground.window_sizes(8, exponential=False) == [3, 5, 7]
    assert ground.window_sizes(1) == [3]
    with pytest.raises(ValueError, match="above 1"):
        ground.window_sizes(33, 1.0)


def test_morphological_ground(spark):
    rows = [(i, i % 12 + 0.5, i // 12 + 0.5, 8.0 if 4 <= i % 12 <= 6 and 4 <= i // 12 <= 6 else 0.01 * (i % 3)) for i in range(144)]
    cloud = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    assert sorted(r.pid for r in ground.morphological_ground(cloud).collect()) == [r[0] for r in rows if r[3] < 1]
    assert ground.morphological_ground(cloud.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 9"):
        ground.morphological_ground(cloud, most_cells=9)


def test_cloud_to_mesh(spark):
    p = lambda x, y, z: {"x": float(x), "y": float(y), "z": float(z)}
    faces = spark.createDataFrame([(0, p(0, 0, 0), p(10, 0, 0), p(0, 10, 0)), (1, p(50, 50, 1), p(50, 50, 1), p(52, 50, 1))], "tid long, p0 struct<x double, y double, z double>, p1 struct<x double, y double, z double>, p2 struct<x double, y double, z double>")
    points = [(0, 2.0, 2.0, 5.0), (1, -10.0, -10.0, 0.0), (2, 4.0, -3.0, 0.0), (3, 51.0, 50.0, 1.0), (4, 2.0, 2.0, 5.0)]
    cloud = spark.createDataFrame(points, "pid long, x double, y double, z double")
    got = {r.pid: r.distance for r in meshes.cloud_to_mesh(cloud, faces).collect()}
    assert got == pytest.approx({0: 5.0, 1: 200**0.5, 2: 3.0, 3: 1.0, 4: 5.0})
    assert sorted(r.pid for r in meshes.cloud_to_mesh(cloud, faces, 3.5).collect()) == [2, 3]
    assert meshes.cloud_to_mesh(cloud, faces.limit(0)).count() == 0


@pytest.mark.parametrize("plane", [False, True])
def test_register(spark, plane):
    at = np.random.default_rng(0).uniform(-5, 5, (200, 3))
    if plane:  # a surface has normals to speak of
        at[:, 2] = np.sin(at[:, 0]) + 0.3 * at[:, 1] ** 2 / 5
    cloud = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "pid long, x double, y double, z double")
    turn, by = registration.turned(np.array([0.01, -0.02, 0.03])), np.array([0.05, -0.04, 0.03])
    got = registration.register(registration.moved(cloud, turn, by), cloud, plane, cutoff=2.0, rounds=20)
    assert got.converged and got.fitness == 1.0
    assert got.rmse < 1e-6
    assert np.allclose(got.rotation, turn.T, atol=1e-6) and np.allclose(got.shift, -turn.T @ by, atol=1e-6)
    with pytest.raises(ValueError, match="fewer than three"):
        registration.register(registration.moved(cloud, np.eye(3), np.full(3, 99.0)), cloud, rounds=1)


def test_far_points_ask_few_tiles(spark, monkeypatch):
    """Points far off the mesh were compared with every triangle of it."""
    r = np.random.default_rng(3)
    side = 40
    z = r.uniform(0, 3, (side, side))
    at = lambda i, j: (float(j), float(i), float(z[i, j]))
    cells = [(at(i, j), at(i, j + 1), at(i + 1, j + 1 - k)) for i in range(side - 1) for j in range(side - 1) for k in (0, 1)]
    kind = "struct<x double, y double, z double>"
    faces = spark.createDataFrame([(k, *t) for k, t in enumerate(cells)], f"tid long, p0 {kind}, p1 {kind}, p2 {kind}")
    points = np.concatenate([r.uniform((0, 0, -2), (40, 40, 9), (300, 3)), r.uniform((0, 5000, 0), (40, 5040, 5), (300, 3))])
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "pid long, x double, y double, z double")
    asked, visits = [], meshes._visits
    monkeypatch.setattr(meshes, "TILE", 64)
    monkeypatch.setattr(meshes, "BLOCK", 100)
    monkeypatch.setattr(meshes, "_visits", lambda a, m: asked.append(a.where("pid >= 300").count()) or visits(a, m))
    got = {p.pid: p.distance for p in meshes.cloud_to_mesh(cloud, faces).collect()}
    t = np.array(cells).transpose(1, 2, 0)[:, :, None, :]
    plain = np.sqrt(meshes.triangle_distance2(points.T[:, :, None], *t).min(1))
    assert [got[k] for k in range(600)] == pytest.approx(plain.tolist(), abs=1e-9)
    assert sum(asked) < 300 * 4  # of more than 48 tiles
    near = {p.pid: p.distance for p in meshes.cloud_to_mesh(cloud, faces, 0.5).collect()}
    assert near == {k: v for k, v in got.items() if v <= 0.5}


def test_idw_deals_its_points(spark):
    """All points of one file were one task."""
    r = np.random.default_rng(8)
    v, p = r.uniform(0, 10, (5000, 3)), r.uniform(0, 10, (2500, 2))
    p[7], v[11] = v[3, :2], (*v[3, :2], 1.0)
    vertices = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(v)], "vid long, x double, y double, z double")
    points = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "pid long, x double, y double").coalesce(1)
    d2 = (p[:, 0, None] - v[:, 0]) ** 2 + (p[:, 1, None] - v[:, 1]) ** 2
    for power in (2.0, 3.0):
        found = terrain.idw(points, vertices, power)
        assert found.rdd.getNumPartitions() == 3
        with np.errstate(all="ignore"):
            w = d2 ** (-power / 2)
            plain = (w @ v[:, 2]) / w.sum(1)
        plain[7] = v[3, 2]
        got = {q.pid: q.z for q in found.collect()}
        assert [got[k] for k in range(2500)] == pytest.approx(plain.tolist())


def test_register_reads_written_clouds(spark, monkeypatch):
    """Each round read the clouds some ten times from the tables that they come from."""
    r = np.random.default_rng(2)
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(r.uniform(0, 5, (50, 3)))], "pid long, x double, y double, z double")
    seen, nearest = [], registration.nearest
    monkeypatch.setattr(registration, "nearest", lambda a, b: seen.append((a.inputFiles(), b.inputFiles())) or nearest(a, b))
    got = registration.register(registration.moved(cloud, np.eye(3), np.full(3, 0.01)), cloud, rounds=1)
    assert np.allclose(got.shift, -0.01)
    assert len(seen) == 2 and all(a and b for a, b in seen)
