"""Random samples by what they must hold, and sight over a ridge."""

import collections
import itertools
import math

import numpy as np
import pytest

from cragspan.operators import cloud as c
from cragspan.operators import sampling, terrain, triangulate, visibility
from cragspan.plans import every as queries


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(6)
    dense = r.uniform(0, 1, (300, 3))
    return [(int(k), *map(float, p)) for k, p in enumerate(np.concatenate([dense, r.uniform(0, 10, (300, 3))]))]


@pytest.fixture(scope="module")
def cloud(spark, points):
    return spark.createDataFrame(points, "pid long, x double, y double, z double").repartition(4)


def test_samples_hold_what_they_must(cloud, points):
    at = {p[0]: p[1:] for p in points}
    cells = collections.defaultdict(set)
    for k, (x, y, z) in at.items():
        cells[x // 2, y // 2, z // 2].add(k)
    got = c.voxel_random(cloud, 2.0, 7).collect()
    assert len(got) == len(cells) and all(r.pid in cells[r.vx, r.vy, r.vz] for r in got)
    assert {r.pid for r in got} == {r.pid for r in c.voxel_random(cloud.repartition(7), 2.0, 7).collect()} != {r.pid for r in c.voxel_random(cloud, 2.0, 8).collect()}

    flat = collections.defaultdict(set)
    for k, (x, y, _) in at.items():
        flat[x // 2, y // 2].add(k)
    took = collections.defaultdict(set)
    for r in sampling.stratified_random(cloud, 2.0, 3, 1).collect():
        took[r.vx, r.vy].add(r.pid)
    assert set(took) == set(flat) and all(len(took[k]) == min(3, len(flat[k])) and took[k] <= flat[k] for k in flat)

    some = {r.pid for r in c.random_sample(cloud, 0.17, 5).collect()}
    assert len(some) == round(600 * 0.17) and some <= set(at)
    assert some == {r.pid for r in c.random_sample(cloud.repartition(3), 0.17, 5).collect()}


def test_density_sample_thins_dense_parts(cloud, points):
    got = {r.pid for r in sampling.density_sample(cloud, 5.0, 0.4, least=0.05).collect()}
    dense, thin = sum(k < 300 for k in got), sum(k >= 300 for k in got)
    assert 10 <= dense <= 60 and thin >= 280


def test_sight_over_a_ridge(spark):
    """A ridge along x = 5 between two plains: the sides see themselves, and each other only from high up."""
    v = spark.createDataFrame([(k, float(x), float(y), 4.0 if x == 5 else 0.0) for k, (x, y) in enumerate(itertools.product(range(11), range(5)))], "vid long, x double, y double, z double")
    faces = terrain.corners(v, triangulate.delaunay(v))
    posts = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.5), (3, 8.0, 2.0), (4, 9.5, 1.0), (5, 99.0, 0.0)], "pid long, x double, y double")
    low = {(r.a, r.b): r.visible for r in visibility.intervisibility(posts, faces, 20.0, 1.0, 40, 2.0).collect()}
    assert low == {(a, b): (a < 3) == (b < 3) for a, b in itertools.combinations((1, 2, 3, 4), 2)}
    assert all(r.visible for r in visibility.intervisibility(posts, faces, 20.0, 9.0, 40, 2.0).collect())
    assert {(r.a, r.b) for r in visibility.network(posts, faces, 20.0, 1.0, 40, 2.0).collect()} == {(1, 2), (3, 4)}
    seen = {r.pid: r.visible for r in visibility.viewshed((0.0, 2.0, 1.5), posts, faces, 0.5, 40, 2.0).collect()}
    assert seen == {1: True, 2: True, 3: False, 4: False}


def test_points_spread_from_few_rays_are_never_broadcast(spark, capsys):
    """Samples along rays were taken for one row a ray, and broadcast with all of them."""
    v = spark.createDataFrame([(k, float(x), float(y), 0.0) for k, (x, y) in enumerate(itertools.product(range(3), range(3)))], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 4), (1, 4, 8, 5)], "tid long, v0 long, v1 long, v2 long")
    rays = spark.createDataFrame([(1, 0.1, 0.1, 1.0, 0.9, 0.9, 1.0)], "ray long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    found = visibility.line_of_sight(rays, terrain.corners(v, faces), 10, 1.0)
    found.explain()
    joins = capsys.readouterr().out.split("BroadcastHashJoin [")[1:]
    assert not [j for j in joins if j.startswith(("cx", "ray", "pid"))]
    assert [r.visible for r in found.collect()] == [True]


def test_sights_are_followed_once_a_place(spark, monkeypatch):
    """Posts at one place each had their own sights: the samples grew with the square of their number."""
    v = spark.createDataFrame([(k, float(x), float(y), 4.0 if x == 5 else 0.0) for k, (x, y) in enumerate(itertools.product(range(11), range(5)))], "vid long, x double, y double, z double")
    faces = terrain.corners(v, triangulate.delaunay(v))
    posts = spark.createDataFrame([(k, (1.0, 3.0, 9.5)[k % 3], 2.0 + 0.25 * (k % 3)) for k in range(60)], "pid long, x double, y double")
    rays, sight = [], visibility.line_of_sight
    monkeypatch.setattr(visibility, "MEMBERS", 7)
    monkeypatch.setattr(visibility, "line_of_sight", lambda r, *a: rays.append(r.count()) or sight(r, *a))
    got = visibility.intervisibility(posts, faces, 20.0, 1.0, 40, 2.0).collect()
    assert sorted((r.a, r.b) for r in got) == list(itertools.combinations(range(60), 2))
    assert all(r.visible == ((r.a % 3 == 2) == (r.b % 3 == 2)) for r in got)
    assert rays == [9]


def test_all_posts_are_paired_however_far_apart(spark, monkeypatch):
    """Only posts within a reach were paired, which on larger grids were those of one place."""
    v = spark.createDataFrame([(k, float(x), float(y), 4.0 if x == 5 else 0.0) for k, (x, y) in enumerate(itertools.product(range(11), range(5)))], "vid long, x double, y double, z double")
    faces = terrain.corners(v, triangulate.delaunay(v))
    places = [(0.5, 0.5), (2.0, 3.5), (4.25, 1.0), (6.5, 2.0), (8.0, 3.25), (9.75, 0.25), (9.5, 3.5)]
    posts = [(k, *places[k * 3 % 7]) for k in range(25)] + [(90, 99.0, 0.0), (91, math.nan, 1.0), (92, None, 1.0)]
    table = spark.createDataFrame(posts, "pid long, x double, y double").repartition(3)
    monkeypatch.setattr(visibility, "PLACES", 2)  # several blocks
    monkeypatch.setattr(visibility, "MEMBERS", 2)
    got = visibility.intervisibility(table, faces, None, 1.0, 40, 2.0).collect()
    assert sorted((r.a, r.b) for r in got) == list(itertools.combinations(range(25), 2))
    side = {k: x < 5 for k, x, _ in posts[:25]}
    assert all(r.visible == (side[r.a] == side[r.b]) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, visibility.intervisibility(table, faces, 50.0, 1.0, 40, 2.0).collect()))
    assert visibility.intervisibility(table.where("pid > 80"), faces, None, 1.0, 40, 2.0).count() == 0


def test_the_query_pairs_all_posts(spark):
    """It returned 941 of the 4,950 pairs."""
    n = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    rows = queries.QUERIES["intervisibility"](spark, "/root/testdata/sf0.01").collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == n * (n - 1) // 2
