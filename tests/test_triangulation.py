"""Triangulations: empty circles, Euler's count, and tiles against one piece."""

import math
import random

import numpy as np
import pytest

from cragspan.operators import constrained, ground, triangulate
from cragspan.operators.predicates import in_circle, turn
from cragspan.plans import queries as q


def whole(points):
    """Triangles of (vid, x, y) in one piece, corners turning left, the least id first."""
    order = sorted(points, key=lambda p: (p[1], p[2]))
    t, _ = triangulate.Mesh([(x, y, k) for k, (_, x, y) in enumerate(order)]).triangles()
    out = []
    for tri in t.tolist():
        ids = [order[k][0] for k in tri]
        k = ids.index(min(ids))
        out.append(tuple(ids[k:] + ids[:k]))
    return sorted(out)


def cloud(kind, n=700):
    r = random.Random(kind)
    if kind == "grid":
        return [(k, float(k % 26), float(k // 26)) for k in range(n)]
    if kind == "clusters":
        return [(k, *((r.gauss(0, 1e-4), r.gauss(0, 1e-4)) if k % 3 else (r.uniform(-9, 9), r.uniform(0, 99)))) for k in range(n)]
    if kind == "circle":
        return [(k, math.cos(k), math.sin(k)) for k in range(60)]
    if kind == "line":
        return [(k, float(k), 2.0 * k) for k in range(40)]
    return [(k, r.random(), r.random()) for k in range(n)]


@pytest.mark.parametrize("kind", ["uniform", "grid", "clusters", "circle", "line"])
def test_pieces(kind):
    points = cloud(kind, 150)
    tri = whole(points)
    at = {p[0]: (p[1], p[2], k) for k, p in enumerate(sorted(points, key=lambda p: (p[1], p[2])))}
    for t in tri:
        corners = [at[v] for v in t]
        assert turn(*corners) > 0
        assert not any(in_circle(*corners, at[v]) for v in at if v not in t)
    assert len(tri) == (0 if kind == "line" else 2 * len(points) - 2 - triangulate.hull_size(tri))


@pytest.mark.parametrize("kind", ["grid", "clusters", "circle", "line"])
def test_tiles_agree_with_one_piece(spark, kind):
    points = cloud(kind)
    rows = [(v, x, y, 0.0) for v, x, y in points]
    rows += [(10**6, points[5][1], points[5][2], 1.0), (10**6 + 1, math.nan, 0.0, 0.0), (10**6 + 2, math.inf, 0.0, 0.0), (10**6 + 3, None, 0.0, 0.0), (None, 0.5, 0.5, 0.0)]
    table = spark.createDataFrame(rows, "vid long, x double, y double, z double").repartition(3)
    got = triangulate.delaunay(table, 40)
    assert sorted((r.v0, r.v1, r.v2) for r in got.collect()) == whole(points)
    assert got.select("tid").distinct().count() == got.count()


def test_too_few_places(spark):
    for rows in ([], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0)]):
        assert triangulate.delaunay(spark.createDataFrame(rows, "vid long, x double, y double")).count() == 0


def test_events(spark):
    points = q.event_cloud(spark, "/root/testdata/sf0.001").select("pid", "x", "y").collect()
    least = {}
    for p in points:
        least[p.x, p.y] = min(p.pid, least.get((p.x, p.y), p.pid))
    got = triangulate.delaunay(q.event_cloud(spark, "/root/testdata/sf0.001").withColumnRenamed("pid", "vid"), 200)
    assert sorted((r.v0, r.v1, r.v2) for r in got.collect()) == whole([(v, x, y) for (x, y), v in least.items()])


def test_predicates_are_exact():
    a, b = (0.1, 0.1, 0), (0.3, 0.3, 1)
    assert turn(a, b, (0.5, 0.5, 2)) == 0 and turn(a, b, (0.5, math.nextafter(0.5, 1), 2)) == 1
    corners = [(0.0, 0.0, 3), (1.0, 0.0, 1), (1.0, 1.0, 2)]
    inside = [in_circle(*corners, (0.0, 1.0, k)) for k in (0, 5)]
    assert inside[0] is False and isinstance(inside[1], bool)
    assert in_circle(*corners, (math.nextafter(0.0, 1), 1.0, 0)) and not in_circle(*corners, (math.nextafter(0.0, -1), 1.0, 5))
    assert np.isfinite(turn((1e300, 1e300, 0), (-1e300, 1.0, 1), (0.0, 1e-300, 2)))


def proper(a, b, c, d):
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def lawful(at, tri, constraints):
    """Every constraint is an edge, all turn left, and no corner over an edge that is no constraint lies in the circle."""
    apex = {}
    for t in tri:
        assert turn(*[at[v] for v in t]) > 0
        for k in range(3):
            e = (t[k], t[(k + 1) % 3])
            assert e not in apex
            apex[e] = t[(k + 2) % 3]
    for a, b in constraints:
        assert (a, b) in apex or (b, a) in apex, (a, b)
    for (a, b), c in apex.items():
        d = apex.get((b, a))
        if d is not None and (a, b) not in constraints and (b, a) not in constraints:
            assert not in_circle(at[a], at[b], at[c], at[d])


@pytest.mark.parametrize("kind", ["grid", "clusters"])
def test_constraints(spark, kind):
    points = cloud(kind, 300)
    table = spark.createDataFrame([(v, x, y, 0.0) for v, x, y in points], "vid long, x double, y double, z double")
    at = {v: (x, y, (x, y)) for v, x, y in points}
    r = random.Random(5)
    chosen = []
    for _ in range(400):
        a, b = r.sample(sorted(at), 2)
        on = any(turn(at[a], at[b], at[v]) == 0 and min(at[a][:2], at[b][:2]) < at[v][:2] < max(at[a][:2], at[b][:2]) for v in at if v not in (a, b))
        if not on and not any(proper(at[a], at[b], at[c], at[d]) for c, d in chosen):
            chosen.append((a, b))
    chosen = chosen[:25]
    first = triangulate.delaunay(table, 100)
    wanted = spark.createDataFrame([*chosen, (chosen[0][1], chosen[0][0]), (3, 3)], "a long, b long")
    tri = [(t.v0, t.v1, t.v2) for t in constrained.constrain(table, first, wanted).collect()]
    assert len(tri) == first.count()
    lawful(at, tri, set(chosen))


def test_constraints_through_vertices_and_across(spark):
    points = cloud("grid", 130)
    table = spark.createDataFrame([(v, x, y, 0.0) for v, x, y in points], "vid long, x double, y double, z double")
    at = {v: (x, y, (x, y)) for v, x, y in points}
    first = triangulate.delaunay(table, 40)
    tri = [(t.v0, t.v1, t.v2) for t in constrained.constrain(table, first, spark.createDataFrame([(0, 4), (0, 26 * 2 + 4), (5, 26 * 4 + 6)], "a long, b long")).collect()]
    assert len(tri) == first.count()
    lawful(at, tri, {(0, 1), (1, 2), (2, 3), (3, 4), (0, 28), (28, 56), (5, 109 + 1)})
    with pytest.raises(Exception, match="cross"):
        constrained.constrain(table, first, spark.createDataFrame([(0, 57), (55, 3)], "a long, b long"))
    with pytest.raises(ValueError, match="not there"):
        constrained.constrain(table, first, spark.createDataFrame([(0, 9999)], "a long, b long"))
    assert constrained.constrain(table, first, spark.createDataFrame([], "a long, b long")).count() == first.count()


def test_constraints_that_share_triangles_are_dealt_to_squares(spark, monkeypatch):
    points = cloud("uniform", 240)
    table = spark.createDataFrame([(v, x, y, 0.0) for v, x, y in points], "vid long, x double, y double, z double")
    at = {v: (x, y, (x, y)) for v, x, y in points}
    chosen = []
    for strip in range(4):  # each zigzag shares triangles with itself and the next: one group by what they share
        chain = sorted((v for v, _, y in points if v % 2 == 0 and int(y * 4) == strip), key=lambda v: at[v][:2])
        chosen += zip(chain, chain[1:], strict=False)
    claimed = []

    def kept(df, name):
        out = triangulate.materialise(df, name)
        if name == "triangles-claimed":
            claimed.append(out)
        return out

    monkeypatch.setattr(constrained, "materialise", kept)
    first = triangulate.delaunay(table, 100)
    wanted = spark.createDataFrame(chosen, "a long, b long")
    whole_, dealt = (sorted((t.v0, t.v1, t.v2) for t in constrained.constrain(table, first, wanted, most).collect()) for most in (10**6, 40))
    assert dealt == whole_ and len(dealt) == first.count()
    lawful(at, dealt, set(chosen))
    one, *rounds = [[r["count"] for r in c.groupBy("i", "j").count().collect()] for c in claimed]
    assert len(one) == 1 and one[0] > 100  # in one square all of them
    assert len(rounds) > 1 and max(map(len, rounds)) > 1 and max(map(max, filter(None, rounds))) <= 40


def test_break_lines(spark):
    points = cloud("uniform", 120)
    table = spark.createDataFrame([(v, x, y, x) for v, x, y in points], "vid long, x double, y double, z double")
    rows = [(1, k, 0.1 + 0.2 * k, 0.5, 5.0, True) for k in range(5)] + [(2, k, 0.45, 0.1 + 0.26 * k, 7.0, True) for k in range(4)]
    rows += [(3, 0, points[7][1], points[7][2], 9.0, False), (3, 1, 0.33, 0.77, 9.0, False), (4, 0, 0.9, 0.9, 1.0, True)]
    lines = spark.createDataFrame(rows, "line int, seq int, x double, y double, z double, hard boolean")
    vertices, triangles, edges = constrained.enforce(table, lines)
    at = {r.vid: (r.x, r.y, (r.x, r.y)) for r in vertices.collect()}
    assert len(at) == 120 + 5 + 4 + 1 + 1 + 1 and len({p[:2] for p in at.values()}) == len(at)
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert len(pairs) == 5 + 4  # a step of each is cut
    lawful(at, [(t.v0, t.v1, t.v2) for t in triangles.collect()], pairs)
    assert {r.vid: r.z for r in vertices.collect()}[7] == points[7][1]


def plain_ground(points, cell, distance, angle, rounds):
    """Points of (pid, x, y, z) that a growing triangulation takes in, in one piece."""
    at = {p[0]: p[1:] for p in points}
    seeds = {}
    for p in sorted(points, key=lambda p: (p[3], p[0])):
        seeds.setdefault((math.floor(p[1] / cell), math.floor(p[2] / cell)), p[0])
    held = set(seeds.values())
    for _ in range(rounds):
        tri = whole([(v, *at[v][:2]) for v in held])
        more = set()
        for v in set(at) - held:
            x, y, z = at[v]
            for t in tri:
                (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (at[k] for k in t)
                d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
                u, w = ((bx - x) * (cy - y) - (by - y) * (cx - x)) / d, ((cx - x) * (ay - y) - (cy - y) * (ax - x)) / d
                if min(u, w, 1 - u - w) < -1e-9:
                    continue
                n = np.cross([bx - ax, by - ay, bz - az], [cx - ax, cy - ay, cz - az])
                if abs(z - (u * az + w * bz + (1 - u - w) * cz)) <= distance and n[2] / np.linalg.norm(n) >= math.cos(math.radians(angle)):
                    more.add(v)
        if not more:
            break
        held |= more
    return held


def test_triangulated_ground(spark):
    r = random.Random(11)
    points = [(k, r.uniform(0, 20), r.uniform(0, 20)) for k in range(400)]
    points = [(k, x, y, 0.1 * x + r.gauss(0, 0.05) + (r.random() < 0.3) * r.uniform(0.5, 4)) for k, x, y in points]
    table = spark.createDataFrame([*points, (900, math.nan, 1.0, 1.0), (901, 1.0, 1.0, None)], "pid long, x double, y double, z double")
    got = {p.pid for p in ground.triangulated_ground(table, 4.0, 0.3, 20.0, 6).collect()}
    assert got == plain_ground(points, 4.0, 0.3, 20.0, 6)
    assert len(plain_ground(points, 4.0, 0.3, 20.0, 1)) < len(got) < 400
    assert ground.triangulated_ground(table.limit(0)).count() == 0


def test_without_spikes(spark):
    points = cloud("uniform", 90)
    table = spark.createDataFrame([(v, x, y, 50.0 if v in (7, 40) else 0.1 * x) for v, x, y in points], "vid long, x double, y double, z double")
    kept, tri = triangulate.without_spikes(table, triangulate.delaunay(table), 20.0)
    assert {r.vid for r in kept.collect()} == set(range(90)) - {7, 40}
    assert sorted((t.v0, t.v1, t.v2) for t in tri.collect()) == whole([p for p in points if p[0] not in (7, 40)])
    with pytest.raises(ValueError):
        triangulate.without_spikes(table.limit(2), tri.limit(0), 1.0).count()
    with pytest.raises(ValueError):
        triangulate.without_spikes(table, tri, 0.0)
