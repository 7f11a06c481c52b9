"""k nearest neighbours on even and uneven clouds against a plain search."""

import math

import numpy as np
import pytest

from cragspan.operators import neighbours


def plain(left, right, k, axes, drop_self):
    out = []
    for i, *p in left:
        d2 = []
        for j, *q in right:
            if not (drop_self and i == j):
                s = (p[0] - q[0]) * (p[0] - q[0])
                for a in range(1, axes):
                    s = s + (p[a] - q[a]) * (p[a] - q[a])
                d2.append((s, j))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(d2)[:k])]
    return sorted(out)


def cloud(kind, n, seed, axes):
    r = np.random.default_rng(seed)
    if kind == "even":
        p = r.uniform(0, 10, (n, axes))
    elif kind == "uneven":  # half of it in one tiny place, some far away, many at one place
        p = np.concatenate([r.normal(3, 1e-5, (n // 2, axes)), r.uniform(-1000, 1000, (n // 4, axes)), np.full((n - n // 2 - n // 4, axes), 7.0)])
    else:  # a lattice, full of ties
        p = np.stack(np.unravel_index(np.arange(n), (8,) * axes if axes == 3 else (40, n)), 1).astype(float)
    return [(int(i), *map(float, x)) for i, x in enumerate(p)]


def table(spark, rows, axes):
    return spark.createDataFrame(rows, "pid long, " + ", ".join(f"{a} double" for a in axes)).repartition(4)


@pytest.mark.parametrize(("kind", "axes"), [("even", "xyz"), ("uneven", "xyz"), ("uneven", "xy"), ("lattice", "xy")])
def test_leaves_agree_with_a_plain_search(spark, monkeypatch, kind, axes):
    monkeypatch.setattr(neighbours, "LEAF", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 50)
    right = cloud(kind, 400, 1, len(axes))
    got = neighbours.knn(table(spark, right, axes), table(spark, right, axes), 4, axes, drop_self=True)
    assert sorted(map(tuple, got.collect())) == plain(right, right, 4, len(axes), True)
    left = [(i + 10_000, *p) for i, *p in cloud("even", 60, 2, len(axes))] + [(5, *([5e3] * len(axes))), (6, *([-0.5] * len(axes)))]
    got = neighbours.knn(table(spark, left, axes), table(spark, right, axes), 3, axes)
    assert sorted(map(tuple, got.collect())) == plain(left, right, 3, len(axes), False)


def test_points_that_are_none(spark):
    rows = [(k, float(k), 0.0, 0.0) for k in range(9)]
    odd = [(90, math.nan, 0.0, 0.0), (91, 1.0, math.inf, 0.0), (92, None, 0.0, 0.0)]
    got = neighbours.knn(table(spark, rows + odd, "xyz"), table(spark, rows + odd, "xyz"), 3, drop_self=True)
    assert sorted(map(tuple, got.collect())) == plain(rows, rows, 3, 3, True)
    assert neighbours.knn(table(spark, odd, "xyz"), table(spark, rows, "xyz"), 2).count() == 0
    few = neighbours.knn(table(spark, rows[:3], "xyz"), table(spark, rows[:3], "xyz"), 5, drop_self=True)
    assert sorted(map(tuple, few.collect())) == plain(rows[:3], rows[:3], 5, 3, True)


@pytest.mark.parametrize(("kind", "axes", "piece"), [("even", "xyz", 200_000), ("uneven", "xyz", 9), ("lattice", "xy", 9)])
def test_radius_counts_agree_with_a_plain_count(spark, monkeypatch, kind, axes, piece):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    monkeypatch.setattr(neighbours, "COUNTED", 50)
    rows = cloud(kind, 400, 3, len(axes))
    odd = [(900, math.nan, *([1.0] * (len(axes) - 1))), (901, math.inf, *([1.0] * (len(axes) - 1))), (902, None, *([1.0] * (len(axes) - 1)))]
    got = neighbours.radius_count(table(spark, rows + odd, axes), 1.0, axes)
    d2 = {i: [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for _, *q in rows] for i, *p in rows}
    assert dict(map(tuple, got.collect())) == {i: sum(d <= 1 for d in v) for i, v in d2.items()}


def test_spread_points_are_never_broadcast(spark, capsys):
    """A side's 27 cells a point were taken for one row a point, and broadcast."""
    few = table(spark, cloud("even", 50, 4, 3), "xyz")
    neighbours.radius_pairs(few, few, 1.0).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_no_pair_at_the_very_radius_is_left_out(spark):
    """Of two points on either side of a whole cell, at the radius but for what rounding takes off, the cells were two apart."""
    ends = [(3.9999999999999996, 8.0), (-1e-20, 4.0), (-4.0, 0.0), (5e6, 5e6 + 4.0), (-5e6 - 1e-9, -5e6 + 4.0)]
    rows = [(2 * k + i, x, 0.25) for k, pair in enumerate(ends) for i, x in enumerate(pair)]
    odd = [(90, math.nan, 0.25), (91, math.inf, 0.25), (92, None, 0.25)]
    for few, radius in ((table(spark, rows, "xy"), 4.0), (table(spark, rows + odd, "xy"), 0.1)):
        got = [tuple(r) for r in neighbours.radius_pairs(few, few, radius, "xy").select("pid", "nid").collect()]
        assert sorted(got) == sorted((i, j) for i, x, _ in rows for j, y, _ in rows if (x - y) * (x - y) <= radius * radius)
