"""Delta Lloyd rounds against plain ones."""

import hashlib
import math

import numpy as np
import pytest

from cragspan.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster int, q string, distance double"


def plain(rows, clusters=16, rounds=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid) of every kept row, whole numbers throughout."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [q for _, q in order[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        held = {}
        for _, q in kept:
            held.setdefault(nearest(q)[1], []).append(q)
        at = [[sum(col) // len(held[k]) for col in zip(*held[k], strict=True)] if k in held else c for k, c in enumerate(at)]
    last = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = {}
    for _, k, d in last:
        inertia[k] = inertia.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in last), key=str)


def run(spark, rows, **options):
    got = clustering.cluster(spark.createDataFrame([(i, v, 3, "x", 1.5) for i, v in rows], SCHEMA), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(seed, n, scale=1.0):
    r = np.random.default_rng(seed)
    centre = r.normal(0, scale, (9, 64))
    return [(int(i), (centre[i % 9] + r.normal(0, scale / 3, 64)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "scale", "options"), [(300, 0.2, {}), (300, 0.2, {"clusters": 5, "rounds": 6}), (40, 300_000.0, {}), (7, 1.0, {}), (1, 1.0, {})])
def test_rounds(spark, n, scale, options):
    rows = vectors(n, n, scale)
    assert run(spark, rows, **options) == plain(rows, **options)


def test_odd_rows(spark):
    rows = vectors(5, 60)
    one = rows[3][1]
    rows += [(3, one), (3, one), (None, one), (None, rows[4][1]), (900, None), (901, []), (902, one[:63]), (903, [*one, 0.0]), (904, [None, *one[1:]]), (905, [math.nan, *one[1:]]), (906, [-math.inf, *one[1:]]), (907, [-0.0] * 64), (908, [-1e-300] * 64)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[-4:-2]) == [] == run(spark, [])
    with pytest.raises(Exception, match="too large"):
        run(spark, [*rows, (9, [1e30] * 64)])


def test_ties_and_one_very_common_vector(spark):
    rows = [(i, [float(i % 4)] * 64) for i in range(200)] + [(1000 + i, [2.0] * 64) for i in range(2000)]
    assert run(spark, rows) == plain(rows)


def test_moves_agree_with_whole_assignments():
    """Comparing with moved centroids only gives what comparing with all gives, ties included."""
    r = np.random.default_rng(8)
    q = r.integers(-2, 3, (500, 4))
    at = r.integers(-2, 3, (6, 4))
    cluster, distance = clustering.reassign(q, np.full(500, -1), np.zeros(500, np.int64), at, np.ones(6, bool))
    for _ in range(20):
        moved = r.random(6) < 0.4
        at = np.where(moved[:, None], r.integers(-2, 3, (6, 4)), at)
        cluster, distance = clustering.reassign(q, cluster, distance, at, moved)
        whole = ((q[:, None] - at) ** 2).sum(2)
        assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()
