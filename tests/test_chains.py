"""Chained edges by looking ahead, against a walk along them."""

import random

import pytest

from cragspan.operators import lines


def walked(edges):
    """(root, part, place, vid) by walking each connected net."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, seen = [], set()
    for root in sorted(near):
        if root in seen:
            continue
        net, todo = set(), [root]
        while todo:
            v = todo.pop()
            if v not in net:
                net.add(v)
                todo += near[v]
        seen |= net
        own = sorted({(min(a, b), max(a, b)) for a, b in edges if a in net})
        out += [(root, n, k, v) for n, path in enumerate(lines.walk(own)) for k, v in enumerate(path)]
    return sorted(out)


def nets(seed):
    r = random.Random(seed)
    edges = {(k, k + 1) for k in range(100, 140)}  # a long line
    edges |= {(200 + k, 200 + (k + 1) % 17) for k in range(17)}  # a ring
    edges |= {(300, 301), (301, 302), (302, 300)} | {(310, 311), (311, 312), (312, 310), (312, 313), (313, 314), (314, 312)}  # rings that touch
    edges |= {(400, 401), (400, 402), (400, 403), (403, 404)}  # a star
    edges |= {tuple(r.sample(range(500, 530), 2)) for _ in range(28)}
    shuffled = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges]
    return shuffled + shuffled[:5] + [(7, 7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains(spark, seed):
    edges = nets(seed)
    got = lines.chains(spark.createDataFrame(edges, "a long, b long"))
    assert got.columns == ["root", "part", "place", "vid"]
    assert sorted(map(tuple, got.collect())) == walked([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert lines.chains(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rings_are_cut_before_they_are_followed(spark, monkeypatch):
    """Rings were followed until nothing else settled, and their components were sought anew, an arc a node."""
    calls, spread = [], lines.spread_components
    monkeypatch.setattr(lines, "spread_components", lambda *a: calls.append(1) or spread(*a))
    edges = [(k, (k + 1) % 9) for k in range(9)] + [(20, 21), (21, 22)]
    got = lines.chains(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == walked(edges)
    assert len(calls) == 1
