"""Delaunay triangulation by tiles that are merged upwards.

Points fall into the leaves of a quadtree of bounded counts.  A leaf triangulates its own points.  A point whose
triangles all have their circles inside the leaf's square is settled: no point elsewhere can change them, and they
are part of the result.  What goes on to the square of sixteen squares around it are the points that are not settled
and the settled ones next to them; all that the former are joined to in the end is among these, so that triangulating
them alone finds their triangles.  About the square root of the points goes on from each level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.operators import tiles
from cragspan.operators.predicates import in_circle, turn
from cragspan.operators.terrain import spikes
from cragspan.plans.storage import materialise

#: Points of a leaf, unless more fall into a square of the finest grid.
LEAF_POINTS = 4_096
#: Halvings between a square and the next larger one that is triangulated.
STEP = 2


class Mesh:
    """The Delaunay triangulation of points (x, y, rank), sorted by (x, y) and distinct, by division and merging.

    Edges come in pairs e, e ^ 1 of opposite directions; ``after`` and ``before`` go round the edges of one origin.
    """

    def __init__(self, points: list[tuple]) -> None:
        self.p = points
        self.org: list[int] = []
        self.after: list[int] = []
        self.before: list[int] = []
        self.gone: set[int] = set()
        if len(points) > 1:
            self._divide(0, len(points))

    def _edge(self, a: int, b: int) -> int:
        e = len(self.org)
        self.org += [a, b]
        self.after += [e, e + 1]
        self.before += [e, e + 1]
        return e

    def _splice(self, a: int, b: int) -> None:
        an, bn = self.after[a], self.after[b]
        self.after[a], self.after[b] = bn, an
        self.before[bn], self.before[an] = a, b

    def _join(self, a: int, b: int) -> int:
        """A new edge from the end of a to the start of b, with their left face."""
        e = self._edge(self.org[a ^ 1], self.org[b])
        self._splice(e, self.before[a ^ 1])
        self._splice(e ^ 1, b)
        return e

    def _remove(self, e: int) -> None:
        for x in (e, e ^ 1):
            self._splice(x, self.before[x])
        self.gone.add(e & ~1)

    def _turn(self, a: int, b: int, c: int) -> int:
        return turn(self.p[a], self.p[b], self.p[c])

    def _inside(self, a: int, b: int, c: int, d: int) -> bool:
        return d not in (a, b, c) and in_circle(self.p[a], self.p[b], self.p[c], self.p[d])

    def _divide(self, low: int, high: int) -> tuple[int, int]:
        """Triangulates points low..high-1; the hull's edges that leave the first point leftwards and the last one rightwards."""
        org, after, before = self.org, self.after, self.before
        if high - low == 2:
            e = self._edge(low, low + 1)
            return e, e ^ 1
        if high - low == 3:
            a, b = self._edge(low, low + 1), self._edge(low + 1, low + 2)
            self._splice(a ^ 1, b)
            way = self._turn(low, low + 1, low + 2)
            if not way:
                return a, b ^ 1
            c = self._join(b, a)
            return (a, b ^ 1) if way > 0 else (c ^ 1, c)
        middle = (low + high) // 2
        left_out, left_in = self._divide(low, middle)
        right_in, right_out = self._divide(middle, high)
        while True:  # the lower common tangent
            if self._turn(org[right_in], org[left_in], org[left_in ^ 1]) > 0:
                left_in = before[left_in ^ 1]
            elif self._turn(org[left_in], org[right_in ^ 1], org[right_in]) > 0:
                right_in = after[right_in ^ 1]
            else:
                break
        base = self._join(right_in ^ 1, left_in)
        if org[left_in] == org[left_out]:
            left_out = base ^ 1
        if org[right_in] == org[right_out]:
            right_out = base
        while True:  # upwards, an edge between both sides at a time
            frm, to = org[base], org[base ^ 1]
            left, right = after[base ^ 1], before[base]
            left_ok = self._turn(org[left ^ 1], to, frm) > 0
            right_ok = self._turn(org[right ^ 1], to, frm) > 0
            if left_ok:
                while self._inside(to, frm, org[left ^ 1], org[after[left] ^ 1]):
                    left, old = after[left], left
                    self._remove(old)
            if right_ok:
                while self._inside(to, frm, org[right ^ 1], org[before[right] ^ 1]):
                    right, old = before[right], right
                    self._remove(old)
            if not left_ok and not right_ok:
                return left_out, right_out
            if not left_ok or (right_ok and self._inside(org[left ^ 1], org[left], org[right], org[right ^ 1])):
                base = self._join(right, base ^ 1)
            else:
                base = self._join(base ^ 1, left ^ 1)

    def triangles(self) -> tuple[np.ndarray, np.ndarray]:
        """Corners (turning left) of all triangles, and whether each point is on the hull."""
        org, before = np.array(self.org, np.int64), np.array(self.before, np.int64)
        hull = np.zeros(len(self.p), bool)
        if not len(org):
            return np.zeros((0, 3), np.int64), ~hull
        e = np.arange(len(org))
        e = e[~np.isin(e & ~1, np.fromiter(self.gone, np.int64, len(self.gone)))]
        two = before[e ^ 1]
        three = before[two ^ 1]
        corners = np.stack([org[e], org[two], org[three]], 1)
        face = before[three ^ 1] == e
        bent = np.array([self._turn(*c) > 0 for c in corners[face].tolist()], bool)
        face[np.flatnonzero(face)[~bent]] = False
        hull[corners[~face][:, :2]] = True
        kept = face & (e < two) & (e < three)
        return corners[kept], hull


def _circles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of the triangles' circles; those of flat ones are not finite."""
    ax, ay = x[tri[:, 0]], y[tri[:, 0]]
    bx, by, cx, cy = x[tri[:, 1]] - ax, y[tri[:, 1]] - ay, x[tri[:, 2]] - ax, y[tri[:, 2]] - ay
    with np.errstate(all="ignore"):
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, np.hypot(ux, uy) * (1 + 1e-6 + 1e-13 * (bx * bx + by * by + cx * cx + cy * cy) / np.abs(d))


def settle(vid: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(triangles, goes_on, settled)`` of the points of a square: its final triangles as places, the points that the next
    square needs, and which of all are settled now or were (``known``)."""
    order = np.lexsort((y, x))
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    points = list(zip(x[order].tolist(), y[order].tolist(), range(len(x)), strict=True))  # ranks by (x, y), the same in every square
    tri, hull = Mesh(points).triangles()
    tri, hull = order[tri], hull[rank]
    whole = all(map(math.isinf, box))
    cx, cy, r = _circles(x, y, tri)
    inside = (cx - r > box[0]) & (cx + r < box[1]) & (cy - r > box[2]) & (cy + r < box[3])
    open_ = hull.copy()
    open_[tri[~inside]] = True
    settled = known | (np.ones(len(x), bool) if whole else ~open_)
    fresh = settled & ~known
    out = tri[fresh[tri].any(1) & ~known[tri].any(1)]
    due = np.zeros(len(x), bool)
    due[tri[(~settled)[tri].any(1)]] = True
    return out, due | ~settled, settled


def delaunay(vertices: DataFrame, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``(tid, v0, v1, v2)``: the Delaunay triangles of ``vertices(vid, x, y, ...)``, corners turning left, the least id first.

    Of points at one place the least id stands for all; points without finite x and y, or a null id, are left out.  Fewer than three
    places, or places on one line, give no triangle.  Points on one circle are triangulated as the order of their places
    (x, then y) says, so the result is unique.  Points that are all in convex position meet in one task at last.
    """
    spark = vertices.sparkSession
    finite = F.expr("vid is not null and abs(x) < double('inf') and abs(y) < double('inf')")
    places = vertices.where(finite).groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("vid").cast("long").alias("vid"))
    places = materialise(places, "places")
    x0, x1, y0, y1, n = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "tid long, v0 long, v1 long, v2 long")
    size = max(x1 - x0, y1 - y0) or 1.0
    if not math.isfinite(size):
        raise ValueError("the points' extent is too large for 64 bits")
    coded = places.withColumn("code", tiles.interleaved(tiles.cells([F.col("x"), F.col("y")], [x0, y0], size)))
    leaf = materialise(tiles.leaves(coded, leaf_points, n, 2, STEP), "leaves")
    depths = sorted((r[0] for r in leaf.select("depth").distinct().collect()), reverse=True)  # a few, by the grid's bits

    def triangulate(depth: int):
        side = size / (1 << depth)
        last = (1 << depth) - 1
        margin = 1e-9 * size

        def square(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            code = int(key[0])
            i, j = tiles.corner(code, depth, 2)
            box = [(-math.inf if c == 0 else low + c * side + margin, math.inf if c == last else low + (c + 1) * side - margin) for c, low in ((i, x0), (j, y0))]
            frame = frame.sort_values("vid")
            vid, x, y, known = (frame[c].to_numpy() for c in ("vid", "x", "y", "known"))
            tri, on, settled = settle(vid, x, y, known.astype(bool), (*box[0], *box[1]))
            t = vid[tri] if len(tri) else np.zeros((0, 3), np.int64)
            turned = np.argmin(t, 1) if len(t) else np.zeros(0, np.int64)
            t = np.stack([t[np.arange(len(t)), (turned + k) % 3] for k in range(3)], 1) if len(t) else t
            corners = pd.DataFrame({"v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]}, dtype="Int64")
            rest = pd.DataFrame({"vid": vid[on], "x": x[on], "y": y[on], "known": settled[on], "code": np.full(on.sum(), code)})
            return pd.concat([corners, rest]).reindex(columns=["v0", "v1", "v2", "vid", "x", "y", "known", "code"])

        return square

    row = "v0 long, v1 long, v2 long, vid long, x double, y double, known boolean, code long"
    found: list[DataFrame] = []
    rest: DataFrame | None = None
    for depth in range(depths[0], -1, -STEP):
        own = leaf.where(F.col("depth") == depth).select("vid", "x", "y", F.lit(False).alias("known"), F.shiftright("code", 2 * (tiles.BITS[2] - depth)).alias("code"))
        if rest is not None:
            own = own.union(rest.select("vid", "x", "y", "known", F.shiftright("code", 2 * STEP).alias("code")))
        step = materialise(own.groupBy("code").applyInPandas(triangulate(depth), row), "squares")
        found.append(step.where("v0 is not null").select("v0", "v1", "v2"))
        rest = step.where("v0 is null")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return materialise(out.select(F.monotonically_increasing_id().alias("tid"), "v0", "v1", "v2"), "delaunay")


def without_spikes(vertices: DataFrame, triangles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(vertices, triangles)`` without the vertices that ``terrain.spikes`` finds, the others triangulated anew.

    Raises if fewer than three are left, and for a threshold that is not above 0.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    kept = materialise(vertices.join(spikes(vertices, triangles, threshold).select("vid"), "vid", "left_anti"), "without-spikes")
    if kept.limit(3).count() < 3:
        raise ValueError("fewer than three vertices would be left")
    return kept, delaunay(kept)


def hull_size(triangles: Iterator[tuple[int, int, int]]) -> int:
    """Edges with a triangle on one side only."""
    seen: dict[tuple[int, int], int] = {}
    for t in triangles:
        for a, b in itertools.pairwise((*t, t[0])):
            seen[min(a, b), max(a, b)] = seen.get((min(a, b), max(a, b)), 0) + 1
    return sum(n == 1 for n in seen.values())
