"""Constraints put into a Delaunay triangulation, and break lines enforced on a surface.

Triangles that no constraint passes through stay as they are: their circles are empty.  What a constraint passes through
is taken out, and both sides of it are filled anew, each edge with the vertex whose circle holds no other.  The result
doesn't depend on the order of the constraints, so they are put in by rounds of growing squares: a constraint whose
triangles all have their first corner in one square is put in there, and the squares of a round are independent of each
other.  A square takes in a bounded number of triangles; a constraint that waits is told which new ones it passes through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators.predicates import in_circle, turn
from cragspan.operators.triangulate import delaunay
from cragspan.plans.storage import materialise

#: Relative width by which lines and boxes are widened before the exact test.
MARGIN = 1e-9
#: Triangles, each once for every constraint through it, that the constraints put into one square in one round pass through at most.
SQUARE_HITS = 100_000
#: Cells passed by constraints that one task should compare with the triangles in them.
TASK_CELLS = 500_000
#: Where the squares of a round begin moves on by this part of their side.
SHIFT = 0.618

_CORNERS = [f"{a}{k}" for k in range(3) for a in "xy"]
_FACE = ["v0", "v1", "v2", *_CORNERS]
_FACE_TYPES = ", ".join([*[f"v{k} long" for k in range(3)], *[f"{c} double" for c in _CORNERS]])


class Patch:
    """Triangles of one group: the corner over each directed edge, and the edges that face each corner."""

    def __init__(self, points: dict[int, tuple], triangles: list[tuple[int, int, int]]) -> None:
        self.p = points
        self.apex: dict[tuple[int, int], int] = {}
        self.facing: dict[int, set[tuple[int, int]]] = {}
        self.fixed: set[tuple[int, int]] = set()
        for t in triangles:
            self._add(*t)

    def _add(self, a: int, b: int, c: int) -> None:
        for u, v, w in ((a, b, c), (b, c, a), (c, a, b)):
            self.apex[u, v] = w
            self.facing.setdefault(w, set()).add((u, v))

    def _drop(self, a: int, b: int, c: int) -> None:
        for u, v, w in ((a, b, c), (b, c, a), (c, a, b)):
            del self.apex[u, v]
            self.facing[w].discard((u, v))

    def _turn(self, a: int, b: int, c: int) -> int:
        return turn(self.p[a], self.p[b], self.p[c])

    def insert(self, a: int, b: int) -> None:
        """Makes a-b an edge, or several if it passes through vertices."""
        while a != b:
            a = self._insert_upto(a, b)

    def _insert_upto(self, a: int, b: int) -> int:
        """The part of a-b from a to the first vertex on it, which is returned."""
        for u, v in self.facing.get(a, ()):
            for w in (u, v):  # an edge along the constraint
                if w == b or (not self._turn(a, b, w) and self._ahead(a, b, w)):
                    self.fixed.add((min(a, w), max(a, w)))
                    return w
        gate = next(((u, v) for u, v in self.facing.get(a, ()) if self._turn(a, b, u) < 0 < self._turn(a, b, v)), None)
        if gate is None:  # nothing is crossed before the next vertex on the line, which other groups may hold
            return self._next_on_line(a, b)
        right, left = gate
        rights, lefts, gone = [right], [left], [(right, left, a)]
        while True:
            if (min(right, left), max(right, left)) in self.fixed:
                raise ValueError(f"constraints cross at the edge {right}-{left}")
            c = self.apex.get((left, right))
            if c is None:
                raise ValueError(f"the constraint {a}-{b} crosses another one or leaves the triangulated region")
            gone.append((left, right, c))
            side = self._turn(a, b, c)
            if not side:
                break
            if side > 0:
                left = c
                lefts.append(c)
            else:
                right = c
                rights.append(c)
        for t in gone:
            self._drop(*t)
        self._fill(a, c, lefts)
        self._fill(c, a, rights[::-1])
        self.fixed.add((min(a, c), max(a, c)))
        return c

    def _ahead(self, a: int, b: int, w: int) -> bool:
        (ax, ay), (bx, by), (wx, wy) = (self.p[k][:2] for k in (a, b, w))
        return (min(ax, bx), min(ay, by)) <= (wx, wy) <= (max(ax, bx), max(ay, by)) and (wx > ax) == (bx > ax) and (wy > ay) == (by > ay)

    def _next_on_line(self, a: int, b: int) -> int:
        on = [w for w in self.p if w not in (a, b) and not self._turn(a, b, w) and self._ahead(a, b, w)]
        return min(on, key=lambda w: abs(self.p[w][0] - self.p[a][0]) + abs(self.p[w][1] - self.p[a][1]), default=b)

    def _fill(self, a: int, b: int, chain: list[int]) -> None:
        """Triangles of the polygon left of a-b whose other vertices are ``chain``, from a to b."""
        todo = [(a, b, chain)]
        while todo:
            a, b, chain = todo.pop()
            best = None
            for k, c in enumerate(chain):
                if c not in (a, b) and self._turn(a, b, c) > 0 and (best is None or in_circle(self.p[a], self.p[b], self.p[chain[best]], self.p[c])):
                    best = k
            if best is None:
                continue
            c = chain[best]
            self._add(a, b, c)
            todo += [(a, c, chain[:best]), (c, b, chain[best + 1 :])]

    def triangles(self) -> list[tuple[int, int, int]]:
        return [(u, v, w) for (u, v), w in self.apex.items() if u < v and u < w]


def _box(points: list[Column]) -> list[Column]:
    return [f(*[p[a] for p in points]) for a in ("x", "y") for f in (F.least, F.greatest)]


def _levels(table: DataFrame, box: list[Column], base: float) -> DataFrame:
    """Rows once for each of the two by two cells at most that their boxes touch in the grid of their own size."""
    side = F.greatest(box[1] - box[0], box[3] - box[2], F.lit(base))
    sized = table.withColumn("level", F.ceil(F.log2(side / base)).cast("int"))
    cell = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    for name, low, high in (("i", box[0], box[1]), ("j", box[2], box[3])):
        sized = sized.withColumn(name, F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    return sized


def _along(segments: DataFrame, levels: list[int], base: float) -> DataFrame:
    """Segments (pa, pb) once for each cell (i, j) that they pass, column by column, in the grids of all ``levels``.

    ``rows`` are the least and greatest j of the column, ``rows_before`` those of the column before, null if it isn't passed.
    """
    cell = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    wide = segments.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    first, last = F.least("pa.x", "pb.x"), F.greatest("pa.x", "pb.x")
    wide = wide.withColumn("i", F.explode(F.sequence(F.floor(first / cell), F.floor(last / cell))))

    def y_at(x: Column) -> Column:
        share = F.coalesce(F.try_divide(F.greatest(first, F.least(last, x)) - F.col("pa.x"), F.col("pb.x") - F.col("pa.x")), F.lit(0.0))
        return F.col("pa.y") + share * (F.col("pb.y") - F.col("pa.y"))

    upright = F.col("pa.x") == F.col("pb.x")
    margin = MARGIN * cell

    def rows(i: Column) -> Column:
        ends = [F.when(upright, F.col(p)).otherwise(y_at(x)) for p, x in (("pa.y", i * cell), ("pb.y", (i + 1) * cell))]
        return F.struct(F.floor((F.least(*ends) - margin) / cell).alias("least"), F.floor((F.greatest(*ends) + margin) / cell).alias("most"))

    wide = wide.withColumn("rows", rows(F.col("i"))).withColumn("rows_before", F.when(F.col("i") > F.floor(first / cell), rows(F.col("i") - 1)))
    return wide.withColumn("j", F.explode(F.sequence("rows.least", "rows.most")))


def _astride(a: str, b: str, points: list[str]) -> Column:
    """False only where all ``points`` lie on one side of the line a-b for certain."""
    dx, dy = F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y")
    sides = [dx * (F.col(f"{p}.y") - F.col(f"{a}.y")) - dy * (F.col(f"{p}.x") - F.col(f"{a}.x")) for p in points]
    slack = MARGIN * (F.abs(dx) + F.abs(dy)) * F.greatest(*[F.abs(F.col(f"{p}.{c}")) for p in (a, b, *points) for c in "xy"], F.lit(1e-300))
    return (F.least(*sides) <= slack) & (F.greatest(*sides) >= -slack)


def _passes(a: tuple, b: tuple, c: list[tuple]) -> bool:
    """Whether the open segment a-b passes through the open triangle ``c``; its ends are vertices."""
    for k in range(3):
        u, v = c[k], c[(k + 1) % 3]
        if a in (u, v) or b in (u, v):
            continue
        if turn(a, b, u) * turn(a, b, v) < 0 and turn(u, v, a) * turn(u, v, b) < 0:
            return True
    return False


def crossed(faces: DataFrame, segments: DataFrame) -> DataFrame:
    """``(cid, v0.., x0, y0..)``: the ``faces(tid, v0.., p0..)`` that each of ``segments(cid, pa, pb)`` passes through, exactly."""
    box = _box([F.col(f"p{k}") for k in range(3)])
    extent = faces.agg(F.avg(F.greatest(box[1] - box[0], box[3] - box[2]))).first()[0]
    sized = _levels(faces, box, extent or 1.0)
    cell = F.lit(extent or 1.0) * F.pow(F.lit(2.0), F.col("level"))
    first = [F.floor(low / cell).alias(c) for low, c in ((box[0], "first_i"), (box[2], "first_j"))]
    celled = materialise(sized.select("*", *first, F.floor(box[3] / cell).alias("last_j")), "faces")
    levels = sorted(r[0] for r in celled.select("level").distinct().collect())  # one a doubling of size
    n, reach = segments.agg(F.count("*"), F.avg(F.greatest(F.abs(F.col("pb.x") - F.col("pa.x")), F.abs(F.col("pb.y") - F.col("pa.y"))))).first()
    passed = n * (2 * len(levels) + 4 * (reach or 0.0) / (extent or 1.0))  # cells, about
    parts = max(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(passed // TASK_CELLS) + 1)
    key = ["level", "i", "j"]
    met = _along(segments, levels, extent or 1.0).repartition(parts, *key).join(celled.repartition(parts, *key), key)
    # a pair that meets in several cells counts in the first: the lowest of its column, unless it met in the column before
    lowest = F.col("j") == F.greatest("rows.least", "first_j")
    met_before = (F.col("i") > F.col("first_i")) & F.col("rows_before").isNotNull() & (F.col("rows_before.least") <= F.col("last_j")) & (F.col("rows_before.most") >= F.col("first_j"))
    near = met.where(lowest & ~met_before & _astride("pa", "pb", ["p0", "p1", "p2"]))
    ends = [F.col(f"p{v}.{a}").alias(f"{v}{a}") for v in "ab" for a in "xy"]
    flat = near.select("cid", "v0", "v1", "v2", *[F.col(f"p{k}.{a}").alias(f"{a}{k}") for k in range(3) for a in "xy"], *ends)

    def exact(batches):
        for b in batches:
            at = [list(zip(b[x].tolist(), b[y].tolist(), strict=True)) for x, y in (("ax", "ay"), ("bx", "by"), *[(f"x{k}", f"y{k}") for k in range(3)])]
            yield b.loc[[_passes(p, q, c) for p, q, *c in zip(*at, strict=True)], ["cid", *_FACE]]

    return flat.mapInPandas(exact, f"cid long, {_FACE_TYPES}")


def _refilled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The triangles of one square after its constraints (cid null), in the order of their places, and those that waiting constraints pass through.

    Rows of kind 0 are triangles, of kind 1 constraints to put in (v0 to v1), of kind 2 constraints that wait.
    """
    faces, due, waiting = (frame[frame["kind"] == k] for k in range(3))
    points: dict[int, tuple] = {}
    for part, corners in ((faces, 3), (due, 2)):  # an end past a vertex on the line may have no triangle here
        for k in range(corners):
            points |= {v: (x, y, (x, y)) for v, x, y in zip(part[f"v{k}"].tolist(), part[f"x{k}"].tolist(), part[f"y{k}"].tolist(), strict=True)}
    patch = Patch(points, list(zip(*[faces[f"v{k}"].tolist() for k in range(3)], strict=True)))
    for a, b in sorted(zip(due["v0"].tolist(), due["v1"].tolist(), strict=True), key=lambda e: (points[e[0]][2], points[e[1]][2])):
        patch.insert(a, b)
    t = patch.triangles()
    new = pd.DataFrame(t, columns=["v0", "v1", "v2"], dtype="int64")
    for c in _CORNERS:
        new[c] = np.array([points[f[int(c[1])]]["xy".index(c[0])] for f in t], float)
    x, y = (new[[f"{a}{k}" for k in range(3)]].to_numpy() for a in "xy")
    low, high, reach = (x.min(1), y.min(1)), (x.max(1), y.max(1)), np.maximum(np.abs(x).max(1), np.abs(y).max(1))
    at, cids = [], []
    for cid, *ends in zip(*[waiting[c].tolist() for c in ("cid", "x0", "y0", "x1", "y1")], strict=True):
        a, b = tuple(ends[:2]), tuple(ends[2:])
        near = np.flatnonzero((low[0] <= max(a[0], b[0])) & (high[0] >= min(a[0], b[0])) & (low[1] <= max(a[1], b[1])) & (high[1] >= min(a[1], b[1])))
        side = (b[0] - a[0]) * (y[near] - a[1]) - (b[1] - a[1]) * (x[near] - a[0])
        slack = MARGIN * (abs(b[0] - a[0]) + abs(b[1] - a[1])) * np.maximum(reach[near], 1e-300)
        near = near[(side.min(1) <= slack) & (side.max(1) >= -slack)]
        hit = [f for f in near.tolist() if _passes(a, b, [points[v][2] for v in t[f]])]
        at += hit
        cids += [cid] * len(hit)
    met = new.iloc[at].assign(cid=pd.array(cids, "Int64"))
    return pd.concat([new.assign(cid=pd.array([None] * len(new), "Int64")), met])[["cid", *_FACE]]


def _put_in(hits: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """The triangles ``(v0.., x0, y0..)`` of ``hits(cid, v0.., x0, y0..)`` after the constraints ``lines(cid, v0, v1, x0, y0, x1, y1)``.

    A triangle is named by its edge from the least corner, (v0, v1).
    """
    edge = ["v0", "v1"]
    faces = materialise(hits.select(*_FACE).dropDuplicates(edge), "crossed-faces")
    hits = hits.select("cid", *edge, "x0", "y0")
    side, turn_ = 0.0, 0
    while True:
        n, x0, x1, y0, y1 = hits.agg(F.count("*"), F.min("x0"), F.max("x0"), F.min("y0"), F.max("y0")).first()
        if not n:
            return faces
        extent = max(x1 - x0, y1 - y0)
        if not side:  # of what the mean constraint spans
            spans = hits.groupBy("cid").agg(F.greatest(F.max("x0") - F.min("x0"), F.max("y0") - F.min("y0")).alias("span"))
            side = spans.agg(F.avg("span")).first()[0] or extent
        side, turn_ = 2 * side, turn_ + 1
        whole = n <= most or side >= 2 * extent
        cell = [F.lit(0).cast("long")] * 2 if whole else [F.floor((F.col(a) - F.lit(low)) / F.lit(side) + F.lit(turn_ * SHIFT % 1.0)) for a, low in (("x0", x0), ("y0", y0))]
        each = hits.select("cid", cell[0].alias("i"), cell[1].alias("j")).groupBy("cid").agg(*[f(c).alias(f"{k}_{c}") for c in "ij" for k, f in (("least", F.min), ("most", F.max))], F.count("*").alias("n"))
        inside = each.where("least_i = most_i and least_j = most_j").select("cid", F.col("least_i").alias("i"), F.col("least_j").alias("j"), "n")
        if n > most:  # the first ones of a square, from left to right
            order = Window.partitionBy("i", "j").orderBy("x0", "y0", "cid").rowsBetween(Window.unboundedPreceding, 0)
            inside = inside.join(lines.select("cid", "x0", "y0"), "cid").withColumn("sum", F.sum("n").over(order)).where((F.col("sum") <= most) | (F.col("sum") == F.col("n")))
        ready = materialise(inside.select("cid", "i", "j"), "constraints-ready")
        claimed = materialise(hits.join(ready, "cid").select(*edge, "i", "j").distinct(), "triangles-claimed")
        rest = hits.join(ready, "cid", "left_anti")
        waiting = rest.join(claimed, edge).select("cid", "i", "j").distinct()
        none = [F.lit(None).cast("long").alias("v2"), *[F.lit(None).cast("double").alias(c) for c in ("x2", "y2")]]
        rows = faces.join(claimed, edge).select("i", "j", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cid"), *_FACE)
        for kind, which in ((1, ready), (2, waiting)):
            rows = rows.unionByName(lines.join(which, "cid").select("i", "j", F.lit(kind).alias("kind"), "cid", *edge, "x0", "y0", "x1", "y1", *none))
        fresh = materialise(rows.groupBy("i", "j").applyInPandas(_refilled, f"cid long, {_FACE_TYPES}"), "refilled")
        faces = materialise(faces.join(claimed, edge, "left_anti").select(*_FACE).unionByName(fresh.where("cid is null").select(*_FACE)), "crossed-faces")
        if n <= most:
            return faces
        hits = materialise(rest.join(claimed, edge, "left_anti").select("cid", *edge, "x0", "y0").unionByName(fresh.where("cid is not null").select("cid", *edge, "x0", "y0")), "crossed")


def constrain(vertices: DataFrame, triangles: DataFrame, constraints: DataFrame, square_hits: int = SQUARE_HITS) -> DataFrame:
    """``(tid, v0, v1, v2)``: the constrained Delaunay triangulation from a Delaunay one and ``constraints(a, b)`` between its vertices.

    Every constraint becomes an edge, or several if vertices lie on it; of any two points of a triangle's circle that is not
    hidden by a constraint none is a vertex.  Loops and repeated constraints count once, those with an unknown vertex raise, and so do two that cross.
    ``square_hits`` bounds what one task holds, and not the result.
    """
    flat = vertices.select("vid", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    wanted = constraints.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct()
    named = materialise(wanted.select(F.monotonically_increasing_id().alias("cid"), "a", "b"), "constraints")
    segments = named
    for v in ("a", "b"):
        segments = segments.join(flat.select(F.col("vid").alias(v), F.col("p").alias(f"p{v}")), v, "left")
    segments = materialise(segments.select("cid", "a", "b", "pa", "pb"), "segments")
    if not segments.where("pa is null or pb is null").isEmpty():
        raise ValueError("a constraint names a vertex that is not there")
    if not crossings(segments.withColumnRenamed("cid", "sid")).isEmpty():
        raise ValueError("constraints cross")
    least = F.least("v0", "v1", "v2")
    turned = F.when(F.col("v0") == least, F.array("v0", "v1", "v2")).when(F.col("v1") == least, F.array("v1", "v2", "v0")).otherwise(F.array("v2", "v0", "v1"))
    faces = triangles.select("tid", turned.alias("t")).select("tid", *[F.col("t")[k].cast("long").alias(f"v{k}") for k in range(3)])
    for k in range(3):
        faces = faces.join(flat.select(F.col("vid").cast("long").alias(f"v{k}"), F.col("p").alias(f"p{k}")), f"v{k}")
    hit = materialise(crossed(faces, segments), "crossed")
    lines = segments.select("cid", F.col("a").alias("v0"), F.col("b").alias("v1"), *[F.col(f"p{v}.{a}").alias(f"{a}{k}") for k, v in enumerate("ab") for a in "xy"])
    fresh = _put_in(hit, lines, square_hits).select("v0", "v1", "v2")
    kept = faces.join(hit.select("v0", "v1").distinct(), ["v0", "v1"], "left_anti").select("v0", "v1", "v2")
    return materialise(kept.union(fresh).select(F.monotonically_increasing_id().alias("tid"), "v0", "v1", "v2"), "constrained")


def _met(segments: DataFrame) -> DataFrame:
    """Pairs ``(sid, tid, pa, pb, qa, qb)`` of ``segments(sid, pa, pb)`` that pass a cell together and may cross, the lesser sid first."""
    length = segments.agg(F.avg(F.greatest(F.abs(F.col("pb.x") - F.col("pa.x")), F.abs(F.col("pb.y") - F.col("pa.y"))))).first()[0] or 1.0
    cells = materialise(_along(segments, [0], length).select("sid", "pa", "pb", "i", "j"), "split")
    other = cells.select(F.col("sid").alias("tid"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), "i", "j")
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = cells.repartition(parts, "i", "j").join(other, ["i", "j"]).where("sid < tid")
    apart = [(F.col(f"{p}.x") != F.col(f"{q}.x")) | (F.col(f"{p}.y") != F.col(f"{q}.y")) for p in ("pa", "pb") for q in ("qa", "qb")]
    may = together.where(apart[0] & apart[1] & apart[2] & apart[3] & _astride("pa", "pb", ["qa", "qb"]) & _astride("qa", "qb", ["pa", "pb"]))
    return may.dropDuplicates(["sid", "tid"]).select("sid", "tid", "pa", "pb", "qa", "qb")


def _across(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether the open segments a-b and c-d cross."""
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def crossings(segments: DataFrame) -> DataFrame:
    """Pairs ``(sid, tid)`` of ``segments(sid, pa, pb)`` that cross inside both."""

    def exact(batches):
        for b in batches:
            ends = [b[k].map(lambda p: (p["x"], p["y"])) for k in ("pa", "pb", "qa", "qb")]
            yield b.loc[[_across(*e) for e in zip(*ends, strict=True)], ["sid", "tid"]]

    return _met(segments).mapInPandas(exact, "sid long, tid long")


def split_crossings(segments: DataFrame) -> DataFrame:
    """``segments(sid, pa, pb)`` (places x, y, z) cut where two of them cross: the pieces, each once.

    The place of a crossing is computed from the one of lesser sid, and has its elevation.
    """

    def cut(batches):
        for b in batches:
            out = []
            for s, t, *p in zip(b["sid"], b["tid"], b["pa"], b["pb"], b["qa"], b["qb"], strict=True):
                a, e, c, d = [(v["x"], v["y"]) for v in p]
                if _across(a, e, c, d):
                    u = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / ((e[0] - a[0]) * (d[1] - c[1]) - (e[1] - a[1]) * (d[0] - c[0]))
                    place = {k: p[0][k] + u * (p[1][k] - p[0][k]) for k in "xyz"}
                    out += [(s, place), (t, place)]
            yield pd.DataFrame(out, columns=["sid", "cut"])

    place = "struct<x:double,y:double,z:double>"
    cuts = _met(segments).mapInPandas(cut, f"sid long, cut {place}").groupBy("sid").agg(F.collect_list("cut").alias("cuts"))
    every = segments.join(cuts, "sid", "left")
    from_start = F.transform(F.coalesce("cuts", F.array().cast(f"array<{place}>")), lambda c: F.struct(((c["x"] - F.col("pa.x")) * (F.col("pb.x") - F.col("pa.x")) + (c["y"] - F.col("pa.y")) * (F.col("pb.y") - F.col("pa.y"))).alias("at"), c.alias("p")))
    stops = F.concat(F.array(F.col("pa")), F.transform(F.array_sort(from_start), lambda s: s["p"]), F.array(F.col("pb")))
    walked = every.select("sid", stops.alias("stops")).select("sid", "stops", F.explode(F.sequence(F.lit(0), F.size("stops") - 2)).alias("k"))
    return walked.select("sid", F.get("stops", F.col("k")).alias("pa"), F.get("stops", F.col("k") + 1).alias("pb")).where("pa.x <> pb.x or pa.y <> pb.y")


def enforce(vertices: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(vertices, triangles, edges)``: the surface of ``vertices(vid, x, y, z)`` and of break lines ``lines(line, seq, x, y, z, hard)``.

    The points of all lines become vertices, at a place that is there already the vertex that is there; the pieces of
    hard lines become edges ``(a, b)``.  Hard lines that cross are cut there.  New vertices are numbered after the greatest vid.
    A line of one point adds its point; lines without any give the Delaunay surface.
    """
    def place(a: str) -> Column:
        return F.col(a).cast("double").alias(a)

    points = lines.select("line", "seq", "hard", F.struct(*[place(a) for a in "xyz"]).alias("p"))
    follow = Window.partitionBy("line").orderBy("seq")
    steps = points.withColumn("pb", F.lead("p").over(follow)).where("hard and pb is not null and (p.x <> pb.x or p.y <> pb.y)")
    steps = materialise(steps.select(F.monotonically_increasing_id().alias("sid"), F.col("p").alias("pa"), "pb"), "breakline-steps")
    pieces = materialise(split_crossings(steps), "breakline-pieces")
    new = points.select("p").union(pieces.select("pa")).union(pieces.select("pb")).select("p.*").groupBy("x", "y").agg(F.min("z").alias("z"))
    there = vertices.select("vid", *[place(a) for a in "xyz"])
    new = new.join(there.select("x", "y").distinct(), ["x", "y"], "left_anti")
    top = vertices.agg(F.max("vid")).first()[0]
    added = materialise(new.select((F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)).alias("vid"), "x", "y", "z"), "breakline-points")
    every = materialise(there.union(added), "breakline-vertices")
    ids = every.groupBy("x", "y").agg(F.min("vid").alias("vid"))
    edges = pieces
    for v in ("a", "b"):
        edges = edges.join(ids.select(F.struct("x", "y").alias(f"at_{v}"), F.col("vid").alias(v)), F.struct(f"p{v}.x", f"p{v}.y") == F.col(f"at_{v}"))
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "breakline-edges")
    return every, constrain(every, delaunay(every), edges), edges
