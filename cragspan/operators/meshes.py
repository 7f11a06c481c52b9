"""Exact distances from points to the triangles of a mesh, by tiles of bounded counts."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.operators import tiles
from cragspan.operators.neighbours import knn
from cragspan.plans.storage import materialise

#: Triangles of a tile, of a group that shares a box within it, points of a block, points that meet a tile at once, and pairs held at once.
TILE = 512
GROUP = 16
BLOCK = 1_024
QUERIES = 8_192
COMPARED = 32_768
#: Halvings between a node of the tree over the tiles and those below it.
STEP = 2


def _dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])


def triangle_distance2(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances from points to triangles, arrays of x, y and z each; of a degenerate triangle only the corners count."""
    u, v, e, w, h = b - a, c - a, c - b, p - a, p - b
    n = _cross(u, v)
    size = _dot(n, n)

    def to_edge(along: np.ndarray, off: np.ndarray) -> np.ndarray:
        length = _dot(along, along)
        rest = off - np.clip(np.where(length > 0, _dot(off, along) / length, 0.0), 0.0, 1.0) * along
        return _dot(rest, rest)

    with np.errstate(all="ignore"):
        third, second, height = _dot(_cross(u, w), n) / size, _dot(_cross(w, v), n) / size, _dot(w, n)
        edges = functools.reduce(np.minimum, [to_edge(u, w), to_edge(e, h), to_edge(v, w)])
        out = np.where((third >= 0) & (second >= 0) & (second + third <= 1), height * height / size, edges)
    return np.where(size == 0, functools.reduce(np.minimum, [_dot(d, d) for d in (w, h, p - c)]), out)


def least_distance2(at: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """For each of the points (rows of x, y, z) the least squared distance to triangles ``(triangle, corner, axis)``: the group whose box
    is nearest comes first, then those whose boxes are nearer than what it gave."""
    groups = np.concatenate([corners, np.repeat(corners[-1:], -len(corners) % GROUP, 0)]).reshape(-1, GROUP, 3, 3)
    low, high = groups.min((1, 2)), groups.max((1, 2))
    split = np.ascontiguousarray(groups.transpose(2, 3, 0, 1))

    def measure(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for i in range(0, len(rows), COMPARED // GROUP):
            r, g = rows[i : i + COMPARED // GROUP], of[i : i + COMPARED // GROUP]
            parts.append(triangle_distance2(at[r].T[:, :, None], *split[:, :, g]).min(1))
        return np.concatenate(parts)

    best = np.zeros(len(at))
    step = max(1, 8 * COMPARED // len(low))
    for start in range(0, len(at), step):
        rows = np.arange(start, min(start + step, len(at)))
        box = sum(np.maximum(np.maximum(low[:, a] - at[rows, a, None], at[rows, a, None] - high[:, a]), 0) ** 2 for a in range(3))
        first = box.argmin(1)
        best[rows] = measure(rows, first)
        box[np.arange(len(rows)), first] = np.inf
        row, group = np.nonzero(box < best[rows, None])
        np.minimum.at(best, rows[row], measure(rows[row], group))
    return best


def _tiled(table: DataFrame, at: list[Column], most: int) -> tuple[DataFrame, int]:
    """``table`` with ``code`` and ``tile``, and its number of rows; a tile of depth d is named by 1 and the 3 d leading bits of its codes, so that a shift
    by 3 names the one above."""
    placed = materialise(table.withColumns({f"_{k}": v for k, v in enumerate(at)}), "to-tile")
    ends = placed.agg(F.count("*").alias("n"), *[f(f"_{k}").alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return placed, 0
    low = [ends[f"lo{k}"] for k in range(3)]
    size = max(ends[f"hi{k}"] - low[k] for k in range(3)) or 1.0
    grid = tiles.cells([F.col(f"_{k}") for k in range(3)], low, size)
    coded = placed.withColumns({f"_{k}": g for k, g in enumerate(grid)}).withColumn("code", tiles.interleaved([F.col(f"_{k}") for k in range(3)])).drop("_0", "_1", "_2")
    name = F.expr(f"shiftleft(1L, 3 * depth) | shiftright(code, 3 * ({tiles.BITS[3]} - depth))")
    return materialise(tiles.leaves(coded, most, ends["n"], 3, 1).withColumn("tile", name), "tiled"), ends["n"]


def _boxed(table: DataFrame, keys: list[str], low: list[Column], high: list[Column]) -> DataFrame:
    ends = [f(v).alias(f"{n}{x}") for n, f, c in (("lo", F.min, low), ("hi", F.max, high)) for x, v in zip("xyz", c, strict=True)]
    return table.groupBy(*keys).agg(*ends)


def _sum(parts: list[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def _candidates(blocks: DataFrame, leaves: DataFrame, slack: float, cutoff: float | None) -> DataFrame:
    """``(block, tile, box)``: the tiles ``leaves(tile, depth, box)`` that may hold the nearest triangle of a point in one of
    ``blocks(block, box, vx, vy, vz)``, which names a point of the mesh: tiles that are farther than it from all of the block go.

    Squared distances are sums over the axes, along each of which the difference of both is concave between the box's ends: its
    least value is at an end of the block or of the box.  The tree over the tiles is gone down from its root, so that a block meets few of them.
    """
    box = [f"{n}{x}" for n in ("lo", "hi") for x in "xyz"]
    under = F.when(F.col("depth") > 0, F.expr(f"(depth - 1) div {STEP} * {STEP}"))
    ends = [[F.col(f"{n}{x}") for x in "xyz"] for n in ("lo", "hi")]
    named = leaves.withColumn("under", under.cast("int"))
    above = named.where("depth > 0").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("under"), F.lit(STEP)))).withColumn("node", F.expr("shiftright(tile, 3 * (depth - d))"))
    inner = _boxed(above, ["node", "d"], *ends).select("node", F.when(F.col("d") > 0, F.shiftright("node", 3 * STEP)).alias("parent"), F.lit(False).alias("leaf"), *box)
    outer = named.select(F.col("tile").alias("node"), F.expr("shiftright(tile, 3 * (depth - under))").alias("parent"), F.lit(True).alias("leaf"), *box)
    nodes = materialise(inner.union(outer), "mesh-nodes")

    asking = blocks.withColumnsRenamed({k: f"b{k}" for k in box})
    worse, apart = [], []
    for x in "xyz":
        lo, hi, first, last, v = (F.col(k.format(x)) for k in ("lo{}", "hi{}", "blo{}", "bhi{}", "v{}"))
        off = [(t, F.greatest(lo - t, t - hi, F.lit(0.0))) for t in (first, last, F.greatest(first, F.least(last, lo)), F.greatest(first, F.least(last, hi)))]
        worse.append(F.least(*[d * d - (t - v) * (t - v) for t, d in off]))
        gap = F.greatest(lo - last, first - hi, F.lit(0.0))
        apart.append(gap * gap)
    kept = _sum(worse) <= slack
    if cutoff is not None:
        kept &= _sum(apart) <= cutoff * cutoff + slack
    pairs, found = asking.crossJoin(nodes.where("parent is null").drop("parent")), None
    while True:
        met = materialise(pairs.where(kept), "mesh-met")
        step = met.where("leaf").select("block", F.col("node").alias("tile"), *box)
        found = step if found is None else found.union(step)
        wide = met.where("not leaf")
        if wide.isEmpty():
            return found
        pairs = wide.withColumnRenamed("node", "parent").drop("leaf", *box).join(nodes, "parent").drop("parent")


def _visits(asked: DataFrame, mesh: DataFrame) -> DataFrame:
    """``asked(pid, x, y, z, block, tile)`` with ``d2``, the least squared distance to the triangles of the tile; the points of a tile are
    dealt in parts, each with the tile's triangles."""
    sizes = materialise(asked.groupBy("tile").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "mesh-sizes")
    dealt = asked.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("pid", "x", "y", "z"), F.col("parts")).cast("int"))
    shown = mesh.join(sizes, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [f"{k}{x}" for k in "abc" for x in "xyz"]

    def search(points: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return points.assign(d2=0.0)[columns]
        corners = faces.sort_values("code")[names].to_numpy(float).reshape(-1, 3, 3)
        return points.assign(d2=least_distance2(points[list("xyz")].to_numpy(float), corners))[columns]

    kind = f"pid {dict(asked.dtypes)['pid']}, x double, y double, z double, block long, tile long, d2 double"
    columns = [c.split()[0] for c in kind.split(", ")]
    keys = ["tile", "part"]
    return dealt.select(*keys, "pid", *"xyz", "block").groupBy(*keys).cogroup(shown.select(*keys, "code", *names).groupBy(*keys)).applyInPandas(search, kind)


def cloud_to_mesh(cloud: DataFrame, faces: DataFrame, cutoff: float | None = None) -> DataFrame:
    """``(pid, distance)`` to the nearest of ``faces (tid, p0, p1, p2)``; points farther than a cutoff go.  Points and triangles with a null or
    non-finite coordinate are left out.

    Triangles and points are cut into tiles and blocks of bounded counts.  A block knows the mesh's vertex that is nearest to its middle:
    its points first ask that vertex's tile, and then those other tiles whose boxes are nearer than what they found there.
    """
    finite = " and ".join(f"abs({a}) < double('inf')" for a in "xyz")
    asking = cloud.where(f"pid is not null and {finite}").select("pid", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    flat = faces.select(*[F.col(f"p{i}")[x].cast("double").alias(f"{k}{x}") for i, k in enumerate("abc") for x in "xyz"])
    flat = flat.where(" and ".join(f"abs({c}) < double('inf')" for c in flat.columns)).distinct()
    mesh, n_faces = _tiled(flat, [(F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in "xyz"], TILE)
    points, n_points = _tiled(asking, [F.col(x) for x in "xyz"], BLOCK)
    if not n_faces or not n_points:
        return cloud.sparkSession.createDataFrame([], f"pid {dict(cloud.dtypes)['pid']}, distance double")
    points = points.withColumnRenamed("tile", "block").select("pid", *"xyz", "block")

    leaves = _boxed(mesh, ["tile", "depth"], *[[f(*[F.col(f"{k}{x}") for k in "abc"]) for x in "xyz"] for f in (F.least, F.greatest)])
    blocks = materialise(_boxed(points, ["block"], *[[F.col(x) for x in "xyz"]] * 2), "blocks")
    corner = F.explode(F.array(*[F.struct(*[F.col(f"{k}{x}").alias(f"v{x}") for x in "xyz"]) for k in "abc"]))
    corners = mesh.select("tile", corner.alias("v")).groupBy("v").agg(F.min("tile").alias("home"))
    corners = materialise(corners.select(F.monotonically_increasing_id().alias("nid"), "v.*", "home"), "mesh-corners")
    middles = blocks.select(F.col("block").alias("pid"), *[((F.col(f"lo{x}") + F.col(f"hi{x}")) / 2).alias(x) for x in "xyz"])
    near = knn(middles, corners.select(F.col("nid").alias("pid"), *[F.col(f"v{x}").alias(x) for x in "xyz"]), 1)
    guided = materialise(blocks.join(near.select(F.col("pid").alias("block"), "nid"), "block").join(corners, "nid").drop("nid"), "guided")

    first = materialise(points.join(guided.select("block", F.col("home").alias("tile")).hint("merge"), "block").select("pid", *"xyz", "block", "tile"), "mesh-first")
    found = materialise(_visits(first, mesh), "mesh-found")
    reach = guided.agg(*[F.max(F.greatest(F.abs(f"hi{x}"), F.abs(f"lo{x}"), F.abs(f"v{x}"))) for x in "xyz"]).first()
    pairs = _candidates(guided.drop("home"), leaves, 1e-12 * sum(v * v for v in reach), cutoff)
    pairs = materialise(pairs.join(guided.select("block", "home"), "block").where("tile <> home").drop("home"), "mesh-pairs")
    gaps = [F.greatest(F.col(f"lo{x}") - F.col(x), F.col(x) - F.col(f"hi{x}"), F.lit(0.0)) for x in "xyz"]
    bound = F.col("d2") if cutoff is None else F.least("d2", F.lit(cutoff * cutoff * (1 + 1e-9)))
    closer = found.drop("tile").join(pairs.hint("merge"), "block").where(_sum([g * g for g in gaps]) < bound)
    more = _visits(materialise(closer.select("pid", *"xyz", "block", "tile"), "mesh-closer"), mesh)
    best = found.select("pid", "d2").union(more.select("pid", "d2")).groupBy("pid").agg(F.sqrt(F.min("d2")).alias("distance"))
    return best if cutoff is None else best.where(F.col("distance") <= cutoff)


def mesh_distance_summary(distances: DataFrame) -> DataFrame:
    d = F.col("distance")
    return distances.agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.max(d).alias("max"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n"))
