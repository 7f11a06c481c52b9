"""Features from classified clouds and steep parts of meshes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators.neighbours import spread_components
from cragspan.operators.survey import numbered
from cragspan.operators.terrain import derivatives, edge_faces
from cragspan.operators.triangulate import Mesh
from cragspan.plans.storage import materialise

_INF = math.inf
#: Classes, linking distance, least points, then bounds of height, extent and elongation, and the most |nz|.
DETECTORS = {
    "building": ([6], 1.0, 20, (0.0, _INF), (2.0, 200.0), (0.0, _INF), None),
    "wall": ([6], 0.5, 15, (0.0, _INF), (0.0, _INF), (0.0, _INF), 0.3),
    "retaining_wall": ([2], 0.5, 15, (0.4, _INF), (0.0, _INF), (0.0, _INF), 0.2),
    "road": ([11], 1.5, 50, (0.0, _INF), (0.0, _INF), (2.0, _INF), None),
    "parking": ([11], 1.5, 80, (0.0, _INF), (0.0, _INF), (0.0, 2.0), None),
    "driveway": ([11], 1.0, 20, (0.0, _INF), (2.0, 40.0), (1.3, 4.0), None),
    "manhole": ([1], 0.3, 5, (0.0, _INF), (0.3, 1.2), (0.0, 1.5), None),
    "inspection_chamber": ([1], 0.5, 8, (0.0, _INF), (0.8, 2.5), (0.0, 1.6), None),
    "pole": ([1], 0.3, 10, (2.0, 12.0), (0.0, 0.6), (0.0, _INF), None),
    "light_pole": ([1], 0.3, 10, (4.0, 9.0), (0.0, 0.6), (0.0, _INF), None),
    "sign": ([1], 0.25, 5, (0.8, 3.0), (0.0, 0.8), (0.0, _INF), None),
    "tree": ([5], 1.5, 10, (2.0, _INF), (0.0, _INF), (0.0, _INF), None),
    "shrub": ([3, 4], 0.8, 8, (0.3, 2.0), (0.0, _INF), (0.0, _INF), None),
    "grass": ([3], 2.0, 100, (0.0, 0.3), (3.0, _INF), (0.0, _INF), None),
}


#: Category, geometry and, of points, the place that stands for the cluster.
GEOMETRY = {
    "building": ("building", "polygon", None),
    "wall": ("building", "polygon", None),
    "retaining_wall": ("building", "polygon", None),
    "road": ("infrastructure", "polygon", None),
    "parking": ("infrastructure", "polygon", None),
    "driveway": ("infrastructure", "polygon", None),
    "manhole": ("drainage", "point", "mean"),
    "inspection_chamber": ("drainage", "point", "mean"),
    "pole": ("utility", "point", "lowest"),
    "light_pole": ("utility", "point", "lowest"),
    "sign": ("utility", "point", "lowest"),
    "tree": ("vegetation", "point", "lowest"),
    "shrub": ("vegetation", "point", "lowest"),
    "grass": ("vegetation", "polygon", None),
}
#: Side of the small triangle that stands for a footprint of fewer than three places.
LEAST_SIDE = 1e-3
#: Slices of elevation in which a cluster's median is looked for.
SLICES = 1_024


def _clusters(cloud: DataFrame, detectors: dict[str, tuple]) -> tuple[DataFrame, DataFrame]:
    """``(points, features)``: the points of all clusters ``(detector, first, pid, x, y, z)``, and the rows that ``detect`` returns.

    Points within the linking distance in plan form a cluster.  Cells of distance/sqrt(2) hold only linked points, so
    the graph has cells for nodes, named by their least pid, and dense clouds don't grow it.  Detectors that look at
    normals are left out where the cloud has no ``nz``.
    """
    used = {k: v for k, v in detectors.items() if v[6] is None or "nz" in cloud.columns}
    rules = [F.struct(F.lit(k).alias("detector"), F.lit(eps).alias("eps")) for k, (_, eps, *_) in used.items()]
    applies = [F.when(F.col("classification").isin(codes) & (F.abs("nz") <= nz if nz is not None else F.lit(True)), rule) for rule, (codes, *_, nz) in zip(rules, used.values(), strict=True)]
    side = F.col("eps") / math.sqrt(2.0)
    taken = cloud.withColumn("_r", F.explode(F.array_compact(F.array(*applies)))).select("_r.*", "pid", "x", "y", "z")
    celled = taken.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    names = celled.groupBy("detector", "cx", "cy").agg(F.struct("detector", F.min("pid").alias("least")).alias("node"))
    placed = materialise(celled.join(names, ["detector", "cx", "cy"]), "feature-points")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)])
    near = placed.withColumn("_s", F.explode(steps)).select("detector", (F.col("cx") + F.col("_s.i")).alias("cx"), (F.col("cy") + F.col("_s.j")).alias("cy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("node").alias("a"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    links = placed.join(near, ["detector", "cx", "cy"]).where(dx * dx + dy * dy <= F.col("eps") * F.col("eps")).select("a", F.col("node").alias("b")).distinct()
    roots = spread_components(links, placed.select(F.col("node").alias("pid")).distinct())
    clustered = placed.join(roots.withColumnRenamed("pid", "node"), "node").select("detector", F.col("root.least").alias("first"), "pid", "x", "y", "z", "root")
    sums = clustered.groupBy("detector", F.col("root.least").alias("first")).agg(
        F.count("*").alias("points"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))],
        F.var_samp("x").alias("_xx"), F.var_samp("y").alias("_yy"), F.covar_samp("x", "y").alias("_xy"),
    )
    half, mid = F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) / 4 + F.col("_xy") * F.col("_xy")), (F.col("_xx") + F.col("_yy")) / 2
    shaped = sums.withColumns({
        "height": F.col("high_z") - F.col("low_z"),
        "extent": F.hypot(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")),
        "elongation": F.when(mid - half > 1e-12, F.sqrt((mid + half) / (mid - half))).otherwise(F.lit(_INF)),
    }).drop("_xx", "_yy", "_xy")
    keep = F.lit(False)
    for name, (_, _, least, *bounds, _) in used.items():
        inside = [F.col(c).between(low, high) for c, (low, high) in zip(("height", "extent", "elongation"), bounds, strict=True)]
        keep |= (F.col("detector") == name) & (F.col("points") >= least) & inside[0] & inside[1] & inside[2]
    return clustered.drop("root"), shaped.where(keep)


def detect(cloud: DataFrame, detectors: dict[str, tuple] = DETECTORS) -> DataFrame:
    """One row per feature that ``detectors`` find in ``cloud(pid, x, y, z, classification[, nz])``: its sums and bounds."""
    return _clusters(cloud, detectors)[1]


def medians(points: DataFrame, keys: list[str], column: str = "z") -> DataFrame:
    """``(keys, median)`` of a column, exactly: counts by slices of each group's range name the slice or two that hold the
    middle, and only these are ranked."""
    ends = points.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count(column).alias("_n"))
    part = F.coalesce(F.try_divide(F.col(column) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    cut = points.where(F.col(column).isNotNull()).join(ends, keys).withColumn("_slice", F.least(F.floor(part * SLICES), F.lit(SLICES - 1)))
    cut = materialise(cut.select(*keys, F.col(column).alias("_v"), "_n", "_slice"), "medians")
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_slice"))
    first, second = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    held = counts.withColumn("_before", upto - F.col("_c")).where((first < F.col("_before") + F.col("_c")) & (second >= F.col("_before")))
    flat = held.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"), (F.least(second, F.col("_before") + F.col("_c") - 1) - F.greatest(first, F.col("_before")) + 1).alias("_w"))
    rest = cut.drop("_n").join(held.where("_lo < _hi").drop("_c"), [*keys, "_slice"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_v")) - 1
    ranked = rest.withColumn("_r", place).where((F.col("_r") == first) | (F.col("_r") == second)).select(*keys, "_v", F.lit(1).cast("long").alias("_w"))
    return flat.union(ranked).groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("median"))


def detected(cloud: DataFrame, detectors: dict[str, tuple] = DETECTORS) -> DataFrame:
    """Feature rows for the sinks, as ``detect`` finds them: ``(feature_id, feature_type, category, geometry_type, vertices, closed,
    confidence, attributes, first)``.

    Polygons are the convex hull in plan at the cluster's median elevation (a small triangle for fewer than three places), points
    its mean or its lowest point, of equally low ones the least pid.  Ids run from 1 for each type, by the least pid of the clusters.
    """
    points, found = _clusters(cloud, detectors)
    found = materialise(found, "features")
    key = ["detector", "first"]
    own = materialise(points.join(found.select(*key), key, "left_semi"), "feature-clusters")
    kinds = F.create_map(*[x for k, v in GEOMETRY.items() for x in (F.lit(k), F.struct(*[F.lit(v[i]).cast("string").alias(n) for i, n in enumerate(("category", "kind", "place"))]))])
    kind = F.element_at(kinds, F.col("detector"))
    areal = own.where(kind["kind"] == "polygon")
    hull = footprints(areal, None)
    flat = hull.join(medians(areal, key), key).select(*key, F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.col("median").alias("z"))).alias("hull"))
    low = own.where(kind["place"] == "lowest").groupBy(*key).agg(F.min(F.struct("z", "pid", "x", "y")).alias("low"))
    mean, lowest = F.struct(*[F.col(f"mean_{a}").alias(a) for a in "xyz"]), F.struct(*[F.col(f"low.{a}").alias(a) for a in "xyz"])
    made = found.join(flat, key, "left").join(low, key, "left")
    vertices = F.when(kind["kind"] == "polygon", F.col("hull")).when(kind["place"] == "lowest", F.array(lowest)).otherwise(F.array(mean))
    attributes = F.create_map(*[x for n, c in (("point_count", "points"), ("height_m", "height"), ("extent_m", "extent")) for x in (F.lit(n), F.col(c).cast("string"))])
    rows = made.select(F.col("detector").alias("feature_type"), kind["category"].alias("category"), kind["kind"].alias("geometry_type"), vertices.alias("vertices"), (kind["kind"] == "polygon").alias("closed"), F.lit(1.0).alias("confidence"), attributes.alias("attributes"), "first")
    return numbered(rows, "feature_type", "first", "feature_id")


def roofs(cloud: DataFrame, least_nz: float = 0.5, angle: float = 15.0, reach: float = 1.0, least: int = 10) -> DataFrame:
    """Roof planes of ``cloud(pid, x, y, z, classification, nx, ny, nz)`` as feature rows with a mesh.

    Building points whose normals look up (nz at least ``least_nz``) are linked if they lie within ``reach`` in plan and their
    normals within ``angle`` degrees; parts of at least ``least`` points and three places off one line are roofs, so that the
    order of points doesn't matter.  The mesh is the part's Delaunay triangulation.  A part is one row, which one task makes.
    """
    if not 0 <= least_nz <= 1 or not 0 < angle < 90 or reach <= 0 or least < 1:
        raise ValueError("least_nz must be in [0, 1], angle in (0, 90), reach above 0 and least at least 1")
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    up = cloud.where((F.col("classification") == 6) & (F.col("nz") >= least_nz) & (size > 2.0**-52))
    unit = up.select("pid", *"xyz", *[F.col(f"n{a}").alias(f"r{a}") for a in "xyz"], *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in "xyz"])
    side, turned = reach / math.sqrt(2.0) * (1 - 1e-12), 2 * math.sin(math.radians(angle) / 2) / math.sqrt(3.0) * (1 - 1e-9)
    cells = {"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side), **{f"b{a}": F.floor(F.col(f"n{a}") / turned) for a in "xyz"}}
    names = ["cx", "cy", "bx", "by", "bz"]
    celled = unit.withColumns(cells)
    placed = materialise(celled.join(celled.groupBy(*names).agg(F.min("pid").alias("node")), names), "roof-points")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    near = placed.withColumn("_s", F.explode(steps)).select((F.col("cx") + F.col("_s.i")).alias("cx"), (F.col("cy") + F.col("_s.j")).alias("cy"), F.col("node").alias("a"), *[F.col(c).alias(f"o{c}") for c in ("x", "y", "nx", "ny", "nz")])
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    alike = F.col("nx") * F.col("onx") + F.col("ny") * F.col("ony") + F.col("nz") * F.col("onz") >= math.cos(math.radians(angle))
    links = placed.join(near, ["cx", "cy"]).where((F.col("a") < F.col("node")) & (dx * dx + dy * dy <= reach * reach) & alike).select("a", F.col("node").alias("b")).distinct()
    roots = spread_components(links, placed.select(F.col("node").alias("pid")).distinct()).withColumnsRenamed({"pid": "node", "root": "first"})
    parts = materialise(placed.join(roots, "node"), "roofs")

    def mesh(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["x", "y", "pid"]).drop_duplicates(["x", "y"])
        tri, _ = Mesh(list(zip(rows["x"].tolist(), rows["y"].tolist(), range(len(rows)), strict=True))).triangles()
        at = [[{"x": x, "y": y, "z": z} for x, y, z in zip(rows["x"].tolist(), rows["y"].tolist(), rows["z"].tolist(), strict=True)]]
        return pd.DataFrame({"first": [pdf["first"].iloc[0]], "vertices": at, "faces": [tri.tolist()]})

    sums = parts.groupBy("first").agg(F.count("*").alias("points"), *[F.avg(f"r{a}").alias(f"m{a}") for a in "xyz"]).where(F.col("points") >= least)
    meshes = parts.join(sums.select("first"), "first", "left_semi").groupBy("first").applyInPandas(mesh, "first long, vertices array<struct<x: double, y: double, z: double>>, faces array<array<int>>")
    length = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    told = {"point_count": F.col("points"), "mean_normal_x": F.coalesce(F.try_divide("mx", length), F.lit(0.0)), "mean_normal_y": F.coalesce(F.try_divide("my", length), F.lit(0.0)), "mean_normal_z": F.col("mz")}
    attributes = F.create_map(*[x for n, c in told.items() for x in (F.lit(n), c.cast("string"))])
    rows = meshes.where(F.size("faces") > 0).join(sums, "first").select(F.lit("roof").alias("feature_type"), F.lit("building").alias("category"), F.lit("mesh").alias("geometry_type"), "vertices", "faces", F.lit(1.0).alias("confidence"), attributes.alias("attributes"), "first")
    return numbered(rows, "feature_type", "first", "feature_id")


def embankments(faces: DataFrame, triangles: DataFrame, least_slope: float = 35.0, least: int = 4) -> DataFrame:
    """Parts of ``least`` or more steep triangles that share edges: the first tid, triangles, area, mean slope."""
    steep = materialise(derivatives(faces).where(F.col("slope") >= least_slope).select("tid", "area", "slope"), "steep")
    sides = edge_faces(triangles.join(steep.select("tid"), "tid", "left_semi")).select("a", "b", "tid")
    pairs = sides.groupBy("a", "b").agg(F.min("tid").alias("a_"), F.max("tid").alias("b_")).where("a_ < b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    roots = spread_components(pairs, steep.select(F.col("tid").alias("pid")))
    parts = steep.join(roots.withColumnRenamed("pid", "tid"), "tid").groupBy(F.col("root").alias("first"))
    return parts.agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), F.avg("slope").alias("slope")).where(F.col("triangles") >= least)


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``pdf(x, y)`` that are corners of their convex hull, counter-clockwise from the least; all of them if there are under three places."""
    rows = pdf.sort_values(["x", "y"]).drop_duplicates(["x", "y"])
    at = list(zip(rows["x"].tolist(), rows["y"].tolist(), range(len(rows)), strict=True))

    def half(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    if len(at) < 3:
        return rows
    return rows.iloc[[p[2] for p in half(at)[:-1] + half(at[::-1])[:-1]]]


def footprints(points: DataFrame, segment: str | None = "segment", slices: int = 64) -> DataFrame:
    """``(segment, corners, area)``: the convex hull in plan of each segment of ``points(segment, pid, x, y)``, counter-clockwise.

    The hull of a slice of the points is found first, then that of the slices' corners, so that no task holds a large segment.  Negative
    segments are noise.  Without ``segment``, points are grouped by ``detector`` and ``first`` instead, which are returned in its
    place, and fewer than three places get a small triangle.
    """
    keys = ["segment"] if segment else ["detector", "first"]
    kinds = {"segment": "long", "detector": "string", "first": "long"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    named = points.where(F.col(segment) >= 0).withColumn("segment", F.col(segment)) if segment else points
    keyed = named.select(*keys, "x", "y", F.pmod(F.xxhash64("pid"), F.lit(slices)).cast("int").alias("slice"))
    first = keyed.groupBy(*keys, "slice").applyInPandas(_hull, f"{schema}, x double, y double, slice int")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf)
        x, y = h["x"].to_numpy(), h["y"].to_numpy()
        if segment is None and len(x) < 3:
            x, y = x[0] + np.array([0.0, LEAST_SIDE, 0.0]), y[0] + np.array([0.0, 0.0, LEAST_SIDE])
        area = abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "corners": [[{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)]], "area": [area]})

    return first.groupBy(*keys).applyInPandas(whole, f"{schema}, corners array<struct<x: double, y: double>>, area double")
