"""Surfaces: triangle meshes, their derivatives, grids, contours and volumes.

A mesh is ``vertices(vid, x, y, z)`` and ``triangles(tid, v0, v1, v2)``; a raster is
``(row, col, z)`` with null for no data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.functions import geometry as g
from cragspan.plans.storage import materialise

#: Points that read the vertices of ``idw`` together, and the points and vertices whose distances are held at once.
IDW_POINTS = 1_024
IDW_TILE = (16, 4_096)


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with their corner points p0, p1, p2."""
    out = triangles
    for k in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{k}"), F.struct("x", "y", "z").alias(f"p{k}")), f"v{k}")
    return out.select("tid", "v0", "v1", "v2", "p0", "p1", "p2")


def _p() -> tuple[Column, Column, Column]:
    return F.col("p0"), F.col("p1"), F.col("p2")


def derivatives(faces: DataFrame) -> DataFrame:
    return faces.select("tid", g.triangle_area(*_p()).alias("area"), g.projected_area(*_p()).alias("flat_area"), g.triangle_slope(*_p()).alias("slope"), g.triangle_aspect(*_p()).alias("aspect"), g.hillshade(*_p()).alias("shade"))


def surface_area(faces: DataFrame) -> DataFrame:
    return faces.agg(F.sum(g.triangle_area(*_p())).alias("area"), F.sum(g.projected_area(*_p())).alias("flat_area"), F.count("*").alias("triangles"))


def tin_volume(faces: DataFrame, datum: float) -> DataFrame:
    """Volumes above and below a datum, split by whole triangles."""
    each = g.projected_area(*_p()) * ((F.col("p0.z") + F.col("p1.z") + F.col("p2.z")) / 3 - datum)
    return faces.select(each.alias("v")).agg(F.sum(F.when(F.col("v") >= 0, F.col("v")).otherwise(0.0)).alias("above"), F.sum(F.when(F.col("v") < 0, -F.col("v")).otherwise(0.0)).alias("below"))


def edge_faces(triangles: DataFrame) -> DataFrame:
    """A row per triangle and undirected edge: a < b, tid and the opposite vertex."""
    sides = [F.struct(F.least(F.col(f"v{i}"), F.col(f"v{j}")).alias("a"), F.greatest(F.col(f"v{i}"), F.col(f"v{j}")).alias("b"), F.col(f"v{k}").alias("opposite")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    return triangles.select("tid", F.explode(F.array(*sides)).alias("e")).select("e.a", "e.b", "tid", "e.opposite")


def edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges and the number of triangles on each: 1 on the boundary, 2 inside."""
    return edge_faces(triangles).groupBy("a", "b").agg(F.count("*").alias("faces"))


def triangle_neighbours(triangles: DataFrame) -> DataFrame:
    """For each triangle and opposite vertex the triangle over the edge, -1 at the boundary."""
    e = edge_faces(triangles)
    other = e.select("a", "b", F.col("tid").alias("other"))
    return e.join(other, (e.a == other.a) & (e.b == other.b) & (e.tid != other.other), "left").select("tid", "opposite", F.coalesce("other", F.lit(-1)).cast("long").alias("neighbour"))


def vertex_neighbours(triangles: DataFrame) -> DataFrame:
    e = edge_faces(triangles).select("a", "b").distinct()
    return e.union(e.select("b", "a")).toDF("vid", "nid")


def neighbour_mean(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``vertices`` with ``mean_z`` of the vertices around, summed by vid: how the table is dealt must not show in the last bits."""
    near = vertex_neighbours(triangles).join(vertices.select(F.col("vid").alias("nid"), F.col("z").alias("nz")), "nid")
    around = near.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("nid", "nz"))).alias("_n"))
    known = F.filter("_n", lambda e: e["nz"].isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, e: s + e["nz"]), F.size(known))
    return vertices.join(around.select("vid", mean.alias("mean_z")), "vid")


def laplacian_smooth(vertices: DataFrame, triangles: DataFrame, factor: float) -> DataFrame:
    """One Jacobi step towards the neighbours' mean."""
    return neighbour_mean(vertices, triangles).select("vid", "x", "y", (F.col("z") + factor * (F.col("mean_z") - F.col("z"))).alias("z"))


def spikes(vertices: DataFrame, triangles: DataFrame, threshold: float) -> DataFrame:
    return neighbour_mean(vertices, triangles).where(F.abs(F.col("z") - F.col("mean_z")) > threshold).select("vid", "z", "mean_z")


def _interior(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    one = edge_faces(triangles).groupBy("a", "b").agg(F.min_by("tid", "tid").alias("t0"), F.max_by("tid", "tid").alias("t1"), F.min_by("opposite", "tid").alias("o0"), F.max_by("opposite", "tid").alias("o1"), F.count("*").alias("n"))
    return one.where("n = 2").drop("n")


def breaklines(vertices: DataFrame, triangles: DataFrame, least: float) -> DataFrame:
    """Interior edges between triangles whose normals differ by an angle of ``least`` degrees or more."""
    f = corners(vertices, triangles)
    n = f.select("tid", *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), g.upward_normal(*_p()), strict=True)])
    e = _interior(vertices, triangles)
    for k in (0, 1):
        e = e.join(n.select(F.col("tid").alias(f"t{k}"), F.struct("nx", "ny", "nz").alias(f"n{k}")), f"t{k}")
    dot = sum((F.col(f"n0.{c}") * F.col(f"n1.{c}") for c in ("ny", "nz")), F.col("n0.nx") * F.col("n1.nx"))
    return e.select("a", "b", F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))).alias("angle")).where(F.col("angle") >= least)


def valley_edges(vertices: DataFrame, triangles: DataFrame, depth: float) -> DataFrame:
    """Interior edges whose opposite vertices both lie at least ``depth`` above the edge's middle."""
    e = _interior(vertices, triangles)
    for c in ("a", "b", "o0", "o1"):
        e = e.join(vertices.select(F.col("vid").alias(c), F.col("z").alias(f"z_{c}")), c)
    mid = (F.col("z_a") + F.col("z_b")) / 2
    return e.where((F.col("z_o0") >= mid + depth) & (F.col("z_o1") >= mid + depth)).select("a", "b")


def contour_segments(faces: DataFrame, base: float, interval: float) -> DataFrame:
    """Straight crossings of levels and triangles: level, tid and the two ends, the lesser first."""
    zs = [F.col(f"p{k}.z") for k in range(3)]
    low, high = F.least(*zs), F.greatest(*zs)
    first = F.ceil((low - base) / interval)
    last = F.floor((high - base) / interval)
    leveled = faces.where(high > low).withColumn("_k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("level", base + F.col("_k") * interval)
    ends = []
    for i, j in ((0, 1), (1, 2), (2, 0)):
        a, b = F.col(f"p{i}"), F.col(f"p{j}")
        t = F.try_divide(F.col("level") - a["z"], b["z"] - a["z"])
        ends.append(F.when((a["z"] < F.col("level")) != (b["z"] < F.col("level")), F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))))
    cut = leveled.withColumn("_ends", F.array_sort(F.array_compact(F.array(*ends)))).where(F.size("_ends") == 2)
    return cut.select("level", "tid", *[F.get("_ends", F.lit(k))[c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")])


def locate(points: DataFrame, faces: DataFrame, size: float, *kept: str) -> DataFrame:
    """The first triangle (by tid) around each point with its interpolated z: by cells of the triangles' boxes.

    Columns ``kept`` of the points come along.  Neither side is left to be broadcast: the points may be spread out from few rows.
    """
    boxed = faces.withColumns({f"{n}{a}": F.floor(f(*[F.col(f"p{k}.{a}") for k in range(3)]) / size).cast("long") for a in ("x", "y") for n, f in (("lo", F.least), ("hi", F.greatest))})
    cells = boxed.withColumn("cx", F.explode(F.sequence("lox", "hix"))).withColumn("cy", F.explode(F.sequence("loy", "hiy")))
    keyed = points.select("pid", "x", "y", *kept).withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    w = g.barycentric(F.col("x"), F.col("y"), *_p())
    inside = (w[0] >= -1e-9) & (w[1] >= -1e-9) & (w[2] >= -1e-9)
    z = w[0] * F.col("p0.z") + w[1] * F.col("p1.z") + w[2] * F.col("p2.z")
    found = keyed.join(cells.hint("merge"), ["cx", "cy"]).where(inside).groupBy("pid").agg(F.min(F.struct(F.col("tid").alias("tid"), z.alias("z"), *kept)).alias("m"))
    return found.select("pid", "m.tid", "m.z", *[f"m.{c}" for c in kept])


def idw(points: DataFrame, vertices: DataFrame, power: float = 2.0) -> DataFrame:
    """Inverse-distance weights over all vertices; a point on a vertex has its z.

    The vertices are written to the shared folder and every batch of points reads them once, block by block, so neither side has
    to fit anywhere; the work is still every point times every vertex, dealt in batches of ``IDW_POINTS`` points.
    """
    files = materialise(vertices.select("vid", *[F.col(a).cast("double").alias(a) for a in "xyz"]), "idw").inputFiles()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        for at in itertools.chain.from_iterable((b.iloc[i : i + IDW_POINTS] for i in range(0, len(b), IDW_POINTS)) for b in batches):
            px, py = at["x"].to_numpy(float)[:, None], at["y"].to_numpy(float)[:, None]
            sums = np.zeros((len(at), 2))
            exact, owner = np.full(len(at), np.nan), np.full(len(at), np.inf)
            for path in files:
                system, inner = fs.FileSystem.from_uri(path)
                for block in parquet.ParquetFile(system.open_input_file(inner)).iter_batches(65_536):
                    vid, x, y, z = (block.column(c).to_numpy() for c in ("vid", "x", "y", "z"))
                    values = np.stack([np.ones(len(z)), z], 1)
                    for i, j in itertools.product(range(0, len(at), IDW_TILE[0]), range(0, len(z), IDW_TILE[1])):
                        rows, cols = slice(i, i + IDW_TILE[0]), slice(j, j + IDW_TILE[1])
                        w, dy = px[rows] - x[cols], py[rows] - y[cols]
                        w *= w
                        dy *= dy
                        w += dy
                        if not w.min(initial=np.inf) > 1e-24:  # also if one is not a number
                            row, col = np.nonzero(w <= 1e-24)
                            w[row, col] = np.inf
                            for r, c in zip(row + i, col + j, strict=True):
                                if vid[c] < owner[r]:
                                    owner[r], exact[r] = vid[c], z[c]
                        if power == 2:
                            np.divide(1.0, w, out=w)
                        else:
                            np.power(w, -power / 2, out=w)
                        sums[rows] += w @ values[cols]
            with np.errstate(invalid="ignore"):
                yield pd.DataFrame({"pid": at["pid"], "z": np.where(np.isnan(exact), sums[:, 1] / sums[:, 0], exact)})

    asked = materialise(points.select("pid", "x", "y"), "idw-points")
    parts = max(1, -(-asked.count() // IDW_POINTS))
    return asked.repartition(parts).mapInPandas(weigh, f"pid {dict(points.dtypes)['pid']}, z double")


def raster_summary(raster: DataFrame) -> DataFrame:
    return raster.agg(F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("valid"), F.count("*").alias("cells"))


def grid_slope(raster: DataFrame, size: float) -> DataFrame:
    """Degrees of slope by central differences, one-sided at the edges."""
    along = []
    for part, order in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(part).orderBy(order)
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        steps = F.lag(order).over(w).isNotNull().cast("int") + F.lead(order).over(w).isNotNull().cast("int")
        along.append((F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / (steps * size))
    return raster.withColumn("dx", along[0]).withColumn("dy", along[1]).select("row", "col", F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("slope"))


def raster_window(raster: DataFrame, radius: int) -> DataFrame:
    """Minimum, maximum and mean of each cell's square neighbourhood: over columns, then over rows."""
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    one = raster.select("row", "col", F.min("z").over(across).alias("lo"), F.max("z").over(across).alias("hi"), F.sum("z").over(across).alias("s"), F.count("z").over(across).alias("n"))
    return one.select("row", "col", F.min("lo").over(down).alias("min"), F.max("hi").over(down).alias("max"), (F.sum("s").over(down) / F.sum("n").over(down)).alias("mean"))


def grey_opening(raster: DataFrame, width: int) -> DataFrame:
    """Erosion, then dilation, by a square of odd width; edges repeat, which clipped windows match."""
    out, r = raster, width // 2
    for f in (F.min, F.max):
        for part, order in (("row", "col"), ("col", "row")):
            out = out.withColumn("z", f("z").over(Window.partitionBy(part).orderBy(order).rangeBetween(-r, r)))
    return out


def bilinear(points: DataFrame, raster: DataFrame) -> DataFrame:
    """z at (x = column, y = row) positions from the four cells around; null beyond them."""
    at = points.select("pid", "x", "y", F.floor("x").cast("long").alias("c0"), F.floor("y").cast("long").alias("r0"))
    fx, fy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    spread = at.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    share = F.when(F.col("k.j") == 1, fx).otherwise(1 - fx) * F.when(F.col("k.i") == 1, fy).otherwise(1 - fy)
    keyed = spread.select("pid", (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"), share.alias("share"))
    joined = keyed.join(raster, ["row", "col"]).groupBy("pid").agg(F.sum(F.col("share") * F.col("z")).alias("z"), F.count("z").alias("n"))
    return joined.select("pid", F.when(F.col("n") == 4, F.col("z")).alias("z"))


def nearest_sample(points: DataFrame, raster: DataFrame) -> DataFrame:
    at = points.select("pid", F.bround("y").cast("long").alias("row"), F.bround("x").cast("long").alias("col"))
    return at.join(raster, ["row", "col"]).select("pid", "z")


def cut_fill(existing: DataFrame, proposed: DataFrame, cell_area: float) -> DataFrame:
    d = existing.join(proposed.select("row", "col", F.col("z").alias("z2")), ["row", "col"]).where("z is not null and z2 is not null").withColumn("d", F.col("z") - F.col("z2"))
    return d.agg((F.sum(F.greatest("d", F.lit(0.0))) * cell_area).alias("cut"), (F.sum(F.greatest(-F.col("d"), F.lit(0.0))) * cell_area).alias("fill"), (F.sum("d") * cell_area).alias("net"), F.count("*").alias("cells"))
