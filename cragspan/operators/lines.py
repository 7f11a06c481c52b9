"""Chains of edges, contour lines and lines of change on meshes; grids over meshes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.functions import geometry as g
from cragspan.operators import terrain
from cragspan.operators.neighbours import spread_components
from cragspan.plans.storage import materialise


def walk(edges: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Polylines that use every edge once: from ends and branches first, to the least neighbour left; loops come last and close."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for k in near:
        near[k].sort(reverse=True)
    used: set[tuple[int, int]] = set()

    def follow(at: int) -> list[int]:
        path = [at]
        while True:
            onward = near[path[-1]]
            while onward and (min(path[-1], onward[-1]), max(path[-1], onward[-1])) in used:
                onward.pop()
            if not onward:
                return path
            used.add((min(path[-1], onward[-1]), max(path[-1], onward[-1])))
            path.append(onward.pop())
            if degree[path[-1]] != 2:
                return path

    degree = {k: len(v) for k, v in near.items()}
    for at in sorted(near, key=lambda k: (degree[k] == 2, k)):
        while len(path := follow(at)) > 1:
            yield path


def _ranked(arcs: DataFrame) -> DataFrame:
    """``(arc, end, after)`` of each of ``arcs(arc, on)``, none of which lead in circles: the last arc that it leads to, and how many come after it."""
    at_end = F.when(F.col("on").isNull(), F.col("arc"))
    reach = materialise(arcs.select("arc", "on", F.lit(0).cast("long").alias("after"), at_end.alias("end")), "chain-reach")
    while True:
        done, ahead = reach.where("on is null"), reach.where("on is not null")
        if ahead.isEmpty():
            return done.select("arc", "end", "after")
        there = reach.select(F.col("arc").alias("on"), F.col("on").alias("_on"), F.col("after").alias("_after"), F.col("end").alias("_end"))
        step = ahead.join(there, "on").select("arc", F.col("_on").alias("on"), (F.col("after") + F.col("_after") + 1).alias("after"), F.col("_end").alias("end"))
        reach = materialise(done.unionByName(step), "chain-reach")


def chains(edges: DataFrame) -> DataFrame:
    """Polylines of ``edges(a, b)``: ``(root, part, place, vid)``, cut where more than two edges meet.

    ``root`` is the least vertex of the connected net, ``part`` numbers its lines from 0 as ``walk`` does: by their first
    vertex, the lesser of the two ends, and the one after it; closed nets without ends come last and start at their least vertex.

    An edge is two arcs; an arc is followed by the arc that goes on from its end, where just two edges meet.  Arcs get their
    place by looking twice as far ahead in each round, so a line of n edges takes log2(n) rounds and no task holds it.
    """
    once = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "chain-edges")
    nets = spread_components(once, once.select(F.col("a").alias("pid")).union(once.select("b")).distinct())
    both = once.union(once.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"), F.min("b").alias("low"), F.max("b").alias("high"))
    degree = materialise(degree.join(nets.select(F.col("pid").alias("v"), "root"), "v"), "chain-degree")
    # a net of vertices of two edges each is one closed line, which is cut at its least vertex
    rings = degree.groupBy("root").agg(F.min("degree").alias("least"), F.max("degree").alias("most")).where("least = 2 and most = 2")
    degree = degree.join(rings.select(F.col("root").alias("v"), F.lit(True).alias("ring")), "v", "left")
    on = F.when((F.col("degree") == 2) & F.col("ring").isNull(), F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    arcs = both.join(degree.withColumnRenamed("v", "b"), "b").select("a", "b", on.alias("c"))
    arcs = arcs.select(F.struct("a", "b").alias("arc"), F.when(F.col("c").isNotNull(), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))).alias("on"))
    found = _ranked(arcs)
    sizes = found.groupBy(F.col("end").alias("line")).agg((F.max("after") + 1).alias("n"))
    placed = found.withColumnRenamed("end", "line").join(sizes, "line")
    placed = materialise(placed.select("line", (F.col("n") - 1 - F.col("after")).alias("place"), F.col("arc.a").alias("a"), F.col("arc.b").alias("b"), "n"), "chain-placed")
    ends = placed.groupBy("line").agg(F.min(F.when(F.col("place") == 0, F.struct("a", "b"))).alias("head"), F.min(F.when(F.col("place") == F.col("n") - 1, F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("tail"))
    # each line runs both ways: an open one is kept from its lesser end, a closed one towards the lesser neighbour
    kept = ends.where("head < tail").join(nets.select(F.col("pid").alias("v"), "root"), F.col("head.a") == F.col("v"))
    order = Window.partitionBy("root").orderBy("head")
    parts = kept.select("line", "root", (F.row_number().over(order) - 1).alias("part"))
    laid = placed.join(parts, "line")
    last = laid.where(F.col("place") == F.col("n") - 1).select("root", "part", F.col("n").alias("place"), F.col("b").alias("vid"))
    return laid.select("root", "part", "place", F.col("a").alias("vid")).union(last).select("root", "part", F.col("place").cast("int").alias("place"), "vid")


def chain_lines(edges: DataFrame, vertices: DataFrame, least_length: float = 0.0) -> DataFrame:
    """Chained ``edges(a, b)`` as ``(root, part, vertices, length)``; shorter lines than ``least_length`` are left out."""
    laid = chains(edges).join(vertices.select("vid", "x", "y", "z"), "vid").groupBy("root", "part").agg(F.sort_array(F.collect_list(F.struct("place", "vid", "x", "y", "z"))).alias("vertices"))
    return laid.withColumn("length", length(F.col("vertices"))).where(F.col("length") >= least_length)


def length(vertices: Column) -> Column:
    """The length in space of an array of points."""
    pairs = F.arrays_zip(F.slice(vertices, 1, F.size(vertices) - 1).alias("p"), F.slice(vertices, 2, F.size(vertices) - 1).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + g.distance(e["p"], e["q"]))


def drainage(vertices: DataFrame, triangles: DataFrame, depth: float = 0.05, least_length: float = 1.0) -> DataFrame:
    return chain_lines(terrain.valley_edges(vertices, triangles, depth), vertices, least_length)


def channels(vertices: DataFrame, triangles: DataFrame, depth: float = 0.3, least_length: float = 3.0) -> DataFrame:
    return drainage(vertices, triangles, depth, least_length)


def break_lines(vertices: DataFrame, triangles: DataFrame, angle: float = 25.0, least_length: float = 1.0) -> DataFrame:
    return chain_lines(terrain.breaklines(vertices, triangles, angle).select("a", "b"), vertices, least_length)


def curbs(vertices: DataFrame, triangles: DataFrame, angle: float = 8.0, least_length: float = 0.3) -> DataFrame:
    return break_lines(vertices, triangles, angle, least_length)


def slope_change_edges(vertices: DataFrame, triangles: DataFrame, least: float = 10.0) -> DataFrame:
    """Interior edges ``(a, b, change)`` between triangles whose slopes differ by ``least`` degrees or more."""
    slopes = terrain.derivatives(terrain.corners(vertices, triangles)).select("tid", "slope")
    sides = terrain.edge_faces(triangles).join(slopes, "tid").groupBy("a", "b").agg(F.count("*").alias("n"), (F.max("slope") - F.min("slope")).alias("change"))
    return sides.where((F.col("n") == 2) & (F.col("change") >= least)).select("a", "b", "change")


def slope_changes(vertices: DataFrame, triangles: DataFrame, least: float = 10.0, least_length: float = 1.0) -> DataFrame:
    return chain_lines(slope_change_edges(vertices, triangles, least).select("a", "b"), vertices, least_length)


def contour_lines(faces: DataFrame, interval: float, base: float = 0.0, least_length: float = 0.0) -> DataFrame:
    """Contours as ``(level, root, part, vertices, length, closed)``: the segments of a level, welded at 1e-9 and chained."""
    cut = terrain.contour_segments(faces, base, interval)
    ends = [F.struct("level", *[F.round(F.col(f"{c}{k}") * 1e9).cast("long").alias(c) for c in ("x", "y")]) for k in (0, 1)]
    welded = cut.select(*[F.xxhash64(e).alias(n) for n, e in zip("ab", ends, strict=True)], "level", "x0", "y0", "x1", "y1")
    edges = welded.where("a <> b")
    points = edges.select(F.col("a").alias("vid"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("level").alias("z")).union(edges.select("b", "x1", "y1", "level")).dropDuplicates(["vid"])
    found = chain_lines(edges.select("a", "b"), points, least_length)
    first, last = F.element_at("vertices", 1), F.element_at("vertices", -1)
    return found.select(first["z"].alias("level"), "root", "part", "vertices", "length", (first["vid"] == last["vid"]).alias("closed"))


def contour_name(level: Column, base: float, interval: float, every: int = 5) -> Column:
    """``major`` for every ``every``-th level, else ``minor``."""
    steps = (level - base) / interval / every
    return F.when(F.abs(steps - F.rint(steps)) <= 1e-6, "major").otherwise("minor")


def grid(low: tuple[float, float], high: tuple[float, float], size: float) -> tuple[int, int]:
    """``(rows, columns)`` of nodes that cover a box from its low corner."""
    if size <= 0 or high[0] < low[0] or high[1] < low[1]:
        raise ValueError("a grid needs a positive resolution and a box")
    return tuple(int(-(-(high[k] - low[k]) // size)) + 1 for k in (1, 0))


def node(x: Column, y: Column, low: tuple[float, float], size: float) -> tuple[Column, Column]:
    """The row and column of the nearest node; halves go to the even one."""
    return F.bround((y - low[1]) / size).cast("long"), F.bround((x - low[0]) / size).cast("long")


def dtm(faces: DataFrame, low: tuple[float, float], high: tuple[float, float], size: float) -> DataFrame:
    """``(row, col, x, y, z)`` of each node of the grid, z null beside the mesh."""
    rows, columns = grid(low, high, size)
    nodes = faces.sparkSession.range(rows * columns).select(F.col("id").alias("pid"), F.expr(f"id div {columns}").alias("row"), (F.col("id") % columns).alias("col"))
    placed = nodes.withColumns({"x": low[0] + F.col("col") * size, "y": low[1] + F.col("row") * size})
    return placed.join(terrain.locate(placed, faces, size).select("pid", "z"), "pid", "left").select("row", "col", "x", "y", "z")


def filled(raster: DataFrame, value: float) -> DataFrame:
    """Cells without data (null or not a number) get ``value``."""
    return raster.withColumn("z", F.when(F.col("z").isNull() | F.isnan("z"), value).otherwise(F.col("z")))


def masked(raster: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of ``mask(row, col)`` lose their data."""
    gone = mask.select("row", "col").distinct().withColumn("_gone", F.lit(True))
    return raster.join(gone, ["row", "col"], "left").withColumn("z", F.when(F.col("_gone").isNull(), F.col("z"))).drop("_gone")


def no_data(raster: DataFrame) -> DataFrame:
    empty = F.col("z").isNull() | F.isnan("z")
    return raster.agg(F.count_if(~empty).alias("valid"), F.count_if(empty).alias("empty"))


def boundary_edges(triangles: DataFrame, region: DataFrame) -> DataFrame:
    """``(region, a, b)``: the edges of ``region(tid, region)`` that only one of its triangles has."""
    sides = terrain.edge_faces(triangles).join(region.select("tid", "region"), "tid")
    return sides.groupBy("region", "a", "b").agg(F.count("*").alias("_n")).where("_n = 1").select("region", "a", "b")


def edge_lengths(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``(a, b, length)`` of every edge of the mesh, in space."""
    out = terrain.edges(triangles).select("a", "b")
    for c in ("a", "b"):
        out = out.join(vertices.select(F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), c)
    return out.select("a", "b", g.distance(F.col("pa"), F.col("pb")).alias("length"))


def welded(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines(line, ord, x, y, z)`` with ``vid``: that of the mesh's vertex at the very same x and y, else a new, negative one that follows from them."""
    known = vertices.groupBy("x", "y").agg(F.min("vid").alias("_vid"))
    new = -F.shiftrightunsigned(F.xxhash64("x", "y"), 1) - 1
    return lines.join(known, ["x", "y"], "left").select("line", "ord", "x", "y", "z", F.coalesce("_vid", new).alias("vid"), F.col("_vid").isNull().alias("fresh"))


def mesh_problems(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``(tid, problem)``: triangles with an unknown or repeated corner, an infinite coordinate or no area in plan."""
    known = vertices.select("vid", F.struct("x", "y", "z").alias("p"))
    out = triangles
    for k in range(3):
        out = out.join(known.select(F.col("vid").alias(f"v{k}"), F.col("p").alias(f"p{k}")), f"v{k}", "left")
    p = [F.col(f"p{k}") for k in range(3)]
    finite = F.lit(True)
    for c in p:
        for a in "xyz":
            finite &= F.abs(c[a]) < float("inf")
    problem = F.when(p[0].isNull() | p[1].isNull() | p[2].isNull(), "unknown_vertex").when((F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2")), "repeated_vertex").when(~F.coalesce(finite, F.lit(False)), "not_finite").when(g.projected_area(*p) == 0, "no_area")
    return out.select("tid", problem.alias("problem")).where("problem is not null")
