"""Radius and nearest-neighbour joins by grid cells, and what is built on them.

A distance predicate becomes an equi-join: one side is looked up in the cells around each of its
points, 27 or a few more.  The grid's cell is the radius, so the remaining filter on the exact distance is all
that is left to do.  k-NN works on leaves of bounded counts, which follow the density of the cloud.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators import tiles
from cragspan.operators.components import components
from cragspan.operators.ranks import quantiles
from cragspan.plans.storage import materialise


#: Points of a leaf of the neighbour search, queries that meet them at once, and distances held at once.
LEAF = 2_048
QUERIES = 8_192
COMPARED = 2_000_000
#: Radii along the side of a block of the radius counts, rows of a piece of a crowded block, and distances held at once.
BLOCK = 3
PIECE = 200_000
COUNTED = 131_072


def _cells(size: float, axes: str) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long") for a in axes]


def _keyed(df: DataFrame, size: float, axes: str) -> DataFrame:
    return df.withColumns({f"c{a}": c for a, c in zip(axes, _cells(size, axes), strict=True)})


def _around(df: DataFrame, size: float, axes: str, radius: float) -> DataFrame:
    """``df`` with a row for each cell within the radius of each point, a little more, as quotients and distances are rounded."""
    reach = radius * (1 + 1e-9)
    for a in axes:
        ends = [F.floor((F.col(a) + way * reach) / size).cast("long") for way in (-1, 1)]
        df = df.withColumn(f"c{a}", F.explode(F.sequence(*ends)))
    return df


def _d2(axes: str) -> Column:
    return sum(((F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"n{axes[0]}")) * (F.col(axes[0]) - F.col(f"n{axes[0]}")))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", margin: float = 0.0) -> DataFrame:
    """Pairs ``(pid, nid, d2)`` of points at most ``radius`` apart.

    Sizes are known before the cells around are spread out only, so neither side is left to be broadcast.
    """
    size = radius + margin
    a = _around(left.select("pid", *axes), size, axes, radius)
    b = _keyed(right.select(F.col("pid").alias("nid"), *axes), size, axes).withColumnsRenamed({x: f"n{x}" for x in axes})
    return a.join(b.hint("merge"), [f"c{x}" for x in axes]).withColumn("d2", _d2(axes)).where(F.col("d2") <= radius * radius).select("pid", "nid", "d2")


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames cut anew, so that rows of equal keys, which stand together, are in one frame."""
    held: list[pd.DataFrame] = []
    for f in (f for f in frames if len(f)):
        last = f[keys].iloc[-1]
        first = int(np.argmax((f[keys] == last).all(axis=1).to_numpy()))
        if held and first == 0 and (held[0][keys].iloc[0] == last).all():
            held.append(f)
            continue
        if held or first:
            yield pd.concat([*held, f.iloc[:first]], ignore_index=True)
        held = [f.iloc[first:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _weight_within(at: np.ndarray, points: np.ndarray, weights: np.ndarray, radius: float) -> np.ndarray:
    """For each row of ``at`` the weights of ``points`` at most ``radius`` away, by cells of the radius."""
    found = np.zeros(len(at))
    if not len(at) or not len(points):
        return found
    size = radius * (1 + 1e-9)
    cells = [np.floor(p / size).astype(np.int64) for p in (at, points)]
    low = np.minimum(cells[0].min(0), cells[1].min(0)) - 1
    span = np.maximum(cells[0].max(0), cells[1].max(0)) - low + 2
    strides = np.append(np.cumprod(span[:0:-1])[::-1], 1)
    asked, code = ((c - low) @ strides for c in cells)
    order = np.argsort(code, kind="stable")
    code, points, weights = code[order], np.ascontiguousarray(points[order].T), weights[order]
    offsets = [int(np.dot(o, strides[:-1])) for o in itertools.product((-1, 0, 1), repeat=len(strides) - 1)]
    order = np.argsort(asked, kind="stable")
    ends = np.flatnonzero(np.diff(asked[order], append=-1)) + 1
    lows, highs = (np.searchsorted(code, asked[order][ends - 1][:, None] + np.array(offsets) + d) for d in (-1, 2))
    for k, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        parts = [slice(i, j) for i, j in zip(lows[k], highs[k], strict=True) if i < j]
        if not parts:
            continue
        near, weight = np.concatenate([points[:, p] for p in parts], axis=1), np.concatenate([weights[p] for p in parts])
        step = max(1, COUNTED // len(weight))
        for i in range(start, end, step):
            rows = order[i : min(end, i + step)]
            q = at[rows]
            d2 = (q[:, 0, None] - near[0]) ** 2
            for a in range(1, len(near)):
                d2 += (q[:, a, None] - near[a]) ** 2
            found[rows] = (d2 <= radius * radius) @ weight
    return found


def radius_count(cloud: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """Points within the radius, the point itself included; points with a null or non-finite coordinate are left out.

    No pair is written out.  Points at one place are one with a weight.  Space is cut into blocks of ``BLOCK`` radii a side, each of
    which meets the places in it and those within the radius of it; a crowded block is dealt in pieces of bounded numbers, every
    piece of its places with every piece of those around.
    """
    finite = " and ".join(f"abs({a}) < double('inf')" for a in axes)
    cloud = cloud.where(finite).select("pid", *[F.col(a).cast("double").alias(a) for a in axes])
    places = materialise(cloud.groupBy(*axes).agg(F.count("*").cast("double").alias("n")), "places")
    size = radius * (1 + 1e-9)
    block = [f"b{a}" for a in axes]
    spread = places
    for a in axes:
        ends = [F.floor((F.col(a) + way * size) / (BLOCK * size)).cast("long") for way in (-1, 1)]
        spread = spread.withColumn(f"b{a}", F.explode(F.sequence(*ends)))
    own = F.lit(True)
    for a in axes:
        own &= F.floor(F.col(a) / (BLOCK * size)).cast("long") == F.col(f"b{a}")
    spread = spread.withColumn("own", own)
    pieces = [F.ceil(c / F.lit(PIECE)).cast("int").alias(k) for k, c in (("askers", F.count_if("own")), ("shown", F.count("*")))]
    crowd = materialise(spread.groupBy(*block).agg(*pieces).where("askers > 1 or shown > 1"), "crowded-blocks")
    if crowd.isEmpty():
        dealt = spread.withColumns({"askers": F.lit(1), "shown": F.lit(1)})
    else:
        dealt = spread.join(crowd, block, "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("askers", "shown")})
    one = F.xxhash64(*axes)
    asks = dealt.where("own and askers > 0").select(*block, F.pmod(one, F.col("askers")).cast("int").alias("asker"), F.explode(F.sequence(F.lit(0), F.col("shown") - 1)).alias("piece"), F.lit(True).alias("asks"), *axes, "n")
    held = dealt.where("askers > 0").select(*block, F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), F.pmod(one, F.col("shown")).cast("int").alias("piece"), F.lit(False).alias("asks"), *axes, "n")
    keys = [*block, "asker", "piece"]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, keys):
            named, asking, at, n = f[keys].to_numpy(), f["asks"].to_numpy(bool), f[list(axes)].to_numpy(float), f["n"].to_numpy(float)
            ends = np.flatnonzero(np.append((named[1:] != named[:-1]).any(axis=1), True)) + 1
            found = np.zeros(len(f))
            for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                q = asking[start:end]
                found[start:end][q] = _weight_within(at[start:end][q], at[start:end][~q], n[start:end][~q], radius)
            yield f.loc[asking, list(axes)].assign(n=found[asking].astype(np.int64))

    together = asks.unionByName(held).repartition(*keys).sortWithinPartitions(*keys)
    counted = together.mapInPandas(count, ", ".join(f"{a} double" for a in axes) + ", n long").groupBy(*axes).agg(F.sum("n").alias("n"))
    return cloud.join(counted.hint("merge"), list(axes)).groupBy("pid").agg(F.sum("n").alias("neighbours"))


def crowded(cloud: DataFrame, radius: float, least: int) -> DataFrame:
    """``(pid)`` of the points with ``least`` points within the radius, the point itself included.

    Nothing is counted beyond ``least``: a cell whose points are all within the radius of each other settles them by its number,
    and of all others the ``least``-th nearest is looked at.
    """
    celled = materialise(_keyed(cloud.select("pid", *"xyz"), radius / 3**0.5 * (1 - 1e-12), "xyz"), "crowded")
    full = celled.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    full = materialise(full, "crowded-full")
    cells = ["cx", "cy", "cz"]
    rest = celled.join(full, cells, "left_anti").select("pid", *"xyz")
    near = knn(rest, cloud, least).where((F.col("rank") == least) & (F.col("d2") <= radius * radius)).select("pid")
    return celled.join(full, cells, "left_semi").select("pid").union(near)


def radius_outliers(cloud: DataFrame, radius: float, least: int) -> DataFrame:
    """The points that stay: those with ``least`` points within the radius, themselves included."""
    return cloud.join(crowded(cloud, radius, least), "pid", "left_semi")


def local_density(cloud: DataFrame, radius: float) -> DataFrame:
    return radius_count(cloud, radius).select("pid", (F.col("neighbours") / F.lit(4.0 / 3.0 * 3.141592653589793 * radius**3)).alias("density"))


def _scarce(right: DataFrame, axes: str, most: int) -> DataFrame:
    """``right(nid, ...)`` with at most ``most`` points at each place, those of the least ids: no more can be among the nearest."""
    place = list(axes)
    full = right.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")
    full = materialise(full, "knn-full")
    if full.isEmpty():
        return right
    many = right.join(full, place, "left_semi").withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(256)))
    for keys in ([*place, "salt"], place):  # a place may hold most points: the least of each salt first
        many = many.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("nid"))).where(F.col("r") <= most).drop("r")
    return right.join(full, place, "left_anti").unionByName(many.drop("salt"))


def _nearest_of(pid: np.ndarray, at: np.ndarray, nid: np.ndarray, points: np.ndarray, k: int, drop_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, point, d2)`` as places: the k nearest points (or all) of each query, by distance, equal ones by id."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, COMPARED // max(1, len(nid)))
    for first in range(0, len(pid) if len(nid) else 0, step):
        q = at[first : first + step]
        d2 = (q[:, 0, None] - points[:, 0]) ** 2
        for a in range(1, points.shape[1]):
            d2 = d2 + (q[:, a, None] - points[:, a]) ** 2
        if drop_self:
            d2[pid[first : first + step, None] == nid] = np.inf
        reach = np.partition(d2, k - 1, 1)[:, k - 1] if k < d2.shape[1] else np.full(len(q), np.inf)
        row, col = np.nonzero((d2 <= reach[:, None]) & (d2 < np.inf))
        order = np.lexsort((nid[col], d2[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row[rank < k] + first, col[rank < k], d2[row, col][rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _visits(queries: DataFrame, points: DataFrame, axes: str, k: int, drop_self: bool) -> DataFrame:
    """``(pid, nid, d2)``: for ``queries(pid, axes, depth, square)`` the k nearest among ``points(nid, axes, depth, square)`` of the same leaf.
    The queries of a leaf are dealt in blocks, each with the leaf's points."""
    tile = ["depth", "square"]
    sizes = queries.groupBy(*tile).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    dealt = queries.join(sizes, tile).withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).select(*tile, "block", F.lit(True).alias("asks"), F.col("pid").alias("id"), *axes)
    shown = points.join(sizes, tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*tile, "block", F.lit(False).alias("asks"), F.col("nid").alias("id"), *axes)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        ids, at = frame["id"].to_numpy(), frame[list(axes)].to_numpy(float)
        q, p, d2 = _nearest_of(ids[asks], at[asks], ids[~asks], at[~asks], k, drop_self)
        return pd.DataFrame({"pid": ids[asks][q], "nid": ids[~asks][p], "d2": d2})

    return dealt.unionByName(shown).groupBy(*tile, "block").applyInPandas(search, "pid long, nid long, d2 double")


def _other_leaves(asking: DataFrame, held: DataFrame, size: float, low: list[float]) -> DataFrame:
    """``(depth, square, to_depth, to_square, c0..)``: the leaves of ``held`` that may lie within ``reach`` of those of ``asking``; both
    ``(depth, square, c0, c1..)`` with the leaf's place along each axis.

    The reach is looked up in squares of its own size, two along an axis at most: leaves inside them are found by the squares that
    they lie in, and larger ones by the squares around.
    """
    axes = len(low)
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("depth"))
    level = F.greatest(F.lit(0), F.least(F.col("depth"), F.floor(F.log2(F.lit(size) / (side + 2 * F.col("reach")))).cast("int")))
    wide = asking.withColumn("level", level)
    cell = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    last = F.expr("shiftleft(1L, level) - 1")
    for k in range(axes):
        ends = [F.least(last, F.greatest(F.lit(0), F.floor(v / cell))) for v in (F.col(f"c{k}") * side - F.col("reach"), (F.col(f"c{k}") + 1) * side + F.col("reach"))]
        wide = wide.withColumn(f"w{k}", F.explode(F.sequence(*ends)))
    around = wide.select("depth", "square", "level", tiles.interleaved([F.col(f"w{k}") for k in range(axes)]).alias("cell"))
    places = [F.col(f"c{k}").alias(f"o{k}") for k in range(axes)]
    named = held.select(F.col("depth").alias("to_depth"), F.col("square").alias("to_square"), *places)
    inside = named.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("to_depth")))).withColumn("cell", F.expr(f"shiftright(to_square, cast({axes} * (to_depth - level) as int))"))
    small = around.join(inside, ["level", "cell"])
    above = around.where("level > 0").withColumn("to_depth", F.explode(F.sequence(F.lit(0), F.col("level") - 1))).withColumn("to_square", F.expr(f"shiftright(cell, cast({axes} * (level - to_depth) as int))"))
    large = above.join(named, ["to_depth", "to_square"])
    columns = ["depth", "square", "to_depth", "to_square", *[f"o{k}" for k in range(axes)]]
    return small.select(*columns).union(large.select(*columns)).distinct().where("depth <> to_depth or square <> to_square")


def knn(left: DataFrame, right: DataFrame, k: int, axes: str = "xyz", drop_self: bool = False) -> DataFrame:
    """The k nearest points of ``right`` for each of ``left``: rows ``(pid, rank, nid, d2)``, equal distances by nid.

    ``drop_self`` leaves out the point of the same id.  Fewer than k points give as many as there are.  Points with a null
    or non-finite coordinate, or a null id, are left out on both sides.

    Space is cut into leaves of bounded counts of ``right``.  Each point asks its own leaf, which bounds the distance of its
    k-th neighbour (a leaf of fewer points has more than k around it in the square above), and then those other
    leaves that are nearer than the bound.
    """
    spark = left.sparkSession
    finite = " and ".join(f"abs({a}) < double('inf')" for a in axes)
    asking = left.where(f"pid is not null and {finite}").select(F.col("pid").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes])
    held = right.where(f"pid is not null and {finite}").select(F.col("pid").alias("nid"), *[F.col(a).cast("double").alias(a) for a in axes])
    spans = [t.agg(F.count("*").alias("n"), *[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first() for t in (asking, held)]
    if not spans[0]["n"] or not spans[1]["n"]:
        return spark.createDataFrame([], "pid long, rank int, nid long, d2 double")
    ranked = Window.partitionBy("pid").orderBy("d2", "nid")
    most = max(LEAF, 2 * (k + 1))
    if spans[1]["n"] <= most:
        one = [F.lit(0).alias("depth"), F.lit(0).cast("long").alias("square")]
        near = _visits(asking.select(F.col("id").alias("pid"), *axes, *one), held.select("nid", *axes, *one), axes, k, drop_self)
        return near.withColumn("rank", F.row_number().over(ranked)).select("pid", "rank", "nid", "d2")

    low = [min(s[f"lo{a}"] for s in spans) for a in axes]
    size = max(max(s[f"hi{a}"] for s in spans) - v for a, v in zip(axes, low, strict=True)) or 1.0
    held = _scarce(held, axes, k + drop_self)
    both = asking.withColumn("asks", F.lit(True)).union(held.select(F.col("nid").alias("id"), *axes).withColumn("asks", F.lit(False)))
    bits, n_axes = tiles.BITS[len(axes)], len(axes)
    grid = tiles.cells([F.col(a) for a in axes], low, size)
    coded = both.withColumns({f"c{i}": g for i, g in enumerate(grid)}).withColumn("code", tiles.interleaved([F.col(f"c{i}") for i in range(n_axes)]))
    placed = tiles.leaves(coded, most, spans[1]["n"], n_axes, 1, ~F.col("asks"))
    placed = placed.withColumns({"square": F.expr(f"shiftright(code, cast({n_axes} * ({bits} - depth) as int))"), **{f"c{i}": F.expr(f"shiftright(c{i}, cast({bits} - depth as int))") for i in range(n_axes)}})
    placed = materialise(placed.drop("code"), "knn-placed")
    queries, points = placed.where("asks").withColumnRenamed("id", "pid"), placed.where("not asks").withColumnRenamed("id", "nid")
    near = materialise(_visits(queries, points, axes, k, drop_self), "knn-near")

    # how far each point must look, and whether its own leaf's box lies beyond that on every side
    margin = 1e-9 * size
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("depth"))
    corner = [F.greatest(F.abs(F.col(a) - (v + (F.expr(f"c{i} div 2")) * 2 * side)), F.abs(F.col(a) - (v + (F.expr(f"c{i} div 2") + 1) * 2 * side))) for i, (a, v) in enumerate(zip(axes, low, strict=True))]
    farthest = F.sqrt(sum((c * c for c in corner[1:]), corner[0] * corner[0]))
    own = near.groupBy("pid").agg(F.count("*").alias("n"), F.max("d2").alias("worst"))
    reach = F.when(F.col("n") >= k, F.sqrt("worst")).otherwise(farthest) + margin
    free = F.least(*[F.least(F.col(a) - (v + F.col(f"c{i}") * side), v + (F.col(f"c{i}") + 1) * side - F.col(a)) for i, (a, v) in enumerate(zip(axes, low, strict=True))])
    loose = materialise(queries.join(own, "pid", "left").withColumn("reach", reach).where((F.col("depth") > 0) & (F.col("reach") >= free)).drop("n", "worst", "asks"), "knn-loose")

    tile = ["depth", "square", *[f"c{i}" for i in range(n_axes)]]
    pairs = _other_leaves(loose.groupBy(*tile).agg(F.max("reach").alias("reach")), points.select(*tile).distinct(), size, low)
    met = loose.join(pairs, ["depth", "square"])
    there = F.lit(size) / F.pow(F.lit(2.0), F.col("to_depth"))
    off = [F.greatest(v + F.col(f"o{i}") * there - F.col(a), F.col(a) - (v + (F.col(f"o{i}") + 1) * there), F.lit(0.0)) for i, (a, v) in enumerate(zip(axes, low, strict=True))]
    met = met.where(sum((o * o for o in off[1:]), off[0] * off[0]) <= F.col("reach") * F.col("reach"))
    visits = materialise(met.select("pid", *axes, F.col("to_depth").alias("depth"), F.col("to_square").alias("square")), "knn-visits")
    more = _visits(visits, points, axes, k, drop_self)
    every = near.union(more).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return materialise(every.select("pid", "rank", "nid", "d2"), "knn")


def statistical_outliers(cloud: DataFrame, k: int, ratio: float) -> DataFrame:
    """Points whose mean distance to their k neighbours is at most mean + ratio * deviation of all such means."""
    each = materialise(knn(cloud, cloud, k, drop_self=True).groupBy("pid").agg(F.avg(F.sqrt("d2")).alias("distance")), "sor")
    limit = each.agg((F.avg("distance") + ratio * F.stddev_pop("distance")).alias("limit"))
    return each.join(F.broadcast(limit)).where(F.col("distance") <= F.col("limit")).select("pid", "distance")


def nearest(left: DataFrame, right: DataFrame, axes: str = "xyz") -> DataFrame:
    return knn(left, right, 1, axes).select("pid", "nid", F.sqrt("d2").alias("distance"))


def cloud_to_cloud(reference: DataFrame, compared: DataFrame) -> DataFrame:
    d = nearest(reference, compared)
    return d.agg(F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std"), F.max("distance").alias("max"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rmse"), F.count("*").alias("n"))


def hausdorff(a: DataFrame, b: DataFrame, percentile: float = 100.0) -> DataFrame:
    """The percentile (by default the greatest) of the distances to the other cloud, both ways, and the greater of the two."""
    ways = []
    for near in (nearest(a, b), nearest(b, a)):
        ways.append(near.agg(F.max("distance")).first()[0] if percentile >= 100 else quantiles(materialise(near, "ways"), "distance", [percentile / 100])[0])
    worst = None if None in ways else max(ways)
    return a.sparkSession.createDataFrame([(*ways, worst)], "forward double, backward double, hausdorff double")


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    one, two = nearest(a, b).agg(F.avg("distance").alias("forward")), nearest(b, a).agg(F.avg("distance").alias("backward"))
    return one.join(two).select("forward", "backward", ((F.col("forward") + F.col("backward")) / 2).alias("chamfer"))


def relative_height(cloud: DataFrame, ground: DataFrame) -> DataFrame:
    near = nearest(cloud, ground)
    return cloud.join(near, "pid").join(ground.select(F.col("pid").alias("nid"), F.col("z").alias("gz")), "nid").select("pid", (F.col("z") - F.col("gz")).alias("height"))


def correspondences(source: DataFrame, target: DataFrame, cutoff: float) -> DataFrame:
    return nearest(source, target).where(F.col("distance") <= cutoff)


def spread_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(pid, root)`` of ``nodes(pid)``: the least pid that edges ``(a, b)`` lead to, both ways."""
    found = components(edges).withColumnRenamed("node", "pid")
    return nodes.select("pid").join(found, "pid", "left").select("pid", F.coalesce("root", "pid").alias("root"))


def _linked_cells(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """``(points with node, links)``: cells of radius / sqrt(3), in which all points are linked, named by their least pid, and the
    pairs ``(a, b)`` of them that some two points within the radius link; a cell meets the 5 * 5 * 5 cells around it."""
    side = radius / 3**0.5 * (1 - 1e-12)
    celled = _keyed(points.select("pid", *"xyz"), side, "xyz")
    names = celled.groupBy("cx", "cy", "cz").agg(F.min("pid").alias("node"))
    placed = materialise(celled.join(names, ["cx", "cy", "cz"]), "celled")
    steps = [o for o in itertools.product(range(-2, 3), repeat=3) if o > (0, 0, 0)]
    near = names.withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip("xyz", o, strict=True)]) for o in steps])))
    near = near.select(F.col("node").alias("a"), *[(F.col(f"c{a}") + F.col(f"_s.d{a}")).alias(f"c{a}") for a in "xyz"])
    cells = near.join(names.withColumnRenamed("node", "b"), ["cx", "cy", "cz"]).select("a", "b")
    one = placed.select(F.col("node").alias("a"), "pid", *"xyz")
    two = placed.select(F.col("node").alias("b"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    links = cells.join(one, "a").join(two, "b").where(_d2("xyz") <= radius * radius).select("a", "b").distinct()
    return placed, links


def connected_components(cloud: DataFrame, radius: float, least: int) -> DataFrame:
    """Components of points linked within the radius; those of fewer than ``least`` points are -1."""
    placed, links = _linked_cells(cloud, radius)
    roots = spread_components(links, placed.select(F.col("node").alias("pid")).distinct()).withColumnRenamed("pid", "node")
    rooted = placed.select("pid", "node").join(roots, "node")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    return rooted.join(sizes, "root").select("pid", F.when(F.col("n") >= least, F.col("root")).otherwise(-1).alias("segment"))


def dbscan(cloud: DataFrame, radius: float, least: int) -> DataFrame:
    """Cluster of each point (its least core pid), border points in the cluster that starts first, noise -1."""
    core = materialise(crowded(cloud, radius, least), "dbscan-core")
    placed, links = _linked_cells(cloud.join(core, "pid", "left_semi"), radius)
    roots = spread_components(links, placed.select(F.col("node").alias("pid")).distinct()).withColumnRenamed("pid", "node")
    own = materialise(placed.join(roots, "node").select("pid", *"xyz", "root"), "dbscan-own")
    # a border point needs the least root in reach only: cores are told apart by cell and root
    rest = cloud.join(core, "pid", "left_anti")
    reach = radius_pairs(rest, own, radius).join(own.select(F.col("pid").alias("nid"), "root"), "nid").groupBy("pid").agg(F.min("root").alias("reached"))
    return cloud.select("pid").join(own.select("pid", "root"), "pid", "left").join(reach, "pid", "left").select("pid", F.coalesce("root", "reached", F.lit(-1)).alias("cluster"))
