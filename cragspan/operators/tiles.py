"""Space cut into squares (or cubes) of bounded counts: codes of interleaved bits, and the leaves of the tree over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.plans.storage import materialise

#: Halvings of the extent in the finest grid, by the number of axes.
BITS = {2: 26, 3: 20}
#: Shifts and masks that move the bits of a number apart, to every second or third place.
_SPREAD = {
    2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)),
    3: ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)),
}


def _spread(i: Column, axes: int) -> Column:
    for shift, mask in _SPREAD[axes]:
        i = i.bitwiseOR(F.shiftleft(i, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return i


def cells(values: list[Column], low: list[float], size: float) -> list[Column]:
    """The places in the finest grid over ``low .. low + size``, an axis each."""
    grid = 1 << BITS[len(values)]
    return [F.greatest(F.lit(0), F.least(F.floor((v - start) / size * grid), F.lit(grid - 1))).cast("long") for v, start in zip(values, low, strict=True)]


def interleaved(places: list[Column]) -> Column:
    """Places along the axes as one number; in the finest grid its leading bits name the larger squares."""
    out = F.lit(0).cast("long")
    for k, place in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(_spread(place, len(places)), k))
    return out


def corner(square: int, depth: int, axes: int) -> list[int]:
    """A square's place along each axis, from its code at ``depth``."""
    return [sum((square >> (axes * b + k) & 1) << b for b in range(depth)) for k in range(axes)]


def leaves(points: DataFrame, most: int, total: int, axes: int, step: int, weigh: Column | None = None) -> DataFrame:
    """``points(code, ...)`` with ``depth``: of the squares around each point, the largest that holds at most ``most`` of them.

    ``weigh`` counts some points only; squares without any are leaves too.  Depths are multiples of ``step``.  A square of the
    finest grid is a leaf, however much it holds.
    """
    deepest = BITS[axes] - BITS[axes] % step
    weight = F.lit(1) if weigh is None else weigh.cast("int")
    done, todo, first = [], points, 0
    depth = min(deepest, step * math.ceil(math.log(max(1, total / most), 1 << axes) / step) + 2 * step)
    while True:
        cells = todo.groupBy(F.shiftright("code", axes * (BITS[axes] - depth)).alias("cell")).agg(F.sum(weight).alias("n"))
        levels = F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("cell", axes * (depth - d)).alias("square")) for d in range(first, depth + 1, step)])
        each = materialise(cells.withColumn("l", F.explode(levels)).select("cell", "n", "l.d", "l.square"), "tiles")
        full = each.groupBy("d", "square").agg(F.sum("n").alias("n"))
        fits = (F.col("n") <= most) | ((F.col("d") == depth) & F.lit(depth == deepest))
        leaf = materialise(each.drop("n").join(full, ["d", "square"]).groupBy("cell").agg(F.min(F.when(fits, F.col("d"))).alias("depth")), "tile-leaves")
        named = todo.withColumn("cell", F.shiftright("code", axes * (BITS[axes] - depth))).join(leaf, "cell").drop("cell")
        done.append(named.where("depth is not null"))
        if leaf.where("depth is null").isEmpty():
            break
        todo = materialise(named.where("depth is null").drop("depth"), "tiles-deeper")
        first, depth = depth, min(deepest, depth + 4 * step)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
