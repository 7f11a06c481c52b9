"""Scalars, vectors and boxes as column expressions.  A vector is a struct with x, y and maybe z; a box one with min_x, max_x and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the greatest coordinate that is taken for one.
MOST_COORDINATE = 1e12


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def safe_divide(a: Column, b: Column, least: float = 1e-12, instead: Column | None = None) -> Column:
    """a / b; a divisor within ``least`` of 0 gives ``instead``, or raises without it."""
    return F.when(F.abs(b) > least, a / b).otherwise(F.raise_error(F.lit("division by a number too near 0")).cast("double") if instead is None else F.when(b.isNotNull(), instead))


def quotient(a: Column, b: Column) -> Column:
    """a / b of floating-point numbers: over 0 an infinite number with the sign of both, or NaN."""
    ends = [F.lit(float(v)) for v in ("nan", "inf", "-inf")]
    below = (a < 0) != b.cast("string").startswith("-")
    return F.when(b != 0, a / b).when((a == 0) | F.isnan(a), ends[0]).when(below, ends[2]).when(~below, ends[1])


def rounded(v: Column, places: int) -> Column:
    """A floating-point number at ``places`` places as SQL engines on doubles round: its product with 10 ** places to the nearest whole
    number, halves away from 0.  Spark's own ``round`` goes by the number's decimal digits, which parts from that at halves.

    A number whose product is not finite stays.
    """
    power = F.lit(10.0**places)
    return F.when(F.abs(v * power) < F.lit(float("inf")), F.round(v * power, 0) / power).otherwise(v)


def mean(values: Column) -> Column:
    """The mean of an array; an empty one raises."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.raise_error(F.lit("no values to average")).cast("double"))


def square(v: Column) -> Column:
    return v * v


def cube(v: Column) -> Column:
    return v * v * v


def sign(v: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(v).cast("int")


def checked(v: Column, positive: bool = False) -> Column:
    """A coordinate; null, NaN, infinite or beyond MOST_COORDINATE raises, with ``positive`` also 0 and less."""
    sound = v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST_COORDINATE)
    if positive:
        sound = sound & (v > 0)
    return F.when(sound, v).otherwise(F.raise_error(F.concat(F.lit("not a coordinate: "), F.coalesce(v.cast("string"), F.lit("null")))).cast("double"))


def _axes(flat: bool) -> str:
    return "xy" if flat else "xyz"


def dot(a: Column, b: Column, flat: bool = False) -> Column:
    return reduce(lambda s, k: s + a[k] * b[k], _axes(flat)[1:], a["x"] * b["x"])


def length(a: Column, flat: bool = False) -> Column:
    return F.sqrt(dot(a, a, flat))


def cross_flat(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def unit(a: Column, flat: bool = False) -> Column:
    """The vector of length 1; nulls for the null vector."""
    size = length(a, flat)
    return F.struct(*[F.try_divide(a[k], size).alias(k) for k in _axes(flat)])


def angle(a: Column, b: Column, flat: bool = False) -> Column:
    """The angle between two vectors in radians; null where one has no length."""
    cosine = F.try_divide(dot(a, b, flat), length(a, flat) * length(b, flat))
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def midpoint(a: Column, b: Column, flat: bool = False) -> Column:
    return F.struct(*[((a[k] + b[k]) / 2).alias(k) for k in _axes(flat)])


def translated(a: Column, by: Column, flat: bool = False) -> Column:
    return F.struct(*[(a[k] + by[k]).alias(k) for k in _axes(flat)])


def box(low: Column, high: Column, flat: bool = False) -> Column:
    """The box between two corners; a corner beyond the other raises."""
    order = reduce(lambda s, k: s & (low[k] <= high[k]), _axes(flat), F.lit(True))
    sides = [v for k in _axes(flat) for v in (low[k].alias(f"min_{k}"), high[k].alias(f"max_{k}"))]
    return F.when(order, F.struct(*sides)).otherwise(F.raise_error(F.lit("the corners are the wrong way round")).cast("struct<" + ",".join(f"{e}_{k}:double" for k in _axes(flat) for e in ("min", "max")) + ">"))


def contains(b: Column, p: Column, flat: bool = False) -> Column:
    return reduce(lambda s, k: s & p[k].between(b[f"min_{k}"], b[f"max_{k}"]), _axes(flat), F.lit(True))


def intersects(a: Column, b: Column, flat: bool = False) -> Column:
    return reduce(lambda s, k: s & (a[f"min_{k}"] <= b[f"max_{k}"]) & (b[f"min_{k}"] <= a[f"max_{k}"]), _axes(flat), F.lit(True))


def union(a: Column, b: Column, flat: bool = False) -> Column:
    return F.struct(*[f(a[f"{e}_{k}"], b[f"{e}_{k}"]).alias(f"{e}_{k}") for k in _axes(flat) for e, f in (("min", F.least), ("max", F.greatest))])


def expanded(b: Column, by: float, flat: bool = False) -> Column:
    return F.struct(*[(b[f"{e}_{k}"] + s * by).alias(f"{e}_{k}") for k in _axes(flat) for e, s in (("min", -1), ("max", 1))])


def volume(b: Column, flat: bool = False) -> Column:
    """The product of the sides: an area if flat."""
    return reduce(lambda s, k: s * (b[f"max_{k}"] - b[f"min_{k}"]), _axes(flat), F.lit(1.0))


def centre(b: Column, flat: bool = False) -> Column:
    return F.struct(*[((b[f"min_{k}"] + b[f"max_{k}"]) / 2).alias(k) for k in _axes(flat)])
