"""Survey points: field codes, runs, catalogs, profiles and section volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.functions.geometry import base_code


#: Points of a survey, by their number, that one task orders.
SLICE_POINTS = 100_000


def runs_of(points: DataFrame, key: Column, survey: str = "survey") -> DataFrame:
    """``points`` with ``shape``, the ord of the first point of the run of adjacent points of equal ``key``; a null key is a run of its own.

    Points are ordered within slices of SLICE_POINTS numbers; what a slice begins with is compared with the end of the last
    slice before it, and a run that goes on from there takes its first point from there, so no task holds a survey.
    """
    sliced = points.withColumns({"_key": key, "_slice": F.expr(f"cast(ord div {SLICE_POINTS} as long)")})
    inside = Window.partitionBy(survey, "_slice").orderBy("ord")
    earlier = F.lag("_key").over(inside)
    marked = sliced.withColumn("_new", F.col("_key").isNull() | earlier.isNull() | (F.col("_key") != earlier))
    marked = marked.withColumn("_from", F.last(F.when(F.col("_new"), F.col("ord")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(survey, "_slice").agg(F.min("ord").alias("_head"), F.min_by("_key", "ord").alias("_first"), F.max_by("_key", "ord").alias("_last"), F.max("_from").alias("_start"))
    along = Window.partitionBy(survey).orderBy("_slice")  # a row a slice
    goes_on = F.coalesce(F.col("_first") == F.lag("_last").over(along), F.lit(False))
    chained = ends.withColumn("_on", goes_on)
    # a slice that is one run, and goes on from the slice before, hands that run's start on
    own = F.when(~(F.col("_on") & (F.col("_start") == F.col("_head"))), F.col("_start"))
    chained = chained.withColumn("_own", own).withColumn("_before", F.last("_own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    carried = chained.where("_on").select(survey, "_slice", F.col("_head").alias("_from"), F.col("_before").alias("_carried"))
    return marked.join(carried, [survey, "_slice", "_from"], "left").withColumn("shape", F.coalesce("_carried", "_from")).drop("_key", "_slice", "_new", "_from", "_carried")


def runs(points: DataFrame, survey: str = "survey") -> DataFrame:
    """Adjacent points of one survey with equal base codes form a run; a null code is never part of a longer one.  Runs are numbered from 1."""
    coded = runs_of(points.withColumn("base", base_code(F.col("code"))), F.col("base"), survey)
    each = coded.groupBy(survey, "shape").agg(F.min("base").alias("base"), F.count("*").alias("points"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    return numbered(each, survey, "first", "run").drop("shape")


def numbered(rows: DataFrame, group: str, order: str, out: str, *then: str) -> DataFrame:
    """Numbers from 1 by ``order`` (and ``then``) within ``group``: within slices of it, and added up over the slices."""
    cut = rows.withColumn("_slice", F.expr(f"cast({order} div {SLICE_POINTS} as long)"))
    counts = cut.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_slice", (F.sum("_n").over(Window.partitionBy(group).orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order, *then))
    return cut.withColumn("_inside", inside).join(before, [group, "_slice"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")


def code_lookup(points: DataFrame, catalog: DataFrame, how: str = "left") -> DataFrame:
    """Definitions by upper-case base code; ``left_anti`` gives the unmatched points."""
    return points.withColumn("_code", F.upper(base_code(F.col("code")))).join(catalog.withColumnRenamed("code", "_code"), "_code", how)


#: Commands of a field code ``BASE.FIGURE[.COMMAND]``.
COMMANDS = {"S": "start", "C": "continue", "E": "end", "X": "close"}


def parse_codes(points: DataFrame) -> DataFrame:
    parts = F.split("code", r"\.")
    size = F.size(parts)
    command = F.when(size == 2, F.lit("continue")).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), F.get(parts, F.lit(2))))
    return points.withColumns({"base": F.when(size.isin(2, 3), parts[0]), "figure": F.when(size.isin(2, 3), F.get(parts, F.lit(1))), "command": F.when(size.isin(2, 3), command)})


def average_end_area(sections: DataFrame) -> DataFrame:
    """``sections(line, station, area)``: volumes between neighbours and their sum, by line."""
    order = Window.partitionBy("line").orderBy("station")
    each = (F.lead("station").over(order) - F.col("station")) * (F.col("area") + F.lead("area").over(order)) / 2
    return sections.withColumn("v", each).groupBy("line").agg(F.sum("v").alias("volume"), F.count("*").alias("sections"))


def _simpson_weight() -> Column:
    order = Window.partitionBy("line").orderBy("station")
    n = F.count("*").over(Window.partitionBy("line"))
    place = F.row_number().over(order)
    return F.when((place == 1) | (place == n), 1).when(place % 2 == 0, 4).otherwise(2)


def prismoidal(sections: DataFrame, step: float | None = None) -> DataFrame:
    """Simpson's rule over an odd number of equally spaced sections of each line.

    One row per line.  A line that the rule doesn't fit has a null volume and a ``problem``: ``few``
    (under three sections), ``even``, ``value`` (a null, infinite or negative one) or ``spacing``
    (not equal, none, or not ``step`` where that is given).
    """
    order = Window.partitionBy("line").orderBy("station")
    station, area = F.col("station").cast("double"), F.col("area").cast("double")
    fine = F.coalesce((F.abs(station) < float("inf")) & (area >= 0) & (area < float("inf")), F.lit(False))
    each = sections.withColumns({"_w": _simpson_weight(), "_gap": F.lead("station").over(order) - F.col("station"), "_fine": fine})
    totals = each.groupBy("line").agg(
        F.sum(F.col("_w") * F.col("area")).alias("_sum"), F.count("*").alias("sections"), F.count_if(~F.col("_fine")).alias("_bad"),
        F.min("_gap").alias("_low"), F.max("_gap").alias("_high"), F.min_by("_gap", "station").alias("_first"),
    )
    spacing = F.col("_first") if step is None else F.lit(float(step))
    tolerance = F.greatest(F.lit(1.0), F.abs(spacing)) * 1e-9
    even = (F.col("_low") > 0) & (F.col("_high") - spacing <= tolerance) & (spacing - F.col("_low") <= tolerance)
    problem = F.when(F.col("sections") < 3, "few").when(F.col("sections") % 2 == 0, "even").when(F.col("_bad") > 0, "value").when(~even, "spacing")
    judged = totals.withColumn("problem", problem)
    return judged.select("line", F.when(F.col("problem").isNull(), F.col("_sum") * (spacing / 3)).alias("volume"), "sections", "problem")


def prismoidal_as_if_even(sections: DataFrame, step: float) -> DataFrame:
    """Simpson's rule with every section taken as ``step`` after the one before; lines without an odd number of three or more have no row."""
    weighted = sections.withColumn("w", _simpson_weight())
    return weighted.groupBy("line").agg((F.sum(F.col("w") * F.col("area")) * (step / 3)).alias("volume"), F.count("*").alias("sections")).where("sections % 2 = 1 and sections >= 3")


def rmse(pairs: DataFrame) -> DataFrame:
    """``pairs(dx, dy, dz)``: root mean squares by component, flat and in space."""
    sq = {a: F.avg(F.col(f"d{a}") * F.col(f"d{a}")) for a in "xyz"}
    return pairs.agg(*[F.sqrt(sq[a]).alias(f"rmse_{a}") for a in "xyz"], F.sqrt(sq["x"] + sq["y"]).alias("rmse_2d"), F.sqrt(sq["x"] + sq["y"] + sq["z"]).alias("rmse_3d"), F.count("*").alias("n"))


def control_points(pairs: DataFrame, tolerance: float) -> DataFrame:
    ok = (F.abs("dx") <= tolerance) & (F.abs("dy") <= tolerance) & (F.abs("dz") <= tolerance)
    return pairs.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.max(F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))).alias("worst"))


def correctness(detected: DataFrame, reference: DataFrame) -> DataFrame:
    """Cells ``(row, col)`` of two grids: true and false positives, false negatives, precision, recall, F1."""
    both = detected.select("row", "col").distinct().withColumn("d", F.lit(1)).join(reference.select("row", "col").distinct().withColumn("r", F.lit(1)), ["row", "col"], "full")
    t = both.agg(F.count_if(F.col("d").isNotNull() & F.col("r").isNotNull()).alias("tp"), F.count_if(F.col("r").isNull()).alias("fp"), F.count_if(F.col("d").isNull()).alias("fn"))
    return t.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def completeness(cloud: DataFrame, low: tuple[float, float], high: tuple[float, float], size: float) -> DataFrame:
    """Covered cells of a box; cells are cut towards zero, so points just under the box count in its first cells."""
    rows, cols = -int(-(high[1] - low[1]) // size), -int(-(high[0] - low[0]) // size)
    at = cloud.select(((F.col("y") - low[1]) / size).cast("long").alias("row"), ((F.col("x") - low[0]) / size).cast("long").alias("col"))
    inside = at.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).distinct()
    return inside.agg(F.count("*").alias("covered"), F.lit(rows * cols).cast("long").alias("cells"), (F.count("*") / float(rows * cols)).alias("completeness"))


def precision(observations: DataFrame, quantile: float, tolerances: tuple[float, float, float]) -> DataFrame:
    """Repeated ``observations(x, y, z)``: deviations, their margins by a two-sided Student quantile, within tolerance or not."""
    dev = {a: F.stddev_samp(a) for a in "xyz"}
    t = observations.agg(*[dev[a].alias(f"std_{a}") for a in "xyz"], *[F.avg(a).alias(f"mean_{a}") for a in "xyz"], F.count("*").alias("n"))
    margins = {f"margin_{a}": F.lit(quantile) * F.col(f"std_{a}") / F.sqrt("n") for a in "xyz"}
    ok = [F.col(f"std_{a}") <= limit for a, limit in zip("xyz", tolerances, strict=True)]
    return t.withColumns(margins).withColumn("within", ok[0] & ok[1] & ok[2])


def registration_quality(residuals: DataFrame, tolerance: float) -> DataFrame:
    """``residuals(distance)``: the share within tolerance, root mean square, mean and greatest."""
    d = F.col("distance")
    return residuals.agg((F.count_if(d <= tolerance) / F.count("*")).alias("fitness"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mean"), F.max(d).alias("worst"))


def completeness_of_grids(covered: DataFrame, reference: DataFrame) -> DataFrame:
    """The share of the reference's cells ``(row, col)`` that are covered, null without a reference."""
    hit = covered.select("row", "col").distinct().withColumn("_hit", F.lit(1))
    both = reference.select("row", "col").distinct().join(hit, ["row", "col"], "left")
    return both.agg(F.count("_hit").alias("covered"), F.count("*").alias("cells")).withColumn("completeness", F.try_divide("covered", "cells"))
