"""Figures of coded survey points, the features they make, and checks on features.

A code is ``BASE`` (points that follow each other under one base are a run) or
``BASE.FIGURE[.COMMAND]`` (figures that are started, continued and ended or closed, several at a
time).  Whether a figure is open before a point depends on the last start, end or close before it
alone, so figures are found by window functions over the points of one (survey, base, figure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators.survey import COMMANDS, numbered, runs_of
from cragspan.plans.storage import materialise

#: The least vertices of each geometry.
LEAST_VERTICES = {"point": 1, "polyline": 2, "polygon": 3, "mesh": 3}
#: The geometry that a catalog's kind of code gives; ground codes give none.
CATALOG_GEOMETRY = {"point": "point", "symbol": "point", "line": "polyline", "polygon": "polygon"}


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def commands(points: DataFrame) -> DataFrame:
    """``points`` with kind (``none`` without a code, ``plain``, ``figure`` or ``malformed``), base, figure and command."""
    parts = F.split(F.trim("code"), r"\.")
    size = F.size(parts)
    token = F.upper(F.trim(F.get(parts, F.lit(2))))
    command = F.when(size == 2, F.lit("continue")).when(token.isin(*COMMANDS), _lookup(COMMANDS, token))
    sound = size.isin(2, 3) & (F.trim(parts[0]) != "") & (F.trim(F.get(parts, F.lit(1))) != "") & command.isNotNull()
    kind = F.when(F.col("code").isNull(), "none").when(size == 1, "plain").when(sound, "figure").otherwise("malformed")
    return points.withColumn("kind", kind).withColumns({
        "base": F.when(F.col("kind") == "plain", F.upper(F.trim("code"))).when(F.col("kind") == "figure", F.upper(F.trim(parts[0]))),
        "figure": F.when(F.col("kind") == "figure", F.trim(F.get(parts, F.lit(1)))),
        "command": F.when(F.col("kind") == "figure", command),
    })


def assemble(points: DataFrame) -> DataFrame:
    """``points(survey, ord, id, x, y, z, code)`` with ``shape``, the ord of the first point of the run or figure
    that each belongs to, ``closed`` (ended by a close) and ``reason``.

    A point has either a shape or a reason: ``missing_code``, ``malformed_code``,
    ``continue_without_start``, ``end_without_start``, ``duplicate_start`` or ``unclosed_figure``.
    """
    known = commands(points)
    plain = runs_of(known, F.when(F.col("kind") == "plain", F.col("base"))).where("kind = 'plain'").withColumn("closed", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))

    order = Window.partitionBy("survey", "base", "figure").orderBy("ord")
    turns = F.when(F.col("command") != "continue", F.col("command"))
    before = F.last(turns, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_ = F.coalesce(before == "start", F.lit(False))
    starts = (F.col("command") == "start") & ~open_
    figures = known.where("kind = 'figure'").withColumns({"_open": open_, "_starts": starts})
    shape = F.last(F.when(F.col("_starts"), F.col("ord")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    wrong = F.when((F.col("command") == "start") & F.col("_open"), "duplicate_start").when(~F.col("_open") & (F.col("command") == "continue"), "continue_without_start").when(~F.col("_open") & F.col("command").isin("end", "close"), "end_without_start")
    figures = figures.withColumn("reason", wrong).withColumn("shape", F.when(F.col("reason").isNull(), shape))
    ends = F.max(F.when(F.col("reason").isNull() & F.col("command").isin("end", "close"), F.col("command"))).over(Window.partitionBy("survey", "base", "figure", "shape"))
    figures = figures.withColumn("_ends", ends).withColumn("closed", F.coalesce(F.col("shape").isNotNull() & (F.col("_ends") == "close"), F.lit(False)))
    unclosed = F.col("shape").isNotNull() & F.col("_ends").isNull()
    figures = figures.withColumn("reason", F.when(unclosed, "unclosed_figure").otherwise(F.col("reason"))).withColumn("shape", F.when(~unclosed, F.col("shape")))
    rest = known.where("kind in ('none', 'malformed')").withColumns({"shape": F.lit(None).cast("long"), "closed": F.lit(False), "reason": F.when(F.col("kind") == "none", "missing_code").otherwise("malformed_code")})
    columns = [*points.columns, "kind", "base", "figure", "shape", "closed", "reason"]
    return plain.select(*columns).union(figures.select(*columns)).union(rest.select(*columns))


def _shapes(assembled: DataFrame) -> DataFrame:
    """One row per run or figure: its vertices in order."""
    vertex = F.struct("ord", "id", "x", "y", "z")
    grouped = assembled.where("shape is not null").groupBy("survey", "base", "figure", "shape")
    return grouped.agg(F.sort_array(F.collect_list(vertex)).alias("vertices"), F.max("ord").alias("last"), F.max("closed").alias("closed"))


def is_closed(vertices: Column, tolerance: float) -> Column:
    """Whether the first and the last vertex are at most ``tolerance`` apart in plan."""
    first, last = F.element_at(vertices, 1), F.element_at(vertices, -1)
    return F.hypot(first["x"] - last["x"], first["y"] - last["y"]) <= tolerance


def build(points: DataFrame, catalog: DataFrame, tolerance: float = 0.0, grammar: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(features, ground, diagnostics)`` of coded points under ``catalog(code, name, geometry_type, feature_type, category, layer, closed)``.

    Features come one a point for point and symbol codes and one a run or figure for lines and
    polygons, numbered from 1 in the order in which they end; ``closed`` if the code says so, a close
    ended it, or the ends meet within the tolerance.  Diagnostics give every run, figure or point that made none, and
    why.  Without ``grammar`` only runs of base codes (what stands before the first dot) are looked at.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    if not grammar:
        points = points.withColumn("code", F.split("code", r"\.")[0])
    assembled = assemble(points)
    known = catalog.select(F.upper("code").alias("base"), "name", "geometry_type", "feature_type", "category", "layer", F.col("closed").alias("_always"))
    shapes = _shapes(assembled).join(known, "base", "left")
    size, kind = F.size("vertices"), F.col("geometry_type")
    reason = F.when(kind.isNull(), "unregistered_code").when(((kind == "line") & (size < 2)) | ((kind == "polygon") & (size < 3)), "insufficient_points")
    judged = shapes.withColumn("reason", reason)
    ground = judged.where("geometry_type = 'ground'").select("survey", F.explode("vertices").alias("v")).select("survey", "v.*")
    lines = judged.where("reason is null and geometry_type in ('line', 'polygon')").withColumn("closed", F.col("closed") | F.coalesce("_always", F.lit(False)) | is_closed(F.col("vertices"), tolerance))
    singles = judged.where("geometry_type in ('point', 'symbol')").withColumn("v", F.explode("vertices")).withColumns({"vertices": F.array("v"), "last": F.col("v.ord"), "closed": F.lit(False)})
    wanted = ["survey", "last", F.col("base").alias("code"), "name", "layer", "category", "feature_type", _lookup(CATALOG_GEOMETRY, F.col("geometry_type")).alias("geometry_type"), "vertices", "closed"]
    features = renumber(lines.select(*wanted).union(singles.select(*wanted)), "survey", "last", "code").drop("last")
    whole = judged.where("reason is not null").select("survey", F.col("base").alias("code"), "reason", F.size("vertices").cast("long").alias("points"), F.col("shape").alias("first"))
    lone = assembled.where("reason is not null and reason <> 'unclosed_figure'").select("survey", F.when(F.col("kind") == "figure", F.concat_ws(".", "base", "figure")).otherwise(F.col("code")).alias("code"), "reason", F.lit(1).cast("long").alias("points"), F.col("ord").alias("first"))
    left = assembled.where("reason = 'unclosed_figure'").groupBy("survey", F.concat_ws(".", "base", "figure").alias("code"), "reason").agg(F.count("*").alias("points"), F.min("ord").alias("first"))
    return features, ground, whole.union(lone).union(left)


def renumber(features: DataFrame, within: str, order: str, *then: str, out: str = "feature_id") -> DataFrame:
    """Ids from 1 within ``within`` in the given order, whose first column is a whole number."""
    return numbered(materialise(features, "renumber"), within, order, out, *then)


def bounds(features: DataFrame) -> DataFrame:
    """``features`` with the least and greatest x, y and z of their vertices."""
    at = {f"{n}_{a}": f(F.col(f"vertices.{a}")) for a in "xyz" for n, f in (("min", F.array_min), ("max", F.array_max))}
    return features.withColumns(at)


def collection_bounds(features: DataFrame) -> DataFrame:
    """The box around all features; nulls where there is none."""
    return bounds(features).agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def by_type(features: DataFrame, feature_type: str) -> DataFrame:
    return features.where(F.col("feature_type") == feature_type)


def by_category(features: DataFrame, category: str) -> DataFrame:
    return features.where(F.col("category") == category)


def extend(features: DataFrame, other: DataFrame) -> DataFrame:
    return features.unionByName(other)


def issues(features: DataFrame, allowed: dict[str, list[str]] | None = None) -> Column:
    """What is wrong with a feature: ``vertices`` (too few for its geometry), ``finite``, ``confidence`` (not in 0 to 1)
    or ``geometry`` (none that ``allowed`` lists for its type).  A feature without such a column passes that check."""
    far = F.exists("vertices", lambda v: F.greatest(F.abs(v["x"]), F.abs(v["y"]), F.abs(v["z"])) == float("inf")) | F.exists("vertices", lambda v: F.isnan(v["x"]) | F.isnan(v["y"]) | F.isnan(v["z"]))
    least = F.coalesce(_lookup(LEAST_VERTICES, F.col("geometry_type")), F.lit(1))
    found = [F.when(F.size("vertices") < least, "vertices"), F.when(far, "finite")]
    if "confidence" in features.columns:
        found.append(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"))
    if allowed:
        known = F.element_at(F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("feature_type"))
        found.append(F.when(~F.coalesce(F.array_contains(known, F.col("geometry_type")), F.lit(True)), "geometry"))
    return F.array_compact(F.array(*found))
