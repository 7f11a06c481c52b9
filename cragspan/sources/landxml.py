"""LandXML surfaces, named points and profiles through Spark's XML reader; positions are written as north, east and elevation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_P = "_id string, _VALUE string"
_F = "_i string, _VALUE string"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, mode="FAILFAST").schema(schema).load(path)


def position(text: Column) -> tuple[Column, Column, Column]:
    """x, y and z of ``north east [elevation]``; without an elevation z is 0, and anything else raises."""
    parts = F.split(F.trim(text), r"\s+")
    bad = F.raise_error(F.concat(F.lit("not a position: "), F.coalesce(text, F.lit("null")))).cast("double")
    numbers = F.transform(parts, lambda v: v.try_cast("double"))
    fits = (F.size(parts).between(2, 3)) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    take = lambda k: F.when(fits, F.get(numbers, F.lit(k))).otherwise(bad)
    return take(1), take(0), F.coalesce(take(2), F.lit(0.0))


def _named(text: Column) -> list[Column]:
    return [v.alias(a) for a, v in zip("xyz", position(text), strict=True)]


def read_surfaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(surface, vid, x, y, z)`` and triangles ``(surface, v0, v1, v2)``; vertex ids are the file's.

    With one surface, points and faces are read as rows of their own, so that its size doesn't matter; several surfaces
    are read a row each.  Faces marked invisible (i = 1) stay out, and a face without three corners raises.
    """
    names = [r["_name"] for r in _rows(spark, path, "Surface", "_name string").limit(2).collect()]
    if len(names) == 1:
        points = _rows(spark, path, "P", _P).withColumn("surface", F.lit(names[0]))
        faces = _rows(spark, path, "F", _F).withColumn("surface", F.lit(names[0]))
    else:
        inside = f"Pnts struct<P: array<struct<{_P}>>>, Faces struct<F: array<struct<{_F}>>>"
        whole = _rows(spark, path, "Surface", f"_name string, Definition struct<{inside}>")
        points = whole.select(F.col("_name").alias("surface"), F.inline("Definition.Pnts.P"))
        faces = whole.select(F.col("_name").alias("surface"), F.inline("Definition.Faces.F"))
    corner = F.split(F.trim("_VALUE"), r"\s+")
    three = F.when(F.size(corner) == 3, corner).otherwise(F.raise_error(F.concat(F.lit("a face needs three corners: "), F.col("_VALUE"))))
    seen = faces.where("_i is null or _i <> '1'").withColumn("corner", three)
    return points.select("surface", F.col("_id").cast("long").alias("vid"), *_named(F.col("_VALUE"))), seen.select("surface", *[F.col("corner")[k].cast("long").alias(f"v{k}") for k in range(3)])


def surface_issues(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``(surface, issue, vid)``: vertex ids that occur twice, and corners that are no vertex."""
    twice = vertices.groupBy("surface", "vid").count().where("count > 1").select("surface", F.lit("repeated id").alias("issue"), "vid")
    used = triangles.select("surface", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return twice.union(used.join(vertices, ["surface", "vid"], "left_anti").select("surface", F.lit("unknown corner").alias("issue"), "vid"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Named points ``(name, code, x, y, z)``; those that only refer to another point stay out."""
    rows = _rows(spark, path, "CgPoint", "_name string, _code string, _pntRef string, _VALUE string").where("_pntRef is null")
    return rows.select(F.col("_name").alias("name"), F.col("_code").alias("code"), *_named(F.col("_VALUE")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile points ``(alignment, profile, station, z, length)`` for vertical alignments; length is that of a parabola, else 0."""
    inner = "struct<_name:string,PVI:array<string>,ParaCurve:array<struct<_length:double,_VALUE:string>>>"
    each = _rows(spark, path, "Alignment", f"_name string, Profile array<struct<ProfAlign:array<{inner}>>>")
    lines = each.select(F.col("_name").alias("alignment"), F.explode(F.flatten("Profile.ProfAlign")).alias("p"))
    plain = F.transform(F.coalesce("p.PVI", F.array().cast("array<string>")), lambda v: F.struct(F.lit(0.0).alias("length"), v.alias("at")))
    curves = F.transform(F.coalesce("p.ParaCurve", F.array().cast("array<struct<_length:double,_VALUE:string>>")), lambda v: F.struct(v["_length"].alias("length"), v["_VALUE"].alias("at")))
    spread = lines.select("alignment", F.col("p._name").alias("profile"), F.inline(F.concat(plain, curves)))
    part = F.split(F.trim("at"), r"\s+")
    return spread.select("alignment", "profile", part[0].cast("double").alias("station"), part[1].cast("double").alias("z"), "length")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """``(unit, crs, epsg)`` of the file: its linear unit (metre if none is named) and reference system."""
    unit = _rows(spark, path, "Units", "Metric struct<_linearUnit:string>, Imperial struct<_linearUnit:string>")
    system = _rows(spark, path, "CoordinateSystem", "_name string, _epsgCode string, _desc string")
    one = unit.agg(F.first(F.coalesce("Imperial._linearUnit", "Metric._linearUnit"), True).alias("u"))
    crs = system.agg(F.first(F.coalesce("_name", "_desc"), True).alias("crs"), F.first("_epsgCode", True).cast("int").alias("epsg"))
    return one.join(crs).select(F.coalesce("u", F.lit("meter")).alias("unit"), "crs", "epsg")


def radius(text: Column) -> Column:
    """A radius; INF is infinite, and -INF, 0 and what is no number raise."""
    said = F.upper(F.trim(text))
    v = F.when(said == "INF", F.lit(float("inf"))).otherwise(said.try_cast("double"))
    return F.when(v.isNotNull() & ~F.isnan(v) & (v != 0) & (v > float("-inf")), v).otherwise(F.raise_error(F.concat(F.lit("not a radius: "), F.coalesce(text, F.lit("null")))).cast("double"))


def station(text: Column) -> tuple[Column, Column]:
    """Station and elevation of ``station elevation``."""
    part = F.split(F.trim(text), r"\s+")
    return part[0].try_cast("double"), F.get(part, F.lit(1)).try_cast("double")


_END = "Start string, End string, Center string, PI string"


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Elements ``(alignment, kind, start, length, x, y, heading, radius, radius_end)``: lines, arcs and spirals by the station they start at.

    ``radius`` is positive to the left (counter-clockwise), null on a line; a spiral has those of both ends, null where it is straight.
    Headings are counter-clockwise from east; an arc's follows from its centre, a spiral's from its corner (PI).
    """
    line, curve, spiral = f"array<struct<_length:double,{_typed(_END)}>>", f"array<struct<_length:double,_rot:string,_radius:string,{_typed(_END)}>>", f"array<struct<_length:double,_rot:string,_radiusStart:string,_radiusEnd:string,{_typed(_END)}>>"
    rows = _rows(spark, path, "Alignment", f"_name string, _staStart double, CoordGeom struct<Line:{line},Curve:{curve},Spiral:{spiral}>")

    def side(rot: Column) -> Column:
        return F.when(F.lower(rot) == "cw", -1.0).otherwise(1.0)

    def part(kind: str, length: Column, one: Column, two: Column, e: Column) -> Column:
        xy = [position(e[c])[:2] for c in ("Start", "End")]
        middle = position(F.coalesce(e["Center"], e["PI"], e["End"]))[:2]
        return F.struct(F.lit(kind).alias("kind"), length.alias("length"), one.alias("radius"), two.alias("radius_end"), *[v.alias(f"{a}{k}") for k, p in enumerate(xy) for a, v in zip("xy", p, strict=True)], *[v.alias(f"{a}m") for a, v in zip("xy", middle, strict=True)])

    none = F.lit(None).cast("double")
    flat = lambda e: F.hypot(position(e["End"])[0] - position(e["Start"])[0], position(e["End"])[1] - position(e["Start"])[1])
    bent = lambda t, e: F.when(F.upper(F.trim(t)) != "INF", radius(t) * side(e["_rot"]))
    kinds = [
        F.transform(F.coalesce("CoordGeom.Line", F.array().cast(line)), lambda e: part("line", F.coalesce(e["_length"], flat(e)), none, none, e)),
        F.transform(F.coalesce("CoordGeom.Curve", F.array().cast(curve)), lambda e: part("arc", e["_length"], radius(e["_radius"]) * side(e["_rot"]), radius(e["_radius"]) * side(e["_rot"]), e)),
        F.transform(F.coalesce("CoordGeom.Spiral", F.array().cast(spiral)), lambda e: part("spiral", e["_length"], bent(e["_radiusStart"], e), bent(e["_radiusEnd"], e), e)),
    ]
    each = rows.select(F.col("_name").alias("alignment"), F.coalesce("_staStart", F.lit(0.0)).alias("_from"), F.explode(F.concat(*kinds)).alias("e")).select("alignment", "_from", "e.*")
    turn = F.when(F.col("radius") < 0, -math.pi / 2).otherwise(math.pi / 2)
    heading = F.when(F.col("kind") == "arc", F.atan2(F.col("y0") - F.col("ym"), F.col("x0") - F.col("xm")) + turn).otherwise(F.atan2(F.col("ym") - F.col("y0"), F.col("xm") - F.col("x0")))
    placed = each.withColumn("heading", heading)
    # elements of a kind stand together in the row: each follows the one that ends where it starts
    key = lambda k: F.struct("alignment", *[F.round(F.col(f"{a}{k}"), 5).alias(a) for a in "xy"])
    along = _ordered(placed.withColumns({"_at": key(0), "_to": key(1)}))
    return along.select("alignment", "kind", (F.col("_from") + F.col("_way")).alias("start"), "length", F.col("x0").alias("x"), F.col("y0").alias("y"), "heading", "radius", "radius_end")


def _typed(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":") for f in fields.split(","))


def _ordered(elements: DataFrame) -> DataFrame:
    """Elements of each alignment with ``_way``, the length of those before them, from the one that nothing leads to.  An alignment is one row of the file, and one group here."""

    def follow(pdf):
        ends = dict(zip(pdf["_at"].map(str), pdf.index, strict=True))
        into = set(pdf["_to"].map(str))
        first = [i for i in pdf.index if str(pdf["_at"][i]) not in into] or list(pdf.index[:1])
        at, way, seen = first[0], 0.0, {}
        while at is not None and at not in seen:
            seen[at] = way
            way += pdf["length"][at]
            at = ends.get(str(pdf["_to"][at]))
        out = pdf.loc[list(seen)].copy()
        out["_way"] = list(seen.values())
        return out.drop(columns=["_at", "_to"])

    kept = [c for c in elements.columns if c not in ("_at", "_to")]
    schema = ", ".join(f"{c} {dict(elements.dtypes)[c]}" for c in kept) + ", _way double"
    texts = elements.withColumns({c: F.to_json(c) for c in ("_at", "_to")})
    return texts.groupBy("alignment").applyInPandas(follow, schema)
