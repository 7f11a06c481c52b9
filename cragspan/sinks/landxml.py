"""LandXML files of surfaces, named points and alignments: a surface a file."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.operators.alignment import clothoid
from cragspan.sinks.files import _write

#: The root of a document and its end.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">\n<Units><Metric linearUnit="{unit}"/></Units>\n'
TAIL = "</LandXML>\n"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _position(places: int) -> Column:
    """North, east and elevation of a row."""
    return F.concat_ws(" ", *[F.format_string(f"%.{places}f", F.col(a).cast("double")) for a in ("y", "x", "z")])


def write_surface(vertices: DataFrame, triangles: DataFrame, folder: str, name: str, unit: str = "meter", places: int = 10) -> DataFrame:
    """One surface of ``vertices(vid, x, y, z)`` and ``triangles(v0, v1, v2)`` as a file; ids are the vertices' plus one, so that they begin at 1.

    Points come before faces, both in the order of their ids.  A file is one text, so one task writes it.
    """
    point = F.concat(F.lit('<P id="'), (F.col("vid") + 1).cast("string"), F.lit('">'), _position(places), F.lit("</P>\n"))
    face = F.concat(F.lit("<F>"), F.concat_ws(" ", *[(F.col(f"v{k}") + 1).cast("string") for k in range(3)]), F.lit("</F>\n"))
    rows = vertices.select(F.lit(0).alias("part"), F.col("vid").alias("at"), point.alias("text")).union(triangles.select(F.lit(1), F.col("v0"), face))

    def encode(frame) -> bytes:
        parts = ["".join(frame["text"][frame["part"] == k]) for k in (0, 1)]
        title = name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        return (HEAD.format(unit=unit) + f'<Surfaces><Surface name="{title}"><Definition surfType="TIN">\n<Pnts>\n{parts[0]}</Pnts>\n<Faces>\n{parts[1]}</Faces>\n</Definition></Surface></Surfaces>\n' + TAIL).encode()

    return _write(rows.repartition(1).sortWithinPartitions("part", "at"), folder, "xml", encode, 2**62)


def write_points(points: DataFrame, folder: str, group: str = "points", unit: str = "meter", places: int = 10, most: int = 100_000) -> DataFrame:
    """Files of named points ``(name, code, x, y, z)``; a null code is left out."""
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit(' code="'), _escaped(F.col("code")), F.lit('"'))).otherwise("")
    text = F.concat(F.lit('<CgPoint name="'), _escaped(F.col("name")), F.lit('"'), code, F.lit(">"), _position(places), F.lit("</CgPoint>\n"))
    encode = lambda frame: (HEAD.format(unit=unit) + f'<CgPoints name="{group}">\n' + "".join(frame["text"]) + "</CgPoints>\n" + TAIL).encode()
    return _write(points.select(text.alias("text")), folder, "xml", encode, most)


def _element_end() -> tuple[Column, Column, Column]:
    """Where a row's element ends, and its heading there; a spiral is straight at one of its ends."""
    h, length, x, y = F.col("heading"), F.col("length"), F.col("x"), F.col("y")
    bend, last = (F.coalesce(F.try_divide(F.lit(1.0), F.col(c)), F.lit(0.0)) for c in ("radius", "radius_end"))
    out = h + length * F.when(F.col("kind") == "arc", bend).when(F.col("kind") == "spiral", (bend + last) / 2).otherwise(0.0)
    r = F.col("radius")
    arc = (x + r * (F.sin(out) - F.sin(h)), y + r * (F.cos(h) - F.cos(out)))
    u, v = clothoid(length, F.coalesce("radius_end", F.lit(float("inf"))), length)
    into = (x + u * F.cos(h) - v * F.sin(h), y + u * F.sin(h) + v * F.cos(h))
    u, v = clothoid(length, -F.coalesce(r, F.lit(float("inf"))), length)
    back = out + math.pi  # a spiral that ends straight is one that begins straight, run backwards
    leaving = (x - u * F.cos(back) + v * F.sin(back), y - u * F.sin(back) - v * F.cos(back))
    line = (x + length * F.cos(h), y + length * F.sin(h))
    ends = [F.when(F.col("kind") == "arc", a).when((F.col("kind") == "spiral") & r.isNull(), i).when(F.col("kind") == "spiral", o).otherwise(s) for a, i, o, s in zip(arc, into, leaving, line, strict=True)]
    return ends[0], ends[1], out


def write_alignments(elements: DataFrame, folder: str, unit: str = "meter", places: int = 10, most: int = 1_000) -> DataFrame:
    """Files of alignments of ``elements(alignment, kind, start, length, x, y, heading, radius, radius_end)``, as they are read.

    An element ends where the next of its alignment starts, the last one where it leads to.  A spiral between two bends raises, as
    does an arc without a radius and any other kind.  An alignment is one text.
    """
    order = Window.partitionBy("alignment").orderBy("start")
    ex, ey, out = _element_end()
    spiral, arc, line = (F.col("kind") == k for k in ("spiral", "arc", "line"))
    known = line | (arc & (F.col("radius") != 0)) | (spiral & (F.col("radius").isNull() | F.col("radius_end").isNull()))
    laid = elements.withColumns({"_ex": ex, "_ey": ey, "_out": out})
    laid = laid.withColumns({"_x1": F.coalesce(F.lead("x").over(order), "_ex"), "_y1": F.coalesce(F.lead("y").over(order), "_ey")})

    def at(tag: str, x: Column, y: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), F.concat_ws(" ", *[F.format_string(f"%.{places}f", v) for v in (y, x)]), F.lit(f"</{tag}>"))

    def size(v: Column) -> Column:
        return F.when(v.isNull(), "INF").otherwise(F.format_string(f"%.{places}f", F.abs(v)))

    x, y, h, r = (F.col(c) for c in ("x", "y", "heading", "radius"))
    start, end = at("Start", x, y), at("End", F.col("_x1"), F.col("_y1"))
    length = F.concat(F.lit(' length="'), F.format_string(f"%.{places}f", "length"), F.lit('"'))
    rot = F.when(F.coalesce("radius", "radius_end") < 0, ' rot="cw"').otherwise(' rot="ccw"')
    centre = at("Center", x - r * F.sin(h), y + r * F.cos(h))
    far = F.coalesce(F.try_divide((F.col("_x1") - x) * F.sin("_out") - (F.col("_y1") - y) * F.cos("_out"), F.sin(F.col("_out") - h)), F.col("length") / 2)
    corner = at("PI", x + far * F.cos(h), y + far * F.sin(h))
    text = F.when(line, F.concat(F.lit("<Line"), length, F.lit(">"), start, end, F.lit("</Line>")))
    text = text.when(arc, F.concat(F.lit("<Curve"), rot, F.lit(' radius="'), size(r), F.lit('"'), length, F.lit(">"), start, centre, end, F.lit("</Curve>")))
    text = text.otherwise(F.concat(F.lit("<Spiral"), rot, length, F.lit(' radiusStart="'), size(r), F.lit('" radiusEnd="'), size(F.col("radius_end")), F.lit('">'), start, corner, end, F.lit("</Spiral>")))
    told = laid.select("alignment", "start", "length", F.when(F.coalesce(known, F.lit(False)), text).otherwise(F.raise_error(F.lit("an element can't be written"))).alias("text"))
    whole = told.groupBy("alignment").agg(F.min("start").alias("first"), F.sum("length").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda e: e["text"]), "\n").alias("text"))
    head = F.concat(F.lit('<Alignment name="'), _escaped(F.col("alignment").cast("string")), F.lit('"'), length, F.lit(' staStart="'), F.format_string(f"%.{places}f", "first"), F.lit('">'))
    rows = whole.select(F.concat(head, F.lit("<CoordGeom>\n"), F.col("text"), F.lit("\n</CoordGeom></Alignment>\n")).alias("text"))
    encode = lambda frame: (HEAD.format(unit=unit) + "<Alignments>\n" + "".join(frame["text"]) + "</Alignments>\n" + TAIL).encode()
    return _write(rows, folder, "xml", encode, most)
