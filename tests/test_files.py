"""Text with headers, numbered lines, LandXML alignments and round trips, GeoPackage files, extended data."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragspan.sinks import extended, geopackage
from cragspan.sinks import landxml as landxml_out
from cragspan.sources import binary, landxml, lines, text


def _file(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_tables_of_text(spark, tmp_path):
    path = _file(tmp_path, "a.txt", "# survey\n\nEasting;Northing;Height;Intensity;r;g;b;Note;Run\n1;2;3;7;1;2;3;x;4\n// no\n4;5;6;65535;4;5;6;;5\n")
    got = text.read_table(spark, path)
    assert got.dtypes[:4] == [("x", "double"), ("y", "double"), ("z", "double"), ("intensity", "int")] and dict(got.dtypes)["run"] == "int"
    assert [(r.x, r.intensity, r.note, r.color.green) for r in got.orderBy("x").collect()] == [(1.0, 7, "x", 2), (4.0, 65535, None, 5)]
    assert text.sniff(spark, _file(tmp_path, "b.txt", "1 2 3\n")) == (" ", None)
    with pytest.raises(ValueError, match="no header"):
        text.read_table(spark, str(tmp_path / "b.txt"))
    assert text.read_table(spark, str(tmp_path / "b.txt"), ["x", "y", "z"]).count() == 1
    with pytest.raises(Exception, match="out of range"):
        text.read_table(spark, _file(tmp_path, "c.txt", "x,y,z,classification\n1,2,3,256\n")).collect()


def test_survey_with_header(spark, tmp_path):
    path = _file(tmp_path, "s.csv", 'Punto,Este,Norte,Z,Descripcion\n7,1,2,3,"WALL, north"\n,4,5,6,\n')
    got = text.read_survey_table(spark, path).orderBy("ord").collect()
    assert [(r.ord, r.id, r.x, r.code) for r in got] == [(1, "7", 1.0, "WALL, north"), (2, "2", 4.0, None)]


def test_pts_keeps_colours(spark, tmp_path):
    got = text.read_pts(spark, _file(tmp_path, "p.pts", "2\n1 2 3 -5 9 8 7\n4 5 6 5 1 2 3\n")).orderBy("x").collect()
    assert [(r.z, r.intensity, r.blue) for r in got] == [(3.0, -5.0, 7), (6.0, 5.0, 3)]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    path = _file(tmp_path, "n.txt", "\n".join(str(k) for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = lines.numbered_lines(spark, path)
        assert got.rdd.getNumPartitions() > 3
        assert got.where("cast(value as long) <> line").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


ROAD = """<?xml version="1.0"?><LandXML><Alignments><Alignment name="a" staStart="100"><CoordGeom>
<Curve rot="ccw" radius="10" length="15.707963267948966"><Start>0 10</Start><Center>10 10</Center><End>10 20</End></Curve>
<Line length="10"><Start>0 0</Start><End>0 10</End></Line><Spiral rot="cw" radiusStart="INF" radiusEnd="50" length="5"><Start>10 20</Start><PI>12 20</PI><End>15 20.1</End></Spiral>
</CoordGeom></Alignment></Alignments></LandXML>"""


def test_alignments(spark, tmp_path):
    got = landxml.read_alignments(spark, _file(tmp_path, "r.xml", ROAD)).orderBy("start").collect()
    assert [(r.kind, round(r.start, 6), r.radius, r.radius_end) for r in got] == [("line", 100.0, None, None), ("arc", 110.0, 10.0, 10.0), ("spiral", 125.707963, None, -50.0)]
    assert [round(r.heading, 6) for r in got] == [0.0, 0.0, round(math.pi / 2, 6)]
    with pytest.raises(Exception, match="not a radius"):
        spark.createDataFrame([("-INF",)], "t string").select(landxml.radius(F.col("t"))).collect()


def test_landxml_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, 1.5, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (2, 7.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 1, 2)], "v0 long, v1 long, v2 long")
    landxml_out.write_surface(v, t, str(tmp_path / "s"), "a<b")
    points, faces = landxml.read_surfaces(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, points.collect())) == [("a<b", 1, 1.5, 2.0, 3.0), ("a<b", 2, 4.0, 5.0, 6.0), ("a<b", 3, 7.0, 1.0, 0.0)]
    assert [tuple(r) for r in faces.collect()] == [("a<b", 1, 2, 3)]
    landxml_out.write_points(v.select(F.concat(F.lit("p&"), "vid").alias("name"), F.lit(None).cast("string").alias("code"), "x", "y", "z"), str(tmp_path / "p"))
    assert sorted(r.name for r in landxml.read_points(spark, str(tmp_path / "p")).collect()) == ["p&0", "p&1", "p&2"]


def test_geopackage(spark, tmp_path):
    square = [(0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (4.0, 3.0, 1.0)]
    rows = [(1, "tree", "vegetation", "point", square[:1], False, None, 0.5, {"survey_code": "T", "height": "9"}), (2, "plot", "cadastre", "polygon", square, True, None, 1.0, {}), (3, "roof", "building", "mesh", square, False, [[0, 1, 2]], None, None)]
    schema = "feature_id long, feature_type string, category string, geometry_type string, vertices array<struct<x:double,y:double,z:double>>, closed boolean, faces array<array<int>>, confidence double, attributes map<string,string>"
    features = spark.createDataFrame(rows, schema).coalesce(1)
    done = geopackage.write(features, str(tmp_path / "g"), 32630).collect()
    base = sqlite3.connect(tmp_path / "g" / done[0].file)
    assert base.execute("SELECT table_name, min_x, max_y FROM gpkg_contents ORDER BY 1").fetchall() == [("building_multipolygon", 0.0, 3.0), ("cadastre_polygon", 0.0, 3.0), ("vegetation_point", 0.0, 0.0)]
    geom, code, rest = base.execute("SELECT geom, survey_code, attributes_json FROM vegetation_point").fetchone()
    assert struct.unpack("<2sBBiBI3d", geom) == (b"GP", 0, 1, 32630, 1, 1001, 0.0, 0.0, 1.0) and code == "T" and rest == '{"height":"9"}'
    assert base.execute("SELECT count(*) FROM rtree_cadastre_polygon_geom").fetchone() == (1,)
    assert geopackage.table_bounds(features).count() == 3
    faulty = features.withColumn("closed", F.lit(False))
    assert {tuple(r[0]) for r in faulty.select(geopackage.issues(faulty)).collect()} == {(), ("open_polygon",)}
    with pytest.raises(Exception, match="open_polygon"):
        geopackage.write(faulty, str(tmp_path / "h"), 4326)
    for code in (0, -1, 27700):
        with pytest.raises(ValueError, match="code"):
            geopackage.resolve(code)


def test_extended_data(spark):
    tags = extended.encode({"a": True, "n": 3, "r": 1.5, "s": "x", "l": [1, 2]})
    assert tags[:4] == [(1000, "a"), (1070, 1), (1000, "n"), (1071, 3)]
    assert extended.decode(tags) == {"a": True, "n": 3, "r": 1.5, "s": "x", "l": "[1,2]"}
    with pytest.raises(TypeError, match="extended data"):
        extended.encode({"bad": object()})
    df = spark.createDataFrame([("tree", None, 10.0, {"k": "v"}), ("odd", "OWN", 12.0, {})], "t string, own string, z double, m map<string,string>")
    got = df.select(extended.layer(F.col("t"), F.col("own")), extended.contour_layer(F.col("z"), 0.0, 2.0), extended.extended(F.col("m"), "APP")).collect()
    assert [tuple(r) for r in got] == [("TREES", "TOPO_CONTOURS_MAJOR", "1001\nAPP\n1000\nk\n1000\nv\n"), ("OWN", "TOPO_CONTOURS_MINOR", "")]


def test_ply_lines(spark, tmp_path):
    path = _file(tmp_path, "a.ply", "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert [(r.pid, r.x) for r in binary.read_ply(spark, path).orderBy("pid").collect()] == [(0, 1.0), (1, 4.0)]


def test_alignments_round_trip(spark, tmp_path):
    """Line, spiral into a left arc, arc, spiral out of it, line; and an alignment of a right-hand arc."""
    rows, x, y, h, at = [], 5.0, -3.0, 0.3, 100.0
    for kind, length, r0, r1 in (("line", 20.0, None, None), ("spiral", 12.0, None, 40.0), ("arc", 25.0, 40.0, 40.0), ("spiral", 15.0, 40.0, None), ("line", 9.0, None, None)):
        rows.append(("a<&", kind, at, length, x, y, h, r0, r1))
        steps = 20_000
        k0, k1 = (1 / r if r else 0.0 for r in (r0, r1))
        s = (np.arange(steps) + 0.5) * length / steps
        way = h + k0 * s + (k1 - k0) * s * s / (2 * length)
        x, y, h, at = x + float(np.cos(way).sum()) * length / steps, y + float(np.sin(way).sum()) * length / steps, h + length * (k0 + k1) / 2, at + length
    rows.append(("b", "arc", 0.0, 10.0, 1.0, 2.0, -1.0, -30.0, -30.0))
    elements = spark.createDataFrame(rows, "alignment string, kind string, start double, length double, x double, y double, heading double, radius double, radius_end double")
    landxml_out.write_alignments(elements, str(tmp_path / "r"))
    got = sorted(map(tuple, landxml.read_alignments(spark, str(tmp_path / "r")).collect()))
    assert [g[:2] for g in got] == [r[:2] for r in sorted(rows)]
    for g, r in zip(got, sorted(rows), strict=True):
        for a, b in zip(g[2:], r[2:], strict=True):
            assert (a is None and b is None) or abs(a - b) < 1e-6
    with pytest.raises(Exception, match="can't be written"):
        landxml_out.write_alignments(elements.withColumn("kind", F.lit("loop")), str(tmp_path / "no"))
