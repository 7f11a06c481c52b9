"""LandXML read from a small file; LAS, XYZ and DXF written and read back."""

import pytest

from cragspan.sinks import files
from cragspan.sources import binary, landxml, text

SURFACE = """<Surface name="{n}"><Definition surfType="TIN"><Pnts><P id="1">0.0 1.0 2.0</P><P id="2">10.0 11.0 12.0</P><P id="5">20.0 -5.0</P></Pnts>
<Faces><F>1 2 5</F><F i="1">1 2 5</F></Faces></Definition></Surface>"""
REST = """<Units><Imperial linearUnit="foot"/></Units><CoordinateSystem name="local" epsgCode="25830"/><CgPoints name="g"><CgPoint name="A" code="TREE">1 2 3</CgPoint><CgPoint name="B" pntRef="A"/></CgPoints>
<Alignments><Alignment name="road"><CoordGeom/><Profile><ProfAlign name="fg"><PVI>0 100</PVI><ParaCurve length="40">100 102</ParaCurve><PVI>200 101</PVI></ProfAlign></Profile></Alignment></Alignments>"""


def _file(tmp_path, names):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><LandXML version="1.2">' + REST + "<Surfaces>" + "".join(SURFACE.format(n=n) for n in names) + "</Surfaces></LandXML>")
    return str(tmp_path / "a.xml")


@pytest.mark.parametrize("names", [["one"], ["one", "two"], []])
def test_surfaces(spark, tmp_path, names):
    vertices, triangles = landxml.read_surfaces(spark, _file(tmp_path, names))
    assert sorted(map(tuple, vertices.collect())) == sorted((n, *v) for n in names for v in [(1, 1.0, 0.0, 2.0), (2, 11.0, 10.0, 12.0), (5, -5.0, 20.0, 0.0)])
    assert sorted(map(tuple, triangles.collect())) == [(n, 1, 2, 5) for n in names]
    assert landxml.surface_issues(vertices, triangles).count() == 0
    issues = landxml.surface_issues(vertices.where("vid <> 5").union(vertices.where("vid = 1")), triangles)
    assert sorted(map(tuple, issues.collect())) == sorted(row for n in names for row in [(n, "repeated id", 1), (n, "unknown corner", 5)])


def test_points_profiles_units(spark, tmp_path):
    path = _file(tmp_path, ["s"])
    assert [tuple(r) for r in landxml.read_points(spark, path).collect()] == [("A", "TREE", 2.0, 1.0, 3.0)]
    assert [tuple(r) for r in landxml.read_profiles(spark, path).orderBy("station").collect()] == [("road", "fg", 0.0, 100.0, 0.0), ("road", "fg", 100.0, 102.0, 40.0), ("road", "fg", 200.0, 101.0, 0.0)]
    assert tuple(landxml.read_units(spark, path).first()) == ("foot", "local", 25830)
    with pytest.raises(Exception, match="not a position"):
        spark.createDataFrame([("1 two",)], "t string").select(*landxml.position(landxml.F.col("t"))).collect()


def test_las_round_trip(spark, tmp_path):
    rows = [(float(i), -i / 8, i * 1.25, i * 10, i % 3 + 1, 3, i % 7) for i in range(50)]
    cloud = spark.createDataFrame(rows, "x double, y double, z double, intensity int, return_number short, number_of_returns short, classification short").repartition(3)
    done = files.write_las(cloud, str(tmp_path / "las"), most=10).collect()
    assert sum(r.rows for r in done) == 50 and max(r.rows for r in done) <= 10
    got = [tuple(r)[1:8] for f in done for r in binary.read_las(spark, str(tmp_path / "las" / f.file)).collect()]
    assert sorted((round(r[0], 6), round(r[1], 6), round(r[2], 6), *r[3:]) for r in got) == sorted(rows)
    with pytest.raises(ValueError, match="not empty"):
        files.write_las(cloud, str(tmp_path / "las"))
    with pytest.raises(Exception, match="does not fit"):
        files.write_las(cloud.selectExpr("cast(null as double) as x", "y", "z"), str(tmp_path / "null"))


def test_xyz_round_trip(spark, tmp_path):
    cloud = spark.createDataFrame([(1.5, 2.25, -3.0), (1e-7, 5.0, 1e9)], "x double, y double, z double")
    files.write_xyz(cloud, str(tmp_path / "xyz"))
    assert sorted(map(tuple, text.read_xyz(spark, str(tmp_path / "xyz")).collect())) == sorted(map(tuple, cloud.collect()))


def test_dxf(spark, tmp_path):
    schema = "geometry_type string, vertices array<struct<x double, y double, z double>>, closed boolean, faces array<array<int>>, layer string"
    at = [(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 1.0)]
    up = [(0.0, 0.0, 1.0), (1.0, 0.0, 2.0)]
    rows = [("POINT", at[:1], None, None, "P"), ("polygon", at, True, None, "G"), ("polyline", up, False, None, "L"), ("mesh", at, None, [[0, 1, 2]], "M")]
    files.write_dxf(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "dxf"))
    lines = next((tmp_path / "dxf").glob("*.dxf")).read_text().split("\n")
    tags = list(zip(lines[::2], lines[1::2], strict=False))
    assert [v for c, v in tags if c == "0"] == ["SECTION", "POINT", "LWPOLYLINE", "POLYLINE", "VERTEX", "VERTEX", "SEQEND", "3DFACE", "ENDSEC", "EOF"]
    assert [v for c, v in tags if c == "38"] == ["1.0"] and [v for c, v in tags if c == "13"] == ["1.0"] and [v for c, v in tags if c == "70"][:2] == ["1", "8"]
    with pytest.raises(Exception, match="no entity"):
        files.write_dxf(spark.createDataFrame([("mesh", at, None, [], "M")], schema), str(tmp_path / "bad"))
