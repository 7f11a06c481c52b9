"""Catalog files, registries, features' faults, chains and facades."""

import pytest
from pyspark.sql import functions as F

from cragspan import facade, workflow
from cragspan.operators import figures, lines, segments
from cragspan.sources import catalogs

CSV = "code,name,geometry_type,feature_type,category,layer,closed,aliases\nA,Tree,POINT,tree,vegetation,L1,no,a1; a2\nB,Plot,polygon,plot,cadastre,L2,Sí,\nC,,blob,,terrain,,maybe,\n"


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CSV)
    got = {r.code: r for r in catalogs.read_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got["A"].aliases == ["a1", "a2"] and got["A"].closed is False and got["A"].issues == [] and got["B"].closed is True
    assert got["C"].issues == ["missing_name", "missing_layer", "geometry_type", "closed", "feature_type"]
    with pytest.raises(ValueError, match="C: missing_name"):
        catalogs.definitions(catalogs.read_csv(spark, str(tmp_path / "c.csv")))
    (tmp_path / "c.json").write_text('[{"code": "A", "name": "Tree", "geometry_type": "point", "feature_type": "tree", "category": "v", "layer": "L"}]')
    known = catalogs.definitions(catalogs.read_json(spark, str(tmp_path / "c.json")))
    assert [(r.code, r.closed, r.aliases) for r in known.collect()] == [("A", False, [])]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("- {code: A, name: Tree, geometry_type: point, feature_type: tree, category: v, layer: L}\n")
    again = catalogs.definitions(catalogs.read_yaml(spark, str(tmp_path / "c.yaml")))
    assert catalogs.register(known, again).count() == 1
    other = again.withColumn("layer", F.lit("M"))
    with pytest.raises(ValueError, match="defined twice: A"):
        catalogs.register(known, other)
    assert [r.layer for r in catalogs.register(known, other, overwrite=True).collect()] == ["M"]
    (tmp_path / "d.csv").write_text("code,name\nA,b\n")
    with pytest.raises(ValueError, match="lacks category, feature_type"):
        catalogs.read_csv(spark, str(tmp_path / "d.csv"))


def test_feature_faults(spark):
    rows = [(1, "point", [(0.0, 0.0, 0.0)], 0.5, "tree"), (2, "polygon", [(0.0, 0.0, 0.0)] * 2, 2.0, "plot"), (3, "polyline", [(float("inf"), 0.0, 0.0)] * 2, None, "plot")]
    df = spark.createDataFrame(rows, "id int, geometry_type string, vertices array<struct<x:double,y:double,z:double>>, confidence double, feature_type string")
    got = {r.id: r.faults for r in df.select("id", figures.issues(df, {"plot": ["polygon"]}).alias("faults")).collect()}
    assert got == {1: [], 2: ["vertices", "confidence"], 3: ["finite", "confidence", "geometry"]}
    with pytest.raises(ValueError, match="negative"):
        figures.build(df, df, -1.0)


def test_walks_use_every_edge_once():
    paths = list(lines.walk([(1, 2), (2, 3), (3, 4), (3, 5), (7, 8), (8, 9), (9, 7)]))
    assert paths == [[1, 2, 3], [3, 4], [3, 5], [7, 8, 9, 7]]


def test_contours_close(spark):
    ring = [(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 2.0, 2.0, 0.0), (3, 0.0, 2.0, 0.0), (4, 1.0, 1.0, 10.0)]
    v = spark.createDataFrame(ring, "vid long, x double, y double, z double")
    t = spark.createDataFrame([(k, k, (k + 1) % 4, 4) for k in range(4)], "tid long, v0 long, v1 long, v2 long")
    from cragspan.operators import terrain

    got = lines.contour_lines(terrain.corners(v, t), 4.0).orderBy("level").collect()
    assert [(r.level, r.closed, len(r.vertices)) for r in got if r.level > 0] == [(4.0, True, 5), (8.0, True, 5)]
    assert abs(got[-1].length - 8 * 0.2) < 1e-9


def test_two_planes_are_two_regions(spark):
    flat = [(float(x) / 4, float(y) / 4, 0.0) for x in range(12) for y in range(12)]
    wall = [(20.0, float(y) / 4, 5.0 + float(z) / 4) for y in range(12) for z in range(12)]
    cloud = spark.createDataFrame([(k, *p) for k, p in enumerate(flat + wall)], "pid long, x double, y double, z double")
    got = {r.pid: r.segment for r in segments.region_growing(cloud, 9, 0.05, 15.0, 10).collect()}
    assert {got[k] for k in range(144)} == {0} and {got[k] for k in range(144, 288)} == {144}


def test_facade_and_workflow(spark, tmp_path):
    cloud = spark.createDataFrame([(k, float(k), 0.0, float(k % 3)) for k in range(30)], "pid long, x double, y double, z double")
    assert facade.run("sampling", "uniform", cloud, 10).count() == 3
    with pytest.raises(ValueError, match="one of"):
        facade.run("sampling", "nothing", cloud)
    seen = []
    flow = workflow.Workflow(spark, seen.append)
    flow.put("cloud", cloud)
    flow.stage("thin", ["cloud"], "thinned", lambda c: c.where("pid % 2 = 0"))
    assert flow.get("thinned").count() == 15 and flow.versions() == {"cloud": 1, "thinned": 1} and not flow.stale("thinned")
    flow.put("cloud", cloud.where("pid < 4"))
    assert flow.stale("thinned") and flow.versions()["cloud"] == 2
    with pytest.raises(ZeroDivisionError):
        flow.stage("broken", ["thinned"], "nothing", lambda c: 1 / 0)
    assert [(r.stage, r.status, r.rows) for r in flow.history().orderBy("number").collect()] == [("thin", "done", 15), ("broken", "failed", None)]
    assert [e[:2] for e in seen] == [("thin", "started"), ("thin", "done"), ("broken", "started"), ("broken", "failed")]
