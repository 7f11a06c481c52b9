"""Queries against SQL on the smallest tables, and sources on small files."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from cragspan.functions import geodesy
from cragspan.functions import geometry as g
from cragspan.functions import vectors
from cragspan.operators import cloud, neighbours, shape, survey, terrain
from cragspan.plans import every as queries
from cragspan.sources import text
from cragspan.streaming.grids import windowed_density

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _same(rows):
    return sorted((tuple(None if v is None or v != v else float(f"{v:.7g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert _same(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == _same(tuple(r[k] for k in at) for r in want.fetchall())


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# note\n1 2 3\n\n4;5;6\n7, 8, 9\n")
    assert [tuple(r) for r in text.read_xyz(spark, str(tmp_path / "a.xyz")).collect()] == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    (tmp_path / "b.pts").write_text("2\n1 2 3\n4 5 6\n")
    assert text.read_pts(spark, str(tmp_path / "b.pts")).count() == 2
    (tmp_path / "c.pts").write_text("3\n1 2 3\n4 5 6\n")
    with pytest.raises(ValueError):
        text.read_pts(spark, str(tmp_path / "c.pts"))
    (tmp_path / "d.txt").write_text("7,100,200,3,ROAD1\n8,101,201,4,\n")
    assert [tuple(r) for r in text.read_survey(spark, str(tmp_path / "d.txt"), "PNEZD").collect()] == [("7", 200, 100, 3, "ROAD1"), ("8", 201, 101, 4, None)]
    (tmp_path / "e.xyz").write_text("1 2\n")
    with pytest.raises(Exception, match="too few"):
        text.read_xyz(spark, str(tmp_path / "e.xyz")).collect()


def test_empty_cloud(spark):
    none = spark.createDataFrame([], "pid long, x double, y double, z double")
    assert neighbours.knn(none, none, 3).count() == 0
    assert cloud.random_sample(none, 0.5, 1).count() == 0
    assert cloud.voxel_centroid(none, 1.0).count() == 0


def test_codes(spark):
    df = spark.createDataFrame([("RD1.2.S",), ("77",), ("A.1",), ("a.b.c.d",)], "code string")
    got = survey.parse_codes(df).select("base", "figure", "command", g.base_code(df.code).alias("b")).collect()
    assert [tuple(r)[:3] for r in got] == [("RD1", "2", "start"), (None, None, None), ("A", "1", "continue"), (None, None, None)]
    assert got[1].b == "77"


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.5D AS x, 2.5D AS y, 3.0D AS z UNION ALL SELECT timestamp'2024-01-01 01:10:00', 1.2D, 2.2D, 5.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_density(stream, 1.0).writeStream.outputMode("complete").format("memory").queryName("grid").start()
    q.processAllAvailable()
    q.stop()
    assert _same(spark.sql("SELECT ci, cj, points, low, high FROM grid").collect()) == _same(windowed_density(rows, 1.0).drop("start").collect())


def test_utm_on_the_central_meridian(spark):
    df = spark.createDataFrame([(0.0, 3.0, 31), (45.0, 3.0, 31), (-45.0, 3.0, 31)], "lat double, lon double, zone int")
    got = df.select(*geodesy.utm(F.col("lat"), F.col("lon"), F.col("zone"))).collect()
    assert [round(r[0], 3) for r in got] == [500000.0] * 3
    assert [round(r[1], 2) for r in got] == [0.0, 4982950.4, 5017049.6]


def test_normals_of_planes(spark):
    flat = [(i, float(i % 5), float(i // 5), 2.0) for i in range(25)]
    cloud_ = spark.createDataFrame(flat, "pid long, x double, y double, z double")
    up = shape.normals(cloud_, 6).collect()
    assert all((round(abs(r.nx), 9), round(abs(r.ny), 9), round(r.nz, 9), round(r.curvature, 9)) == (0, 0, 1, 0) for r in up)
    assert all(round(r.nz, 9) == -1 for r in shape.normals(cloud_, 6, (0.0, 0.0, -9.0)).collect())
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(4)], "pid long, x double, y double, z double")
    assert {(r.nx, r.ny, r.nz, r.curvature) for r in shape.normals(same, 3).collect()} == {(0, 0, 1, 0)}
    assert shape.shape_features(same.limit(0), 3).count() == 0


def test_a_quotient_over_zero(spark, tmp_path):
    """An event of value 0 stopped the scalars; its SQL gives an infinite ratio."""
    rows = [(6.0, 2.0), (6.0, 0.0), (-6.0, 0.0), (6.0, -0.0), (0.0, 0.0), (6.0, 1e-13), (None, 0.0), (6.0, None)]
    table = spark.createDataFrame(rows, "a double, b double")
    got = [r.q for r in table.select(vectors.safe_divide(F.col("a"), F.col("b"), instead=vectors.quotient(F.col("a"), F.col("b"))).alias("q")).collect()]
    inf = float("inf")
    assert got[:4] == [3.0, inf, -inf, -inf] and got[4] != got[4] and got[5:7] == [6.0 / 1e-13, None]
    spark.sql("SELECT 1L AS event_id, timestamp_ntz'2024-01-02 00:00:00' AS ts, 5L AS user_id, 'click' AS event_type, 0.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    assert queries.QUERIES["scalars"](spark, str(tmp_path)).first().ratio == inf


def test_halves_are_rounded_as_their_sql_rounds_them(spark, tmp_path):
    """Spark's own rounding goes by decimal digits: hours like 0.00015 came out at 0.0002, in the SQL at 0.0001."""
    inf, c = float("inf"), duckdb.connect()
    values = [way * (2 * k + 1) / 2 / 10**p for way in (1, -1) for p in (3, 4, 6) for k in range(300)]
    values += [0.0, 5e-324, 0.49999999999999994, 4503599627370495.5, 2251799813685248.25, 1e16 + 2, 1.7e308, -1.7e308, inf, -inf, None]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k long, x double")
    for p in (3, 4, 6):
        got = [r.x for r in table.select("k", vectors.rounded(F.col("x"), p).alias("x")).orderBy("k").collect()]
        assert got == [r[0] for r in c.execute(f"SELECT round(x, {p}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    none = table.select(vectors.rounded(F.lit(float("nan")), 4).alias("x")).first().x
    assert none != none

    events = spark.range(2000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 0.18 * (2 * id + 1)) AS ts", "id % 7 AS user_id", "'click' AS event_type", "id % 900 / 100D AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(f"SELECT pid, clamped, near, ratio, mean, square, cube, x FROM ({queries.ORACLE_SQL['scalars']}) ORDER BY pid").fetchall()
    got = queries.QUERIES["scalars"](spark, str(tmp_path)).orderBy("pid").collect()
    assert repr([tuple(r) for r in got]) == repr(want)  # NaN of 0 over 0 as well


def test_means_of_neighbours_are_summed_by_vid(spark):
    """Sums in the order of arrival came out differently in the last bits, and so did spikes at the very threshold."""
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, 0.7]
    vertices, triangles, want = [], [], {}
    for hub in range(0, 800, 8):
        ring = [values[(k * (hub // 8 % 6 + 1) + hub // 48) % 7] for k in range(7)]
        vertices += [(hub, 0.0, 0.0, 0.0), *[(hub + k + 1, 1.0, float(k), z) for k, z in enumerate(ring)]]
        triangles += [(hub + k, hub, hub + k + 1, hub + (k + 1) % 7 + 1) for k in range(7)]
        total = 0.0
        for z in ring:
            total += z
        want[hub] = total / 7
    v = spark.createDataFrame(vertices, "vid long, x double, y double, z double").repartition(5)
    t = spark.createDataFrame(triangles, "tid long, v0 long, v1 long, v2 long").repartition(3)
    assert {r.vid: r.mean_z for r in terrain.neighbour_mean(v, t).where("vid % 8 = 0").collect()} == want
