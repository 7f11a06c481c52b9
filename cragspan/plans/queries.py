"""Registered queries on clouds, meshes and surveys derived from the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.functions import geodesy as geo
from cragspan.functions import geometry as g
from cragspan.functions import vectors as v
from cragspan.operators import cloud as c
from cragspan.operators import neighbours as n
from cragspan.operators import shape as h
from cragspan.operators import survey as s
from cragspan.operators import terrain as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Nodes along a side of the mesh's grid, which grows with the events: about 39 events a node.
_SIDE = "(SELECT greatest(4, CAST(floor(sqrt(count(*) / 39.0::DOUBLE)) AS BIGINT)) FROM events)"
_EV = "EV AS (SELECT event_id AS pid, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, CAST(user_id AS DOUBLE) AS y, value AS z, event_type FROM events)"
_EM = "EM AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
_GRID = f"""GRID AS (SELECT r.range AS "row", k.range AS col, coalesce(zz, 0.0::DOUBLE) AS z FROM range({_SIDE}) r CROSS JOIN range({_SIDE}) k
 LEFT JOIN (SELECT CAST(user_id % {_SIDE} AS BIGINT) AS rr, CAST(event_id % {_SIDE} AS BIGINT) AS kk, (min(value) + max(value)) / 2 AS zz FROM events GROUP BY 1, 2) e ON rr = r.range AND kk = k.range)"""
_MESH = f"""{_GRID}, V AS (SELECT "row" * {_SIDE} + col AS vid, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, z / 100 AS z FROM GRID),
T AS (SELECT 2 * vid + k AS tid, vid AS v0, CASE k WHEN 0 THEN vid + 1 ELSE vid + {_SIDE} + 1 END AS v1, CASE k WHEN 0 THEN vid + {_SIDE} + 1 ELSE vid + {_SIDE} END AS v2
 FROM (SELECT "row" * {_SIDE} + col AS vid FROM GRID WHERE "row" < {_SIDE} - 1 AND col < {_SIDE} - 1) CROSS JOIN (SELECT unnest([0, 1]) AS k)),
FACE AS (SELECT tid, v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM T JOIN V a ON a.vid = v0 JOIN V b ON b.vid = v1 JOIN V c ON c.vid = v2),
N0 AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS c FROM FACE),
N AS (SELECT *, sqrt(a*a+b*b+c*c) AS size, CASE WHEN c < 0 THEN -1 ELSE 1 END AS turn FROM N0),
E AS (SELECT least(v0,v1) AS a, greatest(v0,v1) AS b, tid, v2 AS o FROM T UNION ALL SELECT least(v1,v2), greatest(v1,v2), tid, v0 FROM T UNION ALL SELECT least(v2,v0), greatest(v2,v0), tid, v1 FROM T)"""


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_cloud(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return _table(spark, d, "events").select(F.col("event_id").alias("pid"), (micros / F.lit(3.6e9)).alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"), "event_type")


def vector_cloud(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")], "label")


def grid_side(spark: SparkSession, d: str) -> int:
    return max(4, int((_table(spark, d, "events").count() / 39.0) ** 0.5))


def event_grid(spark: SparkSession, d: str) -> DataFrame:
    side = grid_side(spark, d)
    cells = spark.range(side * side).select(F.expr(f"id div {side}").alias("row"), (F.col("id") % side).alias("col"))
    mean = _table(spark, d, "events").groupBy((F.col("user_id") % side).cast("long").alias("row"), (F.col("event_id") % side).cast("long").alias("col")).agg(((F.min("value") + F.max("value")) / 2).alias("zz"))
    return cells.join(mean, ["row", "col"], "left").select("row", "col", F.coalesce("zz", F.lit(0.0)).alias("z"))


def event_mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    side = grid_side(spark, d)
    v = event_grid(spark, d).select((F.col("row") * side + F.col("col")).alias("vid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("z") / 100).alias("z"))
    at = spark.range(side * side).where((F.col("id") % side < side - 1) & (F.col("id") < side * (side - 1)))
    both = at.select(F.col("id").alias("v0"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    up = F.when(F.col("k") == 0, 1).otherwise(side + 1)
    return v, both.select((2 * F.col("v0") + F.col("k")).alias("tid"), "v0", (F.col("v0") + up).alias("v1"), (F.col("v0") + F.when(F.col("k") == 0, side + 1).otherwise(side)).alias("v2"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    return t.corners(*event_mesh(spark, d))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[v.rounded(F.col(k), places).alias(k) if kind == "double" else F.col(k) for k, kind in df.dtypes])


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        heads = [h for key, h in (("EV", _EV), ("EM", _EM)) if f" {key} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
        if any(f" {k} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ") for k in ("V", "T", "FACE", "N", "E")):
            heads.append(_MESH)
        elif "GRID" in sql:
            heads.append(_GRID)
        more = sql.lstrip()
        if more.startswith("WITH RECURSIVE "):
            ORACLE_SQL[name] = "WITH RECURSIVE " + ", ".join(heads + [more[15:]])
        elif more.startswith("WITH "):
            ORACLE_SQL[name] = "WITH " + ", ".join(heads + [more[5:]])
        else:
            ORACLE_SQL[name] = ("WITH " + ", ".join(heads) + " " if heads else "") + more


_add("pass_through", lambda k, d: c.pass_through(event_cloud(k, d), "z", 50.0, 250.0).select("pid"), "SELECT pid FROM EV WHERE z BETWEEN 50 AND 250")
_add("crop_box", lambda k, d: c.crop_box(event_cloud(k, d), (100.0, 20.0, 10.0), (400.0, 120.0, 300.0)).select("pid"), "SELECT pid FROM EV WHERE x BETWEEN 100 AND 400 AND y BETWEEN 20 AND 120 AND z BETWEEN 10 AND 300")
_POLYGON = [(50.0, 10.0), (500.0, 30.0), (600.0, 120.0), (300.0, 70.0), (80.0, 140.0)]
_CROSS = " + ".join(f"CASE WHEN ({yi} > y) <> ({yj} > y) AND x < ({xj} - {xi}) * (y - {yi}) / ({yj} - {yi}) + {xi} THEN 1 ELSE 0 END" for (xi, yi), (xj, yj) in zip(_POLYGON, [_POLYGON[-1], *_POLYGON[:-1]], strict=True))
_add("clip_polygon", lambda k, d: c.clip_polygon(event_cloud(k, d), _POLYGON).select("pid"), f"SELECT pid FROM EV WHERE ({_CROSS}) % 2 = 1")
_VOX = "CAST(floor(x / 24) AS BIGINT) AS vx, CAST(floor(y / 24) AS BIGINT) AS vy, CAST(floor(z / 24) AS BIGINT) AS vz"
_add("voxel_centroid", lambda k, d: _rounded(c.voxel_centroid(event_cloud(k, d), 24.0)), f"SELECT {_VOX}, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM EV GROUP BY 1, 2, 3")
_add("voxel_closest", lambda k, d: c.voxel_closest(event_cloud(k, d), 24.0).select("vx", "vy", "vz", "pid"), f"""SELECT vx, vy, vz, pid FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY (x-(vx+0.5)*24)*(x-(vx+0.5)*24)+(y-(vy+0.5)*24)*(y-(vy+0.5)*24)+(z-(vz+0.5)*24)*(z-(vz+0.5)*24), pid) AS k FROM (SELECT pid, x, y, z, {_VOX} FROM EV )) WHERE k = 1""")
_add("voxel_random", lambda k, d: c.voxel_random(event_cloud(k, d), 24.0, 7))
_add("stratified_closest", lambda k, d: c.stratified_closest(event_cloud(k, d), 40.0, 2, places=6), """WITH q AS (SELECT pid, x, y, z, CAST(floor(x/40) AS BIGINT) AS vx, CAST(floor(y/40) AS BIGINT) AS vy FROM EV ), m AS (SELECT vx, vy, avg(z) AS mz FROM q GROUP BY 1, 2)
SELECT vx, vy, pid FROM (SELECT vx, vy, pid, row_number() OVER (PARTITION BY vx, vy ORDER BY round((x-(vx+0.5)*40)*(x-(vx+0.5)*40)+(y-(vy+0.5)*40)*(y-(vy+0.5)*40)+(z-mz)*(z-mz), 6), pid) AS k FROM q JOIN m USING (vx, vy)) WHERE k <= 2""")
_add("uniform_sample", lambda k, d: c.uniform_sample(event_cloud(k, d), 7, 2).select("pid"), "SELECT pid FROM EV WHERE pid % 7 = 2")
_add("random_sample", lambda k, d: c.random_sample(event_cloud(k, d), 0.1, 5).select("pid"))
_add("grid_ground", lambda k, d: c.grid_ground(event_cloud(k, d), 24.0, 10.0, 50.0).select("pid"), "SELECT pid FROM (SELECT pid, z, min(z) OVER (PARTITION BY floor(x/24), floor(y/10)) AS m FROM EV ) WHERE z - m <= 50")
_add("ground_elevation", lambda k, d: c.ground_elevation(event_cloud(k, d), 24.0, 10.0).select("pid", "ground"), "SELECT pid, min(z) OVER (PARTITION BY floor(x/24), floor(y/10)) AS ground FROM EV")
_add("ground_by_type", lambda k, d: c.grid_ground(event_cloud(k, d), 24.0, 10.0, 50.0).groupBy("event_type").agg(F.count("*").alias("points")), "SELECT event_type, count(*) AS points FROM (SELECT event_type, z, min(z) OVER (PARTITION BY floor(x/24), floor(y/10)) AS m FROM EV ) WHERE z - m <= 50 GROUP BY 1")
_add("cell_seeds", lambda k, d: c.cell_seeds(event_cloud(k, d), 12.0), "SELECT ci, cj, pid, z FROM (SELECT CAST(floor(x/12) AS BIGINT) AS ci, CAST(floor(y/12) AS BIGINT) AS cj, pid, z, row_number() OVER (PARTITION BY floor(x/12), floor(y/12) ORDER BY z, pid) AS k FROM EV ) WHERE k = 1")
_add("cloud_bounds", lambda k, d: c.bounds(event_cloud(k, d)), "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM EV")
_add("attribute_statistics", lambda k, d: _rounded(c.attribute_statistics(_table(k, d, "lineitem"), "l_extendedprice"), 2), "SELECT round(min(l_extendedprice),2) AS min, round(max(l_extendedprice),2) AS max, round(avg(l_extendedprice),2) AS mean, round(var_pop(l_extendedprice),2) AS variance, round(stddev_pop(l_extendedprice),2) AS std, count(l_extendedprice) AS count FROM lineitem")
_add("elevation_statistics", lambda k, d: _rounded(c.elevation_statistics(event_cloud(k, d))), "SELECT round(min(z),6) AS min, round(max(z),6) AS max, round(avg(z),6) AS mean, round(stddev_pop(z),6) AS std, round(quantile_cont(z,0.5),6) AS median, round(max(z)-min(z),6) AS range, count(z) AS count FROM EV")
_add("histogram", lambda k, d: _rounded(c.histogram(event_cloud(k, d), "z", 10)), "WITH e AS (SELECT min(z) AS lo, max(z) AS hi, count(*) AS n FROM EV ), b AS (SELECT CAST(least(floor((z-lo)/((hi-lo)/10)), 9) AS INTEGER) AS bin, n FROM EV CROSS JOIN e) SELECT bin, count(*) AS count, round(sum(count(*)) OVER (ORDER BY bin) / max(n), 6) AS cumulative FROM b GROUP BY bin")
_add("moments", lambda k, d: _rounded(c.moments(event_cloud(k, d), "z"), 5), "WITH m AS (SELECT avg(z) AS m, count(*) AS n FROM EV ), p AS (SELECT sum((z-m)*(z-m))/max(n) AS m2, sum((z-m)*(z-m)*(z-m))/max(n) AS m3, sum((z-m)*(z-m)*(z-m)*(z-m))/max(n) AS m4, max(n) AS n FROM EV CROSS JOIN m) SELECT round(m3/pow(m2,1.5),5) AS skew, round(m4/(m2*m2)-3,5) AS kurtosis, n FROM p")
_add("percentiles", lambda k, d: _rounded(c.percentiles(event_cloud(k, d), "z", [5, 25, 50, 75, 95])), "SELECT CAST(p AS DOUBLE) AS percentile, round((SELECT quantile_cont(z, [0.05,0.25,0.5,0.75,0.95]) FROM EV )[i], 6) AS value FROM (SELECT unnest([5,25,50,75,95]) AS p, unnest([1,2,3,4,5]) AS i)")
_add("whiskers", lambda k, d: _rounded(c.whiskers(event_cloud(k, d), "z")), "WITH q AS (SELECT quantile_cont(z,0.25) AS q1, quantile_cont(z,0.5) AS q2, quantile_cont(z,0.75) AS q3, min(z) AS lo, max(z) AS hi FROM EV ) SELECT round(q1,6) AS q1, round(q2,6) AS q2, round(q3,6) AS q3, round(q3-q1,6) AS iqr, round(greatest(lo,q1-1.5*(q3-q1)),6) AS low, round(least(hi,q3+1.5*(q3-q1)),6) AS high FROM q")
_add("grid_density", lambda k, d: c.density_map(event_cloud(k, d), 20.0), "WITH m AS (SELECT min(x) AS x0, min(y) AS y0 FROM EV ) SELECT CAST(trunc((y-y0)/20) AS BIGINT) AS \"row\", CAST(trunc((x-x0)/20) AS BIGINT) AS \"column\", count(*) AS points, count(*)/400.0::DOUBLE AS density FROM EV CROSS JOIN m GROUP BY 1, 2")
_add("class_predicates", lambda k, d: c.class_predicates(_table(k, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("classification"))).groupBy("l_linenumber").agg(*[F.count_if(f"is_{m}").alias(m) for m in c.CLASS_CODES]), "SELECT l_linenumber, " + ", ".join(f"count(*) FILTER (CAST(l_quantity AS INTEGER) IN ({','.join(map(str, v))})) AS {m}" for m, v in c.CLASS_CODES.items()) + " FROM lineitem GROUP BY 1")

_PAIR = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
_add("radius_count", lambda k, d: n.radius_count(event_cloud(k, d), 10.0), f"SELECT a.pid, count(*) AS neighbours FROM EV a, EV b WHERE {_PAIR} <= 100 GROUP BY 1")
_add("radius_outliers", lambda k, d: n.radius_outliers(event_cloud(k, d), 10.0, 4).select("pid"), f"SELECT a.pid FROM EV a, EV b WHERE {_PAIR} <= 100 GROUP BY 1 HAVING count(*) >= 4")
_add("local_density", lambda k, d: _rounded(n.local_density(event_cloud(k, d), 10.0), 9), f"SELECT a.pid, round(count(*) / (4.0/3.0*3.141592653589793*1000), 9) AS density FROM EV a, EV b WHERE {_PAIR} <= 100 GROUP BY 1")
_KNN = f"(SELECT a.pid, b.pid AS nid, {_PAIR} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_PAIR}, b.pid) AS k FROM EM a, EM b WHERE a.pid <> b.pid)"
_add("knn", lambda k, d: n.knn(vector_cloud(k, d), vector_cloud(k, d), 5, drop_self=True).select("pid", "rank", "nid"), f"SELECT pid, CAST(k AS INTEGER) AS rank, nid FROM {_KNN} WHERE k <= 5")
_add("knn_distance", lambda k, d: _rounded(n.knn(vector_cloud(k, d), vector_cloud(k, d), 3, drop_self=True).where("rank = 3").select("pid", F.sqrt("d2").alias("distance")), 9), f"SELECT pid, round(sqrt(d2), 9) AS distance FROM {_KNN} WHERE k = 3")
_add("statistical_outliers", lambda k, d: n.statistical_outliers(vector_cloud(k, d), 8, 1.0).select("pid"), f"WITH m AS (SELECT pid, avg(sqrt(d2)) AS dist FROM {_KNN} WHERE k <= 8 GROUP BY 1) SELECT pid FROM m WHERE dist <= (SELECT avg(dist) + stddev_pop(dist) FROM m)")
_NEAR = f"(SELECT a.pid, min({_PAIR}) AS d2 FROM EM a, EM b WHERE a.pid % 2 = 0 AND b.pid % 2 = 1 GROUP BY 1)"
_BACK = f"(SELECT a.pid, min({_PAIR}) AS d2 FROM EM a, EM b WHERE a.pid % 2 = 1 AND b.pid % 2 = 0 GROUP BY 1)"


def _halves(k: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    whole = vector_cloud(k, d)
    return whole.where("pid % 2 = 0"), whole.where("pid % 2 = 1")


_add("cloud_to_cloud", lambda k, d: _rounded(n.cloud_to_cloud(*_halves(k, d))), f"SELECT round(avg(sqrt(d2)),6) AS mean, round(stddev_samp(sqrt(d2)),6) AS std, round(max(sqrt(d2)),6) AS max, round(sqrt(avg(d2)),6) AS rmse, count(*) AS n FROM {_NEAR}")
_add("hausdorff", lambda k, d: _rounded(n.hausdorff(*_halves(k, d))), f"WITH f AS (SELECT sqrt(max(d2)) AS f FROM {_NEAR}), b AS (SELECT sqrt(max(d2)) AS b FROM {_BACK}) SELECT round(f,6) AS forward, round(b,6) AS backward, round(greatest(f,b),6) AS hausdorff FROM f, b")
_add("chamfer", lambda k, d: _rounded(n.chamfer(*_halves(k, d))), f"WITH f AS (SELECT avg(sqrt(d2)) AS f FROM {_NEAR}), b AS (SELECT avg(sqrt(d2)) AS b FROM {_BACK}) SELECT round(f,6) AS forward, round(b,6) AS backward, round((f+b)/2,6) AS chamfer FROM f, b")
_add("correspondences", lambda k, d: n.correspondences(*_halves(k, d), 0.08).select("pid", "nid"), f"SELECT pid, nid FROM (SELECT a.pid, b.pid AS nid, {_PAIR} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {_PAIR}, b.pid) AS k FROM EM a, EM b WHERE a.pid % 2 = 0 AND b.pid % 2 = 1) WHERE k = 1 AND sqrt(d2) <= 0.08")
_add("relative_height", lambda k, d: _rounded(n.relative_height(*_halves(k, d)), 9), f"SELECT pid, round(z - nz, 9) AS height FROM (SELECT a.pid, a.z, b.z AS nz, row_number() OVER (PARTITION BY a.pid ORDER BY {_PAIR}, b.pid) AS k FROM EM a, EM b WHERE a.pid % 2 = 0 AND b.pid % 2 = 1) WHERE k = 1")
_LINK = f"L AS (SELECT a.pid AS a, b.pid AS b FROM EM a, EM b WHERE {_PAIR} <= 0.05*0.05)"
_add("connected_components", lambda k, d: n.connected_components(vector_cloud(k, d), 0.05, 3), f"WITH RECURSIVE {_LINK}, R AS (SELECT a AS pid, a AS root FROM L UNION SELECT L.b, R.root FROM R JOIN L ON L.a = R.pid WHERE R.root < L.b), M AS (SELECT pid, min(root) AS root FROM R GROUP BY 1), Z AS (SELECT root, count(*) AS n FROM M GROUP BY 1) SELECT pid, CASE WHEN n >= 3 THEN M.root ELSE -1 END AS segment FROM M JOIN Z USING (root)")
_add("dbscan", lambda k, d: n.dbscan(vector_cloud(k, d), 0.06, 5), f"WITH RECURSIVE {_LINK.replace('0.05*0.05', '0.06*0.06')}, K AS (SELECT a AS pid FROM L GROUP BY 1 HAVING count(*) >= 5), R AS (SELECT pid, pid AS root FROM K UNION SELECT L.b, R.root FROM R JOIN L ON L.a = R.pid JOIN K ON K.pid = L.b WHERE R.root < L.b), M AS (SELECT pid, min(root) AS root FROM R GROUP BY 1), B AS (SELECT L.a AS pid, min(root) AS root FROM L JOIN M ON M.pid = L.b GROUP BY 1) SELECT EM.pid, coalesce(M.root, B.root, -1) AS cluster FROM EM LEFT JOIN M ON M.pid = EM.pid LEFT JOIN B ON B.pid = EM.pid")

_AREA, _FLAT = "size / 2", "abs(c) / 2"
_add("surface_area", lambda k, d: _rounded(t.surface_area(_faces(k, d))), f"SELECT round(sum({_AREA}),6) AS area, round(sum({_FLAT}),6) AS flat_area, count(*) AS triangles FROM N")
_add("triangle_derivatives", lambda k, d: _rounded(t.derivatives(_faces(k, d)), 5), f"SELECT tid, round({_AREA},5) AS area, round({_FLAT},5) AS flat_area, round(degrees(acos(least(c*turn/size,1))),5) AS slope, round(CASE WHEN a <> 0 OR b <> 0 THEN (degrees(atan2(a*turn/size,b*turn/size))+360) - 360*floor((degrees(atan2(a*turn/size,b*turn/size))+360)/360) END,5) AS aspect, round(255*greatest(0, a*turn/size*sin(radians(45))*sin(radians(315)) + b*turn/size*sin(radians(45))*cos(radians(315)) + c*turn/size*cos(radians(45))),5) AS shade FROM N")
_add("tin_volume", lambda k, d: _rounded(t.tin_volume(_faces(k, d), 1.2)), "WITH vol AS (SELECT abs(c)/2*((z0+z1+z2)/3-1.2) AS v FROM N ) SELECT round(sum(CASE WHEN v >= 0 THEN v ELSE 0 END),6) AS above, round(sum(CASE WHEN v < 0 THEN -v ELSE 0 END),6) AS below FROM vol")
_add("mesh_edges", lambda k, d: t.edges(event_mesh(k, d)[1]), "SELECT a, b, count(*) AS faces FROM E GROUP BY 1, 2")
_add("triangle_neighbours", lambda k, d: t.triangle_neighbours(event_mesh(k, d)[1]), "SELECT p.tid, p.o AS opposite, coalesce(q.tid, -1) AS neighbour FROM E p LEFT JOIN E q ON p.a = q.a AND p.b = q.b AND p.tid <> q.tid")
_W = "W AS (SELECT DISTINCT a AS vid, b AS nid FROM E UNION SELECT DISTINCT b, a FROM E ), Q AS (SELECT V.vid, V.x, V.y, V.z, avg(v2.z) AS mean_z FROM V JOIN W ON W.vid = V.vid JOIN V v2 ON v2.vid = W.nid GROUP BY ALL)"
_add("laplacian_smooth", lambda k, d: _rounded(t.laplacian_smooth(*event_mesh(k, d), 0.5), 9), f"WITH {_W} SELECT vid, x, y, round(z + 0.5*(mean_z - z), 9) AS z FROM Q")
_add("spikes", lambda k, d: _rounded(t.spikes(*event_mesh(k, d), 0.2), 9), f"WITH {_W} SELECT vid, round(z,9) AS z, round(mean_z,9) AS mean_z FROM Q WHERE abs(z-mean_z) > 0.2")
_add("breaklines", lambda k, d: _rounded(t.breaklines(*event_mesh(k, d), 25.0), 5), "WITH u AS (SELECT tid, a*turn/size AS nx, b*turn/size AS ny, c*turn/size AS nz FROM N ), g AS (SELECT p.a, p.b, degrees(acos(greatest(least(m.nx*k.nx+m.ny*k.ny+m.nz*k.nz,1),-1))) AS angle FROM E p JOIN E q ON p.a=q.a AND p.b=q.b AND p.tid<q.tid JOIN u m ON m.tid=p.tid JOIN u k ON k.tid=q.tid) SELECT a, b, round(angle,5) AS angle FROM g WHERE angle >= 25")
_add("valley_edges", lambda k, d: t.valley_edges(*event_mesh(k, d), 0.05), "SELECT p.a, p.b FROM E p JOIN E q ON p.a=q.a AND p.b=q.b AND p.tid<q.tid JOIN V a ON a.vid=p.a JOIN V b ON b.vid=p.b JOIN V o ON o.vid=p.o JOIN V u ON u.vid=q.o WHERE o.z >= (a.z+b.z)/2+0.05 AND u.z >= (a.z+b.z)/2+0.05")
_SEG = " UNION ALL ".join(f"SELECT tid, level, x{i}+(level-z{i})/(z{j}-z{i})*(x{j}-x{i}) AS x, y{i}+(level-z{i})/(z{j}-z{i})*(y{j}-y{i}) AS y FROM l WHERE (z{i} < level) <> (z{j} < level)" for i, j in ((0, 1), (1, 2), (2, 0)))
_add("contour_segments", lambda k, d: _rounded(t.contour_segments(_faces(k, d), 0.0, 0.1), 5), f"WITH l AS (SELECT *, 0.0::DOUBLE + k.range*0.1::DOUBLE AS level FROM FACE CROSS JOIN range(0, 1000) k WHERE k.range BETWEEN ceil(least(z0,z1,z2)/0.1::DOUBLE) AND floor(greatest(z0,z1,z2)/0.1::DOUBLE) AND greatest(z0,z1,z2) > least(z0,z1,z2)), ends AS ({_SEG}), o AS (SELECT *, row_number() OVER (PARTITION BY tid, level ORDER BY x, y) AS k, count(*) OVER (PARTITION BY tid, level) AS n FROM ends) SELECT round(p.level,5) AS level, p.tid, round(p.x,5) AS x0, round(p.y,5) AS y0, round(q.x,5) AS x1, round(q.y,5) AS y1 FROM o p JOIN o q ON p.tid=q.tid AND p.level=q.level AND p.k=1 AND q.k=2 WHERE p.n=2")


def _probes(k: SparkSession, d: str) -> DataFrame:
    wide = 12.3 / 15 * (grid_side(k, d) - 1)
    return vector_cloud(k, d).select("pid", ((F.col("x") + 0.6) * wide).alias("x"), ((F.col("y") + 0.6) * wide).alias("y"))


_WIDE = f"(12.3::DOUBLE / 15 * ({_SIDE} - 1))"
_PROBE = f"P AS (SELECT pid, (x+0.6)*{_WIDE} AS x, (y+0.6)*{_WIDE} AS y FROM EM )"
_w1 = "((y1-y2)*(P.x-x2)+(x2-x1)*(P.y-y2))/((y1-y2)*(x0-x2)+(x2-x1)*(y0-y2))"
_w2 = "((y2-y0)*(P.x-x2)+(x0-x2)*(P.y-y2))/((y1-y2)*(x0-x2)+(x2-x1)*(y0-y2))"
_add("tin_interpolate", lambda k, d: _rounded(t.locate(_probes(k, d), _faces(k, d), 1.0)), f"WITH {_PROBE}, i AS (SELECT pid, tid, {_w1} AS w1, {_w2} AS w2, z0, z1, z2 FROM P, FACE ), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tid) AS k FROM i WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND 1-w1-w2 >= -1e-9) SELECT pid, tid, round(w1*z0+w2*z1+(1-w1-w2)*z2, 6) AS z FROM r WHERE k = 1")
_add("idw", lambda k, d: _rounded(t.idw(_probes(k, d), event_mesh(k, d)[0])), f"WITH {_PROBE}, q AS (SELECT pid, V.z, (P.x-V.x)*(P.x-V.x)+(P.y-V.y)*(P.y-V.y) AS d2 FROM P, V ) SELECT pid, round(sum(z/d2)/sum(1/d2), 6) AS z FROM q GROUP BY 1")
_add("nearest_vertex", lambda k, d: n.knn(_probes(k, d), event_mesh(k, d)[0].withColumnRenamed("vid", "pid"), 1, "xy").select("pid", "nid"), f"WITH {_PROBE} SELECT pid, nid FROM (SELECT pid, vid AS nid, row_number() OVER (PARTITION BY pid ORDER BY (P.x-V.x)*(P.x-V.x)+(P.y-V.y)*(P.y-V.y), vid) AS k FROM P, V ) WHERE k = 1")
_add("bilinear_sample", lambda k, d: _rounded(t.bilinear(_probes(k, d), event_grid(k, d))), f"WITH {_PROBE}, q AS (SELECT pid, x-floor(x) AS fx, y-floor(y) AS fy, a.z AS za, b.z AS zb, c.z AS zc, e.z AS ze FROM P LEFT JOIN GRID a ON a.row=floor(y) AND a.col=floor(x) LEFT JOIN GRID b ON b.row=floor(y) AND b.col=floor(x)+1 LEFT JOIN GRID c ON c.row=floor(y)+1 AND c.col=floor(x) LEFT JOIN GRID e ON e.row=floor(y)+1 AND e.col=floor(x)+1 WHERE coalesce(a.z,b.z,c.z,e.z) IS NOT NULL) SELECT pid, round(za*(1-fx)*(1-fy)+zb*fx*(1-fy)+zc*(1-fx)*fy+ze*fx*fy, 6) AS z FROM q")
_add("nearest_sample", lambda k, d: t.nearest_sample(_probes(k, d), event_grid(k, d)), f"WITH {_PROBE} SELECT pid, z FROM P JOIN GRID ON GRID.row = round_even(y, 0) AND GRID.col = round_even(x, 0)")
_add("raster_summary", lambda k, d: _rounded(t.raster_summary(event_grid(k, d))), "SELECT round(min(z),6) AS min, round(max(z),6) AS max, round(avg(z),6) AS mean, round(stddev_pop(z),6) AS std, count(z) AS valid, count(*) AS cells FROM GRID")
_add("grid_slope", lambda k, d: _rounded(t.grid_slope(event_grid(k, d), 10.0)), f"""WITH q AS (SELECT "row", col, (coalesce(lead(z) OVER r, z) - coalesce(lag(z) OVER r, z)) / (10.0 * CASE WHEN col IN (0, {_SIDE} - 1) THEN 1 ELSE 2 END) AS dx, (coalesce(lead(z) OVER k, z) - coalesce(lag(z) OVER k, z)) / (10.0 * CASE WHEN "row" IN (0, {_SIDE} - 1) THEN 1 ELSE 2 END) AS dy FROM GRID WINDOW r AS (PARTITION BY "row" ORDER BY col), k AS (PARTITION BY col ORDER BY "row")) SELECT "row", col, round(degrees(atan(sqrt(dx*dx+dy*dy))), 6) AS slope FROM q""")
_add("raster_window", lambda k, d: _rounded(t.raster_window(event_grid(k, d), 1)), 'SELECT a.row, a.col, round(min(b.z),6) AS min, round(max(b.z),6) AS max, round(avg(b.z),6) AS mean FROM GRID a JOIN GRID b ON abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2')
_add("grey_opening", lambda k, d: t.grey_opening(event_grid(k, d), 3), "WITH o AS (SELECT a.row, a.col, min(b.z) AS z FROM GRID a JOIN GRID b ON abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2) SELECT a.row, a.col, max(b.z) AS z FROM o a JOIN o b ON abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2")
_add("cut_fill", lambda k, d: _rounded(t.cut_fill(event_grid(k, d), t.grey_opening(event_grid(k, d), 3).withColumn("z", F.col("z") + 5), 4.0), 4), "WITH o AS (SELECT a.row, a.col, min(b.z) AS z FROM GRID a JOIN GRID b ON abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2), p AS (SELECT a.row, a.col, max(b.z)+5 AS z FROM o a JOIN o b ON abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2), q AS (SELECT g.z-p.z AS d FROM GRID g JOIN p ON g.row=p.row AND g.col=p.col) SELECT round(sum(greatest(d,0))*4,4) AS cut, round(sum(greatest(-d,0))*4,4) AS fill, round(sum(d)*4,4) AS net, count(*) AS cells FROM q")


def _sections(k: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return _table(k, d, "orders").groupBy(F.col("o_orderstatus").alias("line"), day.cast("double").alias("station")).agg(F.round(F.sum("o_totalprice"), 2).alias("area"))


_SECT = "S AS (SELECT o_orderstatus AS line, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS station, round(sum(o_totalprice), 2) AS area FROM orders GROUP BY 1, 2)"
_add("average_end_area", lambda k, d: _rounded(s.average_end_area(_sections(k, d)), 0), f"WITH {_SECT}, q AS (SELECT line, (lead(station) OVER w - station)*(area + lead(area) OVER w)/2 AS v FROM S WINDOW w AS (PARTITION BY line ORDER BY station)) SELECT line, round(sum(v), 0) AS volume, count(*) AS sections FROM q GROUP BY 1")
_add("prismoidal", lambda k, d: _rounded(s.prismoidal_as_if_even(_sections(k, d), 1.0), 0), f"WITH {_SECT}, q AS (SELECT line, area, row_number() OVER (PARTITION BY line ORDER BY station) AS k, count(*) OVER (PARTITION BY line) AS n FROM S) SELECT line, round(sum(area*CASE WHEN k=1 OR k=n THEN 1 WHEN k%2=0 THEN 4 ELSE 2 END)*(1.0::DOUBLE/3), 0) AS volume, count(*) AS sections FROM q GROUP BY 1 HAVING count(*) % 2 = 1 AND count(*) >= 3")
_add("prismoidal_sections", lambda k, d: _rounded(s.prismoidal(_sections(k, d)), 0), f"WITH {_SECT}, q AS (SELECT line, area, lead(station) OVER w - station AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY line) AS n FROM S WINDOW w AS (PARTITION BY line ORDER BY station)), r AS (SELECT line, sum(area*CASE WHEN k=1 OR k=n THEN 1 WHEN k%2=0 THEN 4 ELSE 2 END) AS total, min(gap) AS low, max(gap) AS high, count(*) AS sections, CASE WHEN count(*) < 3 THEN 'few' WHEN count(*) % 2 = 0 THEN 'even' WHEN count(*) FILTER (area IS NULL OR area < 0) > 0 THEN 'value' WHEN min(gap) <> max(gap) THEN 'spacing' END AS problem FROM q GROUP BY 1) SELECT line, CASE WHEN problem IS NULL THEN round(total*(low/3), 0) END AS volume, sections, problem FROM r")


def _survey(k: SparkSession, d: str) -> DataFrame:
    return _table(k, d, "events").select((F.col("user_id") % 10).cast("long").alias("survey"), F.col("event_id").alias("ord"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("code"))


_SV = "SV AS (SELECT CAST(user_id % 10 AS BIGINT) AS survey, event_id AS ord, event_type || CAST(event_id % 3 AS VARCHAR) AS code FROM events)"
_add("code_runs", lambda k, d: s.runs(_survey(k, d)), f"WITH {_SV}, b AS (SELECT *, CASE WHEN regexp_replace(code, '[0-9]+$', '') = '' THEN code ELSE regexp_replace(code, '[0-9]+$', '') END AS base FROM SV), f AS (SELECT *, CASE WHEN lag(base) OVER w IS DISTINCT FROM base THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY survey ORDER BY ord)), r AS (SELECT *, sum(new) OVER (PARTITION BY survey ORDER BY ord) AS run FROM f) SELECT survey, CAST(run AS BIGINT) AS run, min(base) AS base, count(*) AS points, min(ord) AS first, max(ord) AS last FROM r GROUP BY 1, 2")


def _catalog(k: SparkSession) -> DataFrame:
    return k.createDataFrame([("CLICK", "point"), ("VIEW", "line")], "code string, geometry string")


_add("code_lookup", lambda k, d: s.code_lookup(_survey(k, d), _catalog(k)).groupBy("geometry").agg(F.count("*").alias("points")), f"WITH {_SV} SELECT geometry, count(*) AS points FROM SV LEFT JOIN (VALUES ('CLICK','point'),('VIEW','line')) c(code2, geometry) ON upper(regexp_replace(code, '[0-9]+$', '')) = code2 GROUP BY 1")
_add("unmatched_codes", lambda k, d: s.code_lookup(_survey(k, d), _catalog(k), "left_anti").groupBy("_code").agg(F.count("*").alias("points")).withColumnRenamed("_code", "code"), f"WITH {_SV} SELECT upper(regexp_replace(code, '[0-9]+$', '')) AS code, count(*) AS points FROM SV WHERE upper(regexp_replace(code, '[0-9]+$', '')) NOT IN ('CLICK','VIEW') GROUP BY 1")


def _residuals(k: SparkSession, d: str) -> DataFrame:
    return _table(k, d, "lineitem").select((F.col("l_discount") - 0.05).alias("dx"), (F.col("l_tax") - 0.04).alias("dy"), ((F.col("l_quantity") - 25) / 100).alias("dz"))


_RES = "D AS (SELECT l_discount-0.05::DOUBLE AS dx, l_tax-0.04::DOUBLE AS dy, (l_quantity-25)/100 AS dz FROM lineitem)"
_add("rmse", lambda k, d: _rounded(s.rmse(_residuals(k, d))), f"WITH {_RES}, q AS (SELECT avg(dx*dx) AS x, avg(dy*dy) AS y, avg(dz*dz) AS z, count(*) AS n FROM D) SELECT round(sqrt(x),6) AS rmse_x, round(sqrt(y),6) AS rmse_y, round(sqrt(z),6) AS rmse_z, round(sqrt(x+y),6) AS rmse_2d, round(sqrt(x+y+z),6) AS rmse_3d, n FROM q")
_add("control_points", lambda k, d: _rounded(s.control_points(_residuals(k, d), 0.045)), f"WITH {_RES} SELECT count(*) FILTER (abs(dx)<=0.045 AND abs(dy)<=0.045 AND abs(dz)<=0.045) AS passed, count(*) FILTER (NOT (abs(dx)<=0.045 AND abs(dy)<=0.045 AND abs(dz)<=0.045)) AS failed, round(max(greatest(abs(dx),abs(dy),abs(dz))),6) AS worst FROM D")


def _cells(k: SparkSession, d: str, kind: str) -> DataFrame:
    return event_cloud(k, d).where(F.col("event_type") == kind).select(c.cell("y", 10.0).alias("row"), c.cell("x", 24.0).alias("col"))


_add("correctness", lambda k, d: _rounded(s.correctness(_cells(k, d, "click"), _cells(k, d, "view"))), "WITH a AS (SELECT DISTINCT floor(y/10) AS r, floor(x/24) AS c FROM EV WHERE event_type='click'), b AS (SELECT DISTINCT floor(y/10) AS r, floor(x/24) AS c FROM EV WHERE event_type='view'), q AS (SELECT count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) AS tp, count(*) FILTER (b.r IS NULL) AS fp, count(*) FILTER (a.r IS NULL) AS fn FROM a FULL JOIN b ON a.r=b.r AND a.c=b.c) SELECT tp, fp, fn, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),6) AS f1 FROM q")
_add("completeness", lambda k, d: _rounded(s.completeness(event_cloud(k, d), (0.0, 0.0), (700.0, 150.0), 5.0)), "WITH q AS (SELECT DISTINCT CAST(trunc(y/5) AS BIGINT) AS r, CAST(trunc(x/5) AS BIGINT) AS k FROM EV ) SELECT count(*) AS covered, CAST(30*140 AS BIGINT) AS cells, round(count(*)/4200.0::DOUBLE,6) AS completeness FROM q WHERE r BETWEEN 0 AND 29 AND k BETWEEN 0 AND 139")


def _positions(k: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(k, d, "customer").select(key.alias("id"), ((key * 7919 % 16000) / 100.0 - 80).alias("lat"), ((key * 104729 % 36000) / 100.0 - 180).alias("lon"))


_POS = "P AS (SELECT c_custkey AS id, (c_custkey*7919%16000)/100.0::DOUBLE-80 AS lat, (c_custkey*104729%36000)/100.0::DOUBLE-180 AS lon FROM customer)"
_add("utm_zone", lambda k, d: _positions(k, d).select("id", g.utm_zone(F.col("lat"), F.col("lon")).alias("zone")), f"WITH {_POS} SELECT id, CAST(CASE WHEN lat>=56 AND lat<64 AND lon>=3 AND lon<12 THEN 32 WHEN lat>=72 AND lat<=84 AND lon>=0 AND lon<9 THEN 31 WHEN lat>=72 AND lat<=84 AND lon>=9 AND lon<21 THEN 33 WHEN lat>=72 AND lat<=84 AND lon>=21 AND lon<33 THEN 35 WHEN lat>=72 AND lat<=84 AND lon>=33 AND lon<42 THEN 37 ELSE least(floor((lon+180)/6)+1,60) END AS INTEGER) AS zone FROM P")


def _step(k: SparkSession, d: str) -> DataFrame:
    a = event_cloud(k, d).select("pid", g.point("x", "y", "z").alias("a"))
    b = event_cloud(k, d).select((F.col("pid") - 1).alias("pid"), g.point("x", "y", "z").alias("b"))
    p, q = F.col("a"), F.col("b")
    return a.join(b, "pid").select("pid", g.distance(p, q).alias("d3"), g.distance(p, q, True).alias("d2"), F.abs(p["z"] - q["z"]).alias("dz"), g.slope_percent(p, q).alias("percent"), g.slope_angle(p, q).alias("angle"))


_add("distances", lambda k, d: _rounded(_step(k, d), 4), "WITH q AS (SELECT a.pid, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS h2, b.z-a.z AS dz FROM EV a JOIN EV b ON b.pid=a.pid+1) SELECT pid, round(sqrt(h2+dz*dz),4) AS d3, round(sqrt(h2),4) AS d2, round(abs(dz),4) AS dz, round(CASE WHEN h2>0 THEN abs(dz)*100/sqrt(h2) END,4) AS percent, round(degrees(atan2(dz,sqrt(h2))),4) AS angle FROM q")


_MOMENTS = f"""Q AS (SELECT p.pid, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z FROM {_KNN.replace("WHERE a.pid <> b.pid", "")} p JOIN EM a ON a.pid = p.pid JOIN EM b ON b.pid = p.nid WHERE k <= 10),
C AS (SELECT pid, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz, covar_pop(z,z) AS zz FROM Q GROUP BY 1),
C1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM C), C2 AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM C1),
C3 AS (SELECT *, acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 AS t FROM C2),
L3 AS (SELECT *, q+2*p*cos(t) AS l1, q+2*p*cos(t-2*pi()/3) AS l2, q+2*p*cos(t+2*pi()/3) AS l3 FROM C3)"""
_add("shape_features", lambda k, d: _rounded(h.shape_features(vector_cloud(k, d), 10)), f"WITH {_MOMENTS}, S AS (SELECT *, l1/(l1+l2+l3) AS a, l2/(l1+l2+l3) AS b, l3/(l1+l2+l3) AS c FROM L3) SELECT pid, round(cbrt(l1*l2*l3),6) AS omnivariance, round((l1-l3)/l1,6) AS anisotropy, round((l1-l2)/l1,6) AS linearity, round((l2-l3)/l1,6) AS planarity, round(l3/l1,6) AS sphericity, round(c,6) AS surface_variation, round(-(a*ln(a)+b*ln(b)+c*ln(c)),6) AS eigenentropy FROM S")
_add("pca_curvature", lambda k, d: _rounded(h.normals(vector_cloud(k, d), 10).select("pid", "curvature")), f"WITH {_MOMENTS} SELECT pid, round(l3/(l1+l2+l3),6) AS curvature FROM L3")
_add("pca_normals", lambda k, d: _rounded(h.normals(vector_cloud(k, d), 10).select("pid", F.abs("nx").alias("ax"), F.abs("ny").alias("ay"), F.abs("nz").alias("az"))), f"WITH {_MOMENTS} SELECT pid, " + ", ".join(f"round(sqrt(({m} - l3*({t}) + l3*l3) / ((l1-l3)*(l2-l3))), 6) AS {name}" for m, t, name in (("yy*zz-yz*yz", "yy+zz", "ax"), ("xx*zz-xz*xz", "xx+zz", "ay"), ("xx*yy-xy*xy", "xx+yy", "az"))) + " FROM L3")
_add("density_summary", lambda k, d: _rounded(h.density_summary(c.density_map(event_cloud(k, d), 20.0))), "WITH m AS (SELECT min(x) AS x0, min(y) AS y0 FROM EV ), r AS (SELECT count(*)/400.0::DOUBLE AS density FROM EV CROSS JOIN m GROUP BY trunc((y-y0)/20), trunc((x-x0)/20)) SELECT round(avg(density),6) AS mean, round(min(density),6) AS min, round(max(density),6) AS max, round(stddev_pop(density),6) AS std, count(*) AS cells FROM r")
_add("segment_sizes", lambda k, d: h.segment_sizes(_table(k, d, "events").select((F.col("user_id") - 5).cast("long").alias("segment")), "segment"), "SELECT CAST(user_id - 5 AS BIGINT) AS segment, count(*) AS points FROM events WHERE user_id >= 5 GROUP BY 1")
_add("survey_codes", lambda k, d: _survey(k, d).select("code").where("code is not null").distinct(), f"WITH {_SV} SELECT DISTINCT code FROM SV WHERE code IS NOT NULL")


def _named(columns: tuple, names: str) -> list:
    return [v.alias(a) for v, a in zip(columns, names.split(), strict=True)]


_ECEF = f"R AS (SELECT id, radians(lat) AS p, radians(lon) AS q, {geo.AXIS}::DOUBLE/sqrt(1-{geo._E2!r}::DOUBLE*sin(radians(lat))*sin(radians(lat))) AS n FROM P), X AS (SELECT id, (n+100)*cos(p)*cos(q) AS x, (n+100)*cos(p)*sin(q) AS y, (n*(1-{geo._E2!r}::DOUBLE)+100)*sin(p) AS z FROM R)"


def _geocentric(k: SparkSession, d: str) -> DataFrame:
    return _positions(k, d).select("id", *_named(geo.geocentric(F.col("lat"), F.col("lon"), F.lit(100.0)), "x y z"))


_SHIFT, _TURN, _PPM = (446.448, -125.157, 542.06), (0.15, 0.247, 0.842), -20.489
_add("geocentric", lambda k, d: _rounded(_geocentric(k, d), 3), f"WITH {_POS}, {_ECEF} SELECT id, round(x,3) AS x, round(y,3) AS y, round(z,3) AS z FROM X")
_rx, _ry, _rz = (f"radians({a}::DOUBLE/3600)" for a in _TURN)
_add("helmert", lambda k, d: _rounded(_geocentric(k, d).select("id", *_named(geo.helmert(F.col("x"), F.col("y"), F.col("z"), _SHIFT, _TURN, _PPM), "x y z")), 3), f"WITH {_POS}, {_ECEF} SELECT id, round({_SHIFT[0]}+(1+{_PPM}::DOUBLE*1e-6)*(x-{_rz}*y+{_ry}*z),3) AS x, round({_SHIFT[1]}+(1+{_PPM}::DOUBLE*1e-6)*({_rz}*x+y-{_rx}*z),3) AS y, round({_SHIFT[2]}+(1+{_PPM}::DOUBLE*1e-6)*(-{_ry}*x+{_rx}*y+z),3) AS z FROM X")
_XI = " + ".join(["xi", *[f"{a!r}::DOUBLE*sin({2 * k}*xi)*(exp({2 * k}*eta)+exp(-{2 * k}*eta))/2" for k, a in enumerate(geo.SERIES, 1)]])
_ETA = " + ".join(["eta", *[f"{a!r}::DOUBLE*cos({2 * k}*xi)*(exp({2 * k}*eta)-exp(-{2 * k}*eta))/2" for k, a in enumerate(geo.SERIES, 1)]])
_E1 = f"sqrt({geo._E2!r}::DOUBLE)"


def _utm(k: SparkSession, d: str) -> DataFrame:
    zoned = _positions(k, d).withColumn("zone", g.utm_zone(F.col("lat"), F.col("lon")))
    return zoned.select("id", "zone", *_named(geo.utm(F.col("lat"), F.col("lon"), F.col("zone")), "east north"))


_add("utm_forward", lambda k, d: _rounded(_utm(k, d), 3), ORACLE_SQL["utm_zone"].replace("SELECT id, CAST(", "Z AS (SELECT id, lat, lon, CAST(", 1).replace("FROM customer)", "FROM customer),", 1) + f"), A AS (SELECT *, sin(radians(lat)) AS s, radians(lon-(zone*6-183)) AS w FROM Z), B AS (SELECT *, atanh(s)-{_E1}*atanh({_E1}*s) AS psi FROM A), U AS (SELECT *, (exp(psi)-exp(-psi))/2 AS tau FROM B), W AS (SELECT *, atan2(tau, cos(w)) AS xi, atanh(sin(w)/sqrt(1+tau*tau)) AS eta FROM U) SELECT id, zone, round(500000+0.9996::DOUBLE*{geo.RADIUS!r}::DOUBLE*({_ETA}),3) AS east, round(0.9996::DOUBLE*{geo.RADIUS!r}::DOUBLE*({_XI}) + CASE WHEN lat<0 THEN 10000000 ELSE 0 END,3) AS north FROM W")
