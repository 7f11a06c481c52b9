"""Registered queries on profiles, lines on meshes, elevation grids and sight between points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.operators import figures, lines, profiles, visibility
from cragspan.plans import queries as q

_LN = f"LN AS (SELECT n_nationkey AS line, (n_nationkey%7+0.3::DOUBLE)*s AS x0, (n_nationkey*3%11+0.2::DOUBLE)*s AS y0, (n_nationkey*5%13+0.9::DOUBLE)*s AS x1, (n_nationkey*2%9+2.4::DOUBLE)*s AS y1 FROM nation, (SELECT ({q._SIDE} - 1) / 15.0::DOUBLE AS s))"
_LL = f"{_LN}, LL AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM LN)"


def _steps(length: str, interval: float) -> str:
    count = f"CAST(floor({length}/{interval}::DOUBLE+1e-9) AS BIGINT)"
    return f"list_concat(list_transform(range(0, {count}+1), lambda i: i*{interval}::DOUBLE), CASE WHEN {length}-{count}*{interval}::DOUBLE > 1e-9 THEN [{length}] ELSE [] END)"


#: The surface at the points P(pid, x, y): Z(pid, z).
_Z = f"""I AS (SELECT P.pid, tid, {q._w1} AS w1, {q._w2} AS w2, z0, z1, z2 FROM P, FACE WHERE P.x BETWEEN least(x0,x1,x2)-1e-6 AND greatest(x0,x1,x2)+1e-6 AND P.y BETWEEN least(y0,y1,y2)-1e-6 AND greatest(y0,y1,y2)+1e-6),
Z AS (SELECT pid, w1*z0+w2*z1+(1-w1-w2)*z2 AS zz FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tid) AS k FROM I WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND 1-w1-w2 >= -1e-9) WHERE k = 1)"""


def _lines(k: SparkSession, d: str) -> DataFrame:
    n, s = F.col("n_nationkey"), (q.grid_side(k, d) - 1) / 15.0
    at = {"x0": n % 7 + 0.3, "y0": n * 3 % 11 + 0.2, "x1": n * 5 % 13 + 0.9, "y1": n * 2 % 9 + 2.4}
    return q._table(k, d, "nation").select(n.cast("long").alias("line"), *[(v * s).alias(c) for c, v in at.items()])


_OFFSET = "SELECT line, offset_ AS \"offset\", round(station,6) AS station, round(P.x,6) AS x, round(P.y,6) AS y, round(zz,6) AS z FROM P LEFT JOIN Z USING (pid)"
_ALONG = f"{_LL}, ST AS (SELECT *, unnest({_steps('l', 0.7)}) AS station FROM LL WHERE l > 0), OF_ AS (SELECT *, unnest([{{o}}]) AS offset_ FROM ST), P AS (SELECT row_number() OVER () AS pid, line, offset_, station, x0+station*(x1-x0)/l-offset_*(y1-y0)/l AS x, y0+station*(y1-y0)/l+offset_*(x1-x0)/l AS y FROM OF_), {_Z}"
q._add("profile_longitudinal", lambda k, d: q._rounded(profiles.longitudinal(_lines(k, d), q._faces(k, d), 0.7, 1.0)), f"WITH {_ALONG.format(o='0.0::DOUBLE')} {_OFFSET}")
q._add("profile_parallel", lambda k, d: q._rounded(profiles.longitudinal(_lines(k, d), q._faces(k, d), 0.7, 1.0, [0.5, -0.5])), f"WITH {_ALONG.format(o='-0.5::DOUBLE, 0.5::DOUBLE')} {_OFFSET}")
_SIDES = f"list_distinct(list_concat(list_transform({_steps('1.3::DOUBLE', 0.4)}, lambda v: 0.0::DOUBLE-v), {_steps('1.3::DOUBLE', 0.4)}))"
q._add("profile_transversal", lambda k, d: q._rounded(profiles.transversal(_lines(k, d), q._faces(k, d), 1.1, 0.4, 1.3, 1.0)), f"WITH {_LL}, OF_ AS (SELECT *, 1.1::DOUBLE AS station, unnest({_SIDES}) AS offset_ FROM LL WHERE l > 0), P AS (SELECT row_number() OVER () AS pid, line, offset_, station, x0+station*(x1-x0)/l-offset_*(y1-y0)/l AS x, y0+station*(y1-y0)/l+offset_*(x1-x0)/l AS y FROM OF_), {_Z} {_OFFSET}")


def _axis(k: SparkSession, d: str) -> DataFrame:
    c, s = F.col("s_suppkey").cast("long"), (q.grid_side(k, d) - 1) / 15.0
    return q._table(k, d, "supplier").select(F.floor(c / 5).alias("line"), (c % 5).alias("ord"), ((c % 5 * 2.1 + c % 3 + 1.0) * s).alias("x"), ((c * 7 % 11 + 1.5) * s).alias("y"))


_AXIS = f"""AX AS (SELECT s_suppkey//5 AS line, s_suppkey%5 AS ord, (s_suppkey%5*2.1::DOUBLE+s_suppkey%3+1.0)*s AS x, (s_suppkey*7%11+1.5::DOUBLE)*s AS y FROM supplier, (SELECT ({q._SIDE} - 1) / 15.0::DOUBLE AS s)),
DI AS (SELECT line, ord, x, y, coalesce(lead(x) OVER w, x)-coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y)-coalesce(lag(y) OVER w, y) AS dy, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2), 0) AS step FROM AX WINDOW w AS (PARTITION BY line ORDER BY ord)),
DJ AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY ord) AS station, sqrt(dx*dx+dy*dy) AS l FROM DI)"""
q._add("profile_cross_sections", lambda k, d: q._rounded(profiles.cross_sections(_axis(k, d), q._faces(k, d), 0.4, 1.3, 1.0)), f"WITH {_AXIS}, OF_ AS (SELECT *, unnest({_SIDES}) AS offset_ FROM DJ WHERE l > 0), P AS (SELECT row_number() OVER () AS pid, line, offset_, station, x-offset_*dy/l AS x, y+offset_*dx/l AS y FROM OF_), {_Z} {_OFFSET}")
q._add("axis_directions", lambda k, d: q._rounded(profiles.directed(_axis(k, d))), f"WITH {_AXIS} SELECT line, ord, round(x,6) AS x, round(y,6) AS y, round(station,6) AS station, round(dx/nullif(l,0),6) AS ux, round(dy/nullif(l,0),6) AS uy FROM DJ")

_SPAN = f"({q._SIDE} - 1)"


def _dtm(k: SparkSession, d: str) -> DataFrame:
    side = q.grid_side(k, d) - 1.0
    return lines.dtm(q._faces(k, d), (-0.5, -0.5), (side, side), 0.5)


_DTM = f"""NO AS (SELECT CAST(ceil(({_SPAN}+0.5::DOUBLE)/0.5::DOUBLE) AS BIGINT)+1 AS m), P AS (SELECT r.range*m+c.range AS pid, r.range AS "row", c.range AS col, -0.5::DOUBLE+c.range*0.5::DOUBLE AS x, -0.5::DOUBLE+r.range*0.5::DOUBLE AS y FROM range((SELECT m FROM NO)) r, range((SELECT m FROM NO)) c, NO), {_Z}"""
q._add("dtm_from_mesh", lambda k, d: q._rounded(_dtm(k, d)), f'WITH {_DTM} SELECT "row", col, P.x, P.y, round(zz,6) AS z FROM P LEFT JOIN Z USING (pid)')
q._add("raster_no_data", lambda k, d: lines.no_data(_dtm(k, d)), f"WITH {_DTM} SELECT count(zz) AS valid, count(*)-count(zz) AS empty FROM P LEFT JOIN Z USING (pid)")
q._add("raster_filled", lambda k, d: q._rounded(lines.filled(lines.masked(q.event_grid(k, d), q.event_grid(k, d).where("z > 300")), -1.0)), 'SELECT "row", col, round(CASE WHEN z > 300 THEN -1 ELSE z END, 6) AS z FROM GRID')
q._add("edge_lengths", lambda k, d: q._rounded(lines.edge_lengths(*q.event_mesh(k, d))), "SELECT DISTINCT E.a, E.b, round(sqrt((p.x-r.x)**2+(p.y-r.y)**2+(p.z-r.z)**2),6) AS length FROM E JOIN V p ON p.vid = E.a JOIN V r ON r.vid = E.b")
q._add("region_boundaries", lambda k, d: lines.boundary_edges(q.event_mesh(k, d)[1], q.event_mesh(k, d)[1].select("tid", F.expr("tid div 7 % 5").alias("region"))), "SELECT tid // 7 % 5 AS region, a, b FROM E GROUP BY ALL HAVING count(*) = 1")
q._add("slope_change_edges", lambda k, d: q._rounded(lines.slope_change_edges(*q.event_mesh(k, d), 10.0), 5), "WITH SL AS (SELECT tid, degrees(acos(least(c*turn/size,1))) AS slope FROM N ) SELECT a, b, round(max(slope)-min(slope),5) AS change FROM E JOIN SL USING (tid) GROUP BY 1, 2 HAVING count(*) = 2 AND max(slope)-min(slope) >= 10")
_LEN = "sum(sqrt((p.x-r.x)**2+(p.y-r.y)**2+(p.z-r.z)**2))"


def _whole(found: DataFrame) -> DataFrame:
    return q._rounded(found.agg(F.sum("length").alias("length"), F.sum(F.size("vertices") - 1).alias("edges")), 5)


q._add("break_lines_total", lambda k, d: _whole(lines.break_lines(*q.event_mesh(k, d), 25.0, 0.0)), f"WITH u AS (SELECT tid, a*turn/size AS nx, b*turn/size AS ny, c*turn/size AS nz FROM N ), g AS (SELECT p.a, p.b FROM E p JOIN E q ON p.a=q.a AND p.b=q.b AND p.tid<q.tid JOIN u m ON m.tid=p.tid JOIN u k ON k.tid=q.tid WHERE degrees(acos(greatest(least(m.nx*k.nx+m.ny*k.ny+m.nz*k.nz,1),-1))) >= 25) SELECT round({_LEN},5) AS length, count(*) AS edges FROM g JOIN V p ON p.vid = g.a JOIN V r ON r.vid = g.b")
q._add("drainage_lines_total", lambda k, d: _whole(lines.drainage(*q.event_mesh(k, d), 0.05, 0.0)), f"WITH g AS (SELECT p.a, p.b FROM E p JOIN E q ON p.a=q.a AND p.b=q.b AND p.tid<q.tid JOIN V a ON a.vid=p.a JOIN V b ON b.vid=p.b JOIN V o ON o.vid=p.o JOIN V u ON u.vid=q.o WHERE o.z >= (a.z+b.z)/2+0.05 AND u.z >= (a.z+b.z)/2+0.05) SELECT round({_LEN},5) AS length, count(*) AS edges FROM g JOIN V p ON p.vid = g.a JOIN V r ON r.vid = g.b")
q._add("slope_change_lines_total", lambda k, d: _whole(lines.slope_changes(*q.event_mesh(k, d), 10.0, 0.0)), f"WITH SL AS (SELECT tid, degrees(acos(least(c*turn/size,1))) AS slope FROM N ), g AS (SELECT a, b FROM E JOIN SL USING (tid) GROUP BY 1, 2 HAVING count(*) = 2 AND max(slope)-min(slope) >= 10) SELECT round({_LEN},5) AS length, count(*) AS edges FROM g JOIN V p ON p.vid = g.a JOIN V r ON r.vid = g.b")
QUERIES = q.QUERIES
QUERIES["channel_lines"] = lambda k, d: q._rounded(lines.channels(*q.event_mesh(k, d)).select("root", "part", "length"))
QUERIES["curb_lines"] = lambda k, d: q._rounded(lines.curbs(*q.event_mesh(k, d)).select("root", "part", "length"))
_LEVEL = "l AS (SELECT *, 0.0::DOUBLE + k.range*0.5::DOUBLE AS level FROM FACE CROSS JOIN range(0, 1000) k WHERE k.range BETWEEN ceil(least(z0,z1,z2)/0.5::DOUBLE) AND floor(greatest(z0,z1,z2)/0.5::DOUBLE) AND greatest(z0,z1,z2) > least(z0,z1,z2))"
q._add("contour_lines", lambda k, d: q._rounded(lines.contour_lines(q._faces(k, d), 0.5).groupBy("level").agg(F.sum("length").alias("length")), 4), f"WITH {_LEVEL}, s AS ({q._SEG}), m AS (SELECT tid, level, min(x) AS xa, max(x) AS xb, arg_min(y, x) AS ya, arg_max(y, x) AS yb, min(y) AS yl, max(y) AS yh FROM s GROUP BY 1, 2 HAVING count(*) = 2) SELECT level, round(sum(sqrt((xb-xa)**2+(yh-yl)**2)),4) AS length FROM m GROUP BY 1 HAVING sum(sqrt((xb-xa)**2+(yh-yl)**2)) > 0")
q._add("welded_vertices", lambda k, d: lines.welded(q.event_mesh(k, d)[0], q._table(k, d, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("ord"), (F.col("event_id") % 40).cast("double").alias("x"), (F.col("user_id") % 9 + 0.5 * (F.col("event_id") % 2)).alias("y"), F.col("value").alias("z"))).groupBy("fresh").agg(F.count("*").alias("points"), F.count_distinct("vid").alias("vertices")), "WITH p AS (SELECT CAST(event_id % 40 AS DOUBLE) AS x, user_id % 9 + 0.5::DOUBLE * (event_id % 2) AS y FROM events) SELECT V.vid IS NULL AS fresh, count(*) AS points, count(DISTINCT (p.x, p.y)) AS vertices FROM p LEFT JOIN V ON V.x = p.x AND V.y = p.y GROUP BY 1")
q._add("mesh_problems", lambda k, d: lines.mesh_problems(q.event_mesh(k, d)[0].where("vid % 17 <> 3"), q.event_mesh(k, d)[1].withColumn("v2", F.when(F.col("tid") % 11 == 0, F.col("v0")).otherwise(F.col("v2")))), "WITH w AS (SELECT tid, v0, v1, CASE WHEN tid % 11 = 0 THEN v0 ELSE v2 END AS v2 FROM T ) SELECT tid, CASE WHEN v0 % 17 = 3 OR v1 % 17 = 3 OR v2 % 17 = 3 THEN 'unknown_vertex' ELSE 'repeated_vertex' END AS problem FROM w WHERE v0 % 17 = 3 OR v1 % 17 = 3 OR v2 % 17 = 3 OR v0 = v2")


def _posts(k: SparkSession, d: str) -> DataFrame:
    c, s = F.col("s_suppkey"), (q.grid_side(k, d) - 1) / 15.0
    return q._table(k, d, "supplier").select(c.alias("pid"), ((c * 7 % 13 + 0.45) * s).alias("x"), ((c * 5 % 14 + 0.55) * s).alias("y"))


def _intervisible(k: SparkSession, d: str) -> DataFrame:
    placed, found = visibility.sights(_posts(k, d), q._faces(k, d), None, 1.7, 20, 1.0)
    return visibility.paired(_posts(k, d), placed, q._rounded(found))  # rounded once a sight


QUERIES["intervisibility"] = _intervisible
