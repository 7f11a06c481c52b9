"""Registered queries on features, alignments, sight and geodesics, added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.functions import geodesy as geo
from cragspan.operators import alignment as road
from cragspan.operators import features, survey, terrain, visibility
from cragspan.plans import queries as q
from cragspan.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

_CODES = [1, 2, 3, 4, 5, 6, 11]


def _classified(k: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("label") % 7 + 1).cast("int"))
    return q.vector_cloud(k, d).select("pid", *[(F.col(a) * 9).alias(a) for a in "xyz"], code.alias("classification"), F.col("z").alias("nz"))


def _bound(v: float) -> str:
    return "'infinity'::DOUBLE" if v == float("inf") else f"{v}::DOUBLE"


_RULES = ", ".join(f"('{k}', {code}, {eps}::DOUBLE, {least}, {', '.join(_bound(v) for b in bounds for v in b)}, {9.0 if nz is None else nz}::DOUBLE)" for k, (codes, eps, least, *bounds, nz) in features.DETECTORS.items() for code in codes)
q._add("detect_features", lambda k, d: q._rounded(features.detect(_classified(k, d)).drop("elongation"), 5), f"""WITH RECURSIVE U(detector, code, eps, least, h0, h1, e0, e1, g0, g1, nz) AS (VALUES {_RULES}),
P AS (SELECT pid, x*9 AS x, y*9 AS y, z*9 AS z, [1,2,3,4,5,6,11][label % 7 + 1] AS code, z AS nz FROM EM ),
Q AS (SELECT P.pid, P.x, P.y, P.z, U.* FROM P JOIN U ON P.code = U.code AND abs(P.nz) <= U.nz),
L AS (SELECT a.detector, a.pid AS a, b.pid AS b FROM Q a JOIN Q b ON a.detector = b.detector AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= a.eps*a.eps),
R AS (SELECT detector, a AS pid, a AS root FROM L UNION SELECT L.detector, L.b, R.root FROM R JOIN L ON L.a = R.pid AND L.detector = R.detector WHERE R.root < L.b),
M AS (SELECT detector, pid, min(root) AS root FROM R GROUP BY 1, 2),
A AS (SELECT detector, root AS first, count(*) AS points, avg(x) AS mean_x, min(x) AS low_x, max(x) AS high_x, avg(y) AS mean_y, min(y) AS low_y, max(y) AS high_y, avg(z) AS mean_z, min(z) AS low_z, max(z) AS high_z,
 sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))) AS extent, max(z)-min(z) AS height, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, any_value(least) AS least, any_value(h0) AS h0, any_value(h1) AS h1, any_value(e0) AS e0, any_value(e1) AS e1, any_value(g0) AS g0, any_value(g1) AS g1 FROM M JOIN Q USING (detector, pid) GROUP BY 1, 2),
B AS (SELECT *, (xx+yy)/2 AS mid, sqrt((xx-yy)*(xx-yy)/4+xy*xy) AS half FROM A)
SELECT detector, first, points, {", ".join(f"round({c},5) AS {c}" for a in "xyz" for c in (f"mean_{a}", f"low_{a}", f"high_{a}"))}, round(height,5) AS height, round(extent,5) AS extent FROM B
WHERE points >= least AND height BETWEEN h0 AND h1 AND extent BETWEEN e0 AND e1 AND CASE WHEN mid-half > 1e-12 THEN sqrt((mid+half)/(mid-half)) ELSE 'infinity'::DOUBLE END BETWEEN g0 AND g1""")


def _embankments(k: SparkSession, d: str) -> DataFrame:
    return features.embankments(q._faces(k, d), q.event_mesh(k, d)[1], 25.0, 4)


q._add("embankments", lambda k, d: q._rounded(_embankments(k, d)), """WITH RECURSIVE S AS (SELECT tid, size/2 AS area, degrees(acos(abs(c)/size)) AS slope FROM N WHERE degrees(acos(abs(c)/size)) >= 25),
L AS (SELECT DISTINCT p.tid AS a, r.tid AS b FROM E p JOIN E r ON p.a = r.a AND p.b = r.b JOIN S s1 ON s1.tid = p.tid JOIN S s2 ON s2.tid = r.tid),
R AS (SELECT a AS tid, a AS root FROM L UNION SELECT L.b, R.root FROM R JOIN L ON L.a = R.tid WHERE R.root < L.b),
M AS (SELECT tid, min(root) AS root FROM R GROUP BY 1)
SELECT root AS first, count(*) AS triangles, round(sum(area),6) AS area, round(avg(slope),6) AS slope FROM M JOIN S USING (tid) GROUP BY 1 HAVING count(*) >= 4""")


def _rays(k: SparkSession, d: str) -> DataFrame:
    i, f = F.col("c_custkey"), (q.grid_side(k, d) - 1) / 15.0
    at = {"x0": (i % 13 + 0.3) * f, "y0": (i * 7 % 14 + 0.4) * f, "z0": F.lit(2.5) + i % 3, "x1": (i * 5 % 14 + 0.6) * f, "y1": (i * 3 % 13 + 0.7) * f, "z1": F.lit(2.0) + i % 4}
    return q._table(k, d, "customer").select(i.alias("ray"), *[v.cast("double").alias(c) for c, v in at.items()])


_F = f"(({q._SIDE} - 1) / 15.0::DOUBLE)"
_SIGHT = f"""RAY AS (SELECT i AS ray, (i%13+0.3::DOUBLE)*{_F} AS x0, (i*7%14+0.4::DOUBLE)*{_F} AS y0, 2.5::DOUBLE+i%3 AS z0, (i*5%14+0.6::DOUBLE)*{_F} AS x1, (i*3%13+0.7::DOUBLE)*{_F} AS y1, 2.0::DOUBLE+i%4 AS z1 FROM (SELECT c_custkey AS i FROM customer)),
G AS (SELECT ray * 100 + k AS pid, ray, x0+t*(x1-x0) AS x, y0+t*(y1-y0) AS y, z0+t*(z1-z0)-((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))*t*(1-t)/(2*{visibility.EARTH_RADIUS}::DOUBLE) AS sight FROM (SELECT *, k/20.0::DOUBLE AS t FROM RAY, range(1, 20) s(k))),
I AS (SELECT P.pid, P.ray, P.sight, tid, {q._w1} AS w1, {q._w2} AS w2, z0, z1, z2 FROM G P, FACE ),
O AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tid) AS k FROM I WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND 1-w1-w2 >= -1e-9),
W AS (SELECT ray, min(sight-w1*z0-w2*z1-(1-w1-w2)*z2) AS clearance, count(*) FILTER (sight-w1*z0-w2*z1-(1-w1-w2)*z2 < 0) AS blocked FROM O WHERE k = 1 GROUP BY 1)"""
q._add("line_of_sight", lambda k, d: q._rounded(visibility.line_of_sight(_rays(k, d), q._faces(k, d), 20, 1.0)), f"WITH {_SIGHT} SELECT RAY.ray, round(clearance,6) AS clearance, CAST(coalesce(blocked,0) AS BIGINT) AS blocked, coalesce(blocked,0) = 0 AS visible FROM RAY LEFT JOIN W USING (ray)")


def _targets(k: SparkSession, d: str) -> DataFrame:
    side = q.grid_side(k, d) - 2
    return k.range(side * side).select(F.col("id").alias("pid"), (F.col("id") % side + 0.45).alias("x"), (F.floor(F.col("id") / side) + 0.55).alias("y"))


QUERIES["viewshed"] = lambda k, d: visibility.viewshed((1.3, 1.6, 5.0), _targets(k, d), q._faces(k, d), 1.7, 20, 1.0)


def _elements(k: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    base = q._table(k, d, "nation").select(n.alias("alignment"), F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(m).alias("length"), F.lit(kind).alias("kind"), F.lit(r).cast("double").alias("radius")) for s, m, kind, r in ((0.0, 150.0, "line", None), (150.0, 60.0, "spiral", 200.0), (210.0, 180.0, "arc", -120.0), (390.0, 60.0, "line", None))])).alias("e"))
    return base.select("alignment", "e.*").withColumns({"x": F.col("alignment") * 10 + F.col("start"), "y": F.col("alignment") * 5.0, "heading": F.col("alignment") * 0.2})


def _stations(k: SparkSession, d: str, lines: int) -> DataFrame:
    return q._table(k, d, "events").select(F.col("event_id").alias("sid"), (F.col("user_id") % lines).cast("long").alias("alignment"), (F.sqrt("value") * 20).alias("station"))


_U = " + ".join(f"{(-1) ** n}::DOUBLE/({4 * n + 1}.0::DOUBLE*{'*'.join(str(j) for j in range(1, 2 * n + 1)) or '1'}) * w**{2 * n}" for n in range(9))
_V = " + ".join(f"{(-1) ** n}::DOUBLE/({4 * n + 3}.0::DOUBLE*{'*'.join(str(j) for j in range(1, 2 * n + 2))}) * w**{2 * n + 1}" for n in range(9))
_ELEMENT = f"""E0 AS (SELECT CAST(n_nationkey AS BIGINT) AS alignment, b.* FROM nation, (VALUES (0.0::DOUBLE,150.0::DOUBLE,'line',NULL::DOUBLE),(150.0,60.0,'spiral',200.0),(210.0,180.0,'arc',-120.0),(390.0,60.0,'line',NULL)) b(start, length, kind, r)),
E1 AS (SELECT *, alignment*10+start AS x, alignment*5.0::DOUBLE AS y, alignment*0.2::DOUBLE AS h FROM E0)"""
_ALONG = f"""D1 AS (SELECT *, s*s/(2*r*length) AS w FROM D0), D2 AS (SELECT *, s*({_U}) AS u, s*({_V}) AS v FROM D1),
D3 AS (SELECT *, x + CASE kind WHEN 'arc' THEN r*(sin(h+s/r)-sin(h)) WHEN 'spiral' THEN u*cos(h)-v*sin(h) ELSE s*cos(h) END AS px, y + CASE kind WHEN 'arc' THEN r*(cos(h)-cos(h+s/r)) WHEN 'spiral' THEN u*sin(h)+v*cos(h) ELSE s*sin(h) END AS py, CASE kind WHEN 'arc' THEN 1/r WHEN 'spiral' THEN s/(r*length) ELSE 0 END AS curvature FROM D2)"""
q._add("station_points", lambda k, d: q._rounded(road.station_points(_stations(k, d, 25), _elements(k, d))), f"WITH {_ELEMENT}, D0 AS (SELECT event_id AS sid, E1.*, sqrt(value)*20-start AS s, row_number() OVER (PARTITION BY event_id ORDER BY start) AS k FROM events JOIN E1 ON user_id % 25 = alignment AND sqrt(value)*20 BETWEEN start AND start+length), {_ALONG} SELECT sid, round(px,6) AS px, round(py,6) AS py, round(curvature,6) AS curvature FROM D3 WHERE k = 1")
q._add("alignment_continuity", lambda k, d: q._rounded(road.continuity(_elements(k, d))), f"WITH {_ELEMENT}, D0 AS (SELECT *, length AS s FROM E1), {_ALONG}, J AS (SELECT alignment, start, sqrt((lead(x) OVER o - px)**2 + (lead(y) OVER o - py)**2) AS gap FROM D3 WINDOW o AS (PARTITION BY alignment ORDER BY start)) SELECT alignment, start, round(gap,6) AS gap, gap <= 1e-6 AS joined FROM J")


def _pvis(k: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id").cast("long")
    z = q._table(k, d, "events").groupBy((u % 5).alias("alignment"), (F.floor(u / 5) * 20.0).alias("station")).agg(((F.min("value") + F.max("value")) / 2).alias("z"))
    return z.withColumns({"length_in": F.lit(6.0), "length_out": F.when(F.col("station") % 40 == 0, 8.0).otherwise(6.0)})


_PROFILE = """I AS (SELECT CAST(user_id % 5 AS BIGINT) AS alignment, (user_id // 5)*20.0::DOUBLE AS station, (min(value)+max(value))/2 AS z, 6.0::DOUBLE AS li, CASE WHEN (user_id // 5) % 2 = 0 THEN 8.0 ELSE 6.0 END::DOUBLE AS lo FROM events GROUP BY ALL),
A AS (SELECT *, (lead(z) OVER o - z)/(lead(station) OVER o - station) AS g2, lead(station) OVER o - lead(li) OVER o - station - lo AS free FROM (SELECT alignment, station, min(z) AS z, min(li) AS li, min(lo) AS lo FROM I GROUP BY 1, 2) WINDOW o AS (PARTITION BY alignment ORDER BY station)),
B AS (SELECT *, lag(g2) OVER (PARTITION BY alignment ORDER BY station) AS g1 FROM A),
C AS (SELECT alignment, station-li AS start, li+lo AS length, li, z-g1*li AS z, g1, g2 FROM B WHERE g1 IS NOT NULL AND g2 IS NOT NULL UNION ALL SELECT alignment, station+lo, free, free, z+g2*lo, g2, g2 FROM B WHERE free > 0)"""
_PVI_FIX = _PROFILE.replace("GROUP BY ALL", "GROUP BY 1, 2, user_id // 5").replace("(SELECT alignment, station, min(z) AS z, min(li) AS li, min(lo) AS lo FROM I GROUP BY 1, 2)", "I")
q._add("vertical_profile", lambda k, d: q._rounded(road.profile(_pvis(k, d))), f"WITH {_PVI_FIX} SELECT alignment, round(start,6) AS start, round(length,6) AS length, round(li,6) AS length_in, round(z,6) AS z, round(g1,6) AS g1, round(g2,6) AS g2 FROM C")
q._add("profile_elevations", lambda k, d: q._rounded(road.profile_elevations(_stations(k, d, 5), road.profile(_pvis(k, d)))), f"""WITH {_PVI_FIX}, X AS (SELECT event_id AS sid, C.*, sqrt(value)*20-start AS s, length-li AS b, (g1*li+g2*(length-li))/length AS m, row_number() OVER (PARTITION BY event_id ORDER BY start) AS k FROM events JOIN C ON user_id % 5 = alignment AND sqrt(value)*20 BETWEEN start AND start+length)
SELECT sid, round(CASE WHEN s <= li THEN z+g1*s+(m-g1)*s*s/(2*li) ELSE z+(g1+m)/2*li+m*(s-li)+(g2-m)*(s-li)*(s-li)/(2*b) END,6) AS elevation, round(CASE WHEN s <= li THEN g1+(m-g1)*s/li ELSE m+(g2-m)*(s-li)/b END,6) AS grade FROM X WHERE k = 1""")


def _geodesics(k: SparkSession, d: str) -> DataFrame:
    p = q._positions(k, d)
    return p.select("id", F.round(geo.geodesic(F.col("lat"), F.col("lon"), F.col("lat") / 2 + 3, F.col("lon") + F.col("id") % 50), 3).alias("length"))


_f, _b = repr(geo.FLATTENING), repr(geo.AXIS * (1 - geo.FLATTENING))
_SPHERE = "sqrt((cos(u1)*sin(t))**2+(cos(u0)*sin(u1)-sin(u0)*cos(u1)*cos(t))**2) AS si, sin(u0)*sin(u1)+cos(u0)*cos(u1)*cos(t) AS co"
_TURNS = ", ".join(f"""S{i} AS (SELECT id, u0, u1, w, {_SPHERE} , t FROM T{i}), A{i} AS (SELECT *, coalesce(cos(u0)*cos(u1)*sin(t)/nullif(si,0),0) AS al, atan2(si,co) AS sg FROM S{i}), B{i} AS (SELECT *, 1-al*al AS sq, CASE WHEN 1-al*al > 1e-15 THEN co-2*sin(u0)*sin(u1)/(1-al*al) ELSE 0 END AS m FROM A{i}), C{i} AS (SELECT *, {_f}::DOUBLE/16*sq*(4+{_f}::DOUBLE*(4-3*sq)) AS c FROM B{i}), T{i + 1} AS (SELECT id, u0, u1, w, w+(1-c)*{_f}::DOUBLE*al*(sg+c*si*(m+c*co*(2*m*m-1))) AS t FROM C{i})""" for i in range(8))
q._add("geodesic_lengths", _geodesics, f"""WITH {q._POS}, T0 AS (SELECT id, atan((1-{_f}::DOUBLE)*tan(radians(lat))) AS u0, atan((1-{_f}::DOUBLE)*tan(radians(lat/2+3))) AS u1, radians(CAST(id % 50 AS DOUBLE)) AS w, radians(CAST(id % 50 AS DOUBLE)) AS t FROM P), {_TURNS},
H AS (SELECT *, sq*({geo.AXIS}::DOUBLE**2-{_b}::DOUBLE**2)/{_b}::DOUBLE**2 AS k FROM B7), J AS (SELECT *, 1+k/16384*(4096+k*(-768+k*(320-175*k))) AS ba, k/1024*(256+k*(-128+k*(74-47*k))) AS bb FROM H)
SELECT id, round({_b}::DOUBLE*ba*(sg-bb*si*(m+bb/4*(co*(2*m*m-1)-bb/6*m*(4*si*si-3)*(4*m*m-3)))),3) AS length FROM J""")


def _codes(k: SparkSession, d: str) -> DataFrame:
    zone, half = geo.utm_from_epsg(F.col("code"))
    return q._table(k, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(32590) + F.col("c_custkey") % 180).alias("code")).select("id", zone.cast("long").alias("zone"), half.alias("half"))


q._add("utm_from_epsg", _codes, "SELECT c_custkey AS id, CAST(CASE WHEN c BETWEEN 32601 AND 32660 OR c BETWEEN 32701 AND 32760 THEN c % 100 END AS BIGINT) AS zone, CASE WHEN c BETWEEN 32601 AND 32660 THEN 'N' WHEN c BETWEEN 32701 AND 32760 THEN 'S' END AS half FROM (SELECT c_custkey, 32590 + c_custkey % 180 AS c FROM customer)")
q._add("local_plane", lambda k, d: q._rounded(q.event_cloud(k, d).select("pid", *q._named(geo.local_plane(F.col("x"), F.col("y"), (100.0, 50.0), 30.0, 0.9996, (1000.0, 2000.0)), "e n")), 5), "SELECT pid, round(1000+0.9996::DOUBLE*(cos(radians(30))*(x-100)-sin(radians(30))*(y-50)),5) AS e, round(2000+0.9996::DOUBLE*(sin(radians(30))*(x-100)+cos(radians(30))*(y-50)),5) AS n FROM EV")
q._add("precision", lambda k, d: q._rounded(survey.precision(q._residuals(k, d).select(*[F.col(f"d{a}").alias(a) for a in "xyz"]), 1.96, (0.02, 0.03, 0.04))), f"WITH {q._RES}, Z AS (SELECT stddev_samp(dx) AS sx, stddev_samp(dy) AS sy, stddev_samp(dz) AS sz, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz, count(*) AS n FROM D) SELECT round(sx,6) AS std_x, round(sy,6) AS std_y, round(sz,6) AS std_z, round(mx,6) AS mean_x, round(my,6) AS mean_y, round(mz,6) AS mean_z, n, round(1.96::DOUBLE*sx/sqrt(n),6) AS margin_x, round(1.96::DOUBLE*sy/sqrt(n),6) AS margin_y, round(1.96::DOUBLE*sz/sqrt(n),6) AS margin_z, sx<=0.02 AND sy<=0.03 AND sz<=0.04 AS within FROM Z")
q._add("registration_quality", lambda k, d: q._rounded(survey.registration_quality(q._residuals(k, d).select(F.abs("dz").alias("distance")), 0.1)), f"WITH {q._RES} SELECT round(count(*) FILTER (abs(dz)<=0.1)/count(*),6) AS fitness, round(sqrt(avg(dz*dz)),6) AS rmse, round(avg(abs(dz)),6) AS mean, round(max(abs(dz)),6) AS worst FROM D")
q._add("completeness_of_grids", lambda k, d: q._rounded(survey.completeness_of_grids(q._cells(k, d, "click"), q._cells(k, d, "view"))), "WITH a AS (SELECT DISTINCT floor(y/10) AS r, floor(x/24) AS c, 1 AS hit FROM EV WHERE event_type='click'), b AS (SELECT DISTINCT floor(y/10) AS r, floor(x/24) AS c FROM EV WHERE event_type='view') SELECT count(hit) AS covered, count(*) AS cells, round(count(hit)/count(*),6) AS completeness FROM b LEFT JOIN a ON a.r=b.r AND a.c=b.c")


def _areas(k: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    lat, lon = (i * 7 % 120 - 60).cast("double"), (i * 13 % 340 - 170).cast("double")
    at = [(lat, lon), (lat, lon + 3 + i % 5), (lat + 2 + i % 3, lon + 2 + i % 5), (lat + 1, lon + 0.5)]
    corners = F.array(*[F.struct(F.lit(n).cast("long").alias("seq"), a.alias("lat"), o.alias("lon")) for n, (a, o) in enumerate(at)])
    rings = q._table(k, d, "customer").select(i.alias("polygon"), F.explode(corners).alias("c")).select("polygon", "c.*")
    return geo.polygon_areas(rings).select(F.col("polygon").alias("id"), F.round(F.col("area") / 1e6, 3).alias("square_km"))


_A, _e2 = f"{geo.AXIS}::DOUBLE", f"{geo._E2!r}::DOUBLE"
_RINGS = """R0 AS (SELECT c_custkey AS id, (c_custkey*7 % 120 - 60)::DOUBLE AS lat, (c_custkey*13 % 340 - 170)::DOUBLE AS lon, c_custkey % 5 AS f, c_custkey % 3 AS g FROM customer),
R1 AS (SELECT id, k, list_extract([lat, lat, lat+2+g, lat+1], k) AS lat, list_extract([lon, lon+3+f, lon+2+f, lon+0.5::DOUBLE], k) AS lon FROM R0, (SELECT unnest([1,2,3,4]) AS k)),
R2 AS (SELECT a.id * 4 + a.k AS id, a.lat AS la, b.lat AS lb, radians(b.lon - a.lon) AS w FROM R1 a JOIN R1 b ON a.id = b.id AND b.k = a.k % 4 + 1)"""
_NODES = ", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in zip(geo.NODES.tolist(), geo.WEIGHTS.tolist(), strict=True))
q._add("geodesic_areas", _areas, f"""WITH {_RINGS}, T0 AS (SELECT id, atan((1-{_f}::DOUBLE)*tan(radians(la))) AS u0, atan((1-{_f}::DOUBLE)*tan(radians(lb))) AS u1, w, w AS t FROM R2), {_TURNS},
GA AS (SELECT id, u0, u1, t, {_SPHERE} FROM T8), GB AS (SELECT *, cos(u0)*cos(u1)*sin(t)/si AS al, atan2(si,co) AS sg FROM GA), GN(x, wt) AS (VALUES {_NODES}),
GC AS (SELECT id, al, sg, wt, (sin((1-x)/2*sg)*sin(u0)+sin((1+x)/2*sg)*sin(u1))/si AS zz FROM GB, GN),
GD AS (SELECT *, 1-zz*zz AS fl, sqrt(1-{_e2}*(1-zz*zz)) AS rr FROM GC), GE AS (SELECT *, zz/rr AS ss FROM GD),
GF AS (SELECT id, sum(wt/2*({_A}*{_A}*(1-{_e2})/2*(ss/(1-{_e2}*ss*ss)+atanh(sqrt({_e2})*ss)/sqrt({_e2}))*rr-{geo.AUTHALIC!r}::DOUBLE*zz)/fl*al*sg) AS more FROM GE GROUP BY id),
GG AS (SELECT id, {geo.AUTHALIC!r}::DOUBLE*2*atan2(tan(t/2)*(tan(u0/2)+tan(u1/2)), 1+tan(u0/2)*tan(u1/2)) + more AS s FROM GB JOIN GF USING (id))
SELECT (id - 1) // 4 AS id, round(abs(sum(s))/1e6, 3) AS square_km FROM GG GROUP BY 1""")
