"""Registered queries on triangulations, with SQL that finds the triangles by trying all corners over all edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.operators import constrained, features, ground, triangulate
from cragspan.plans import queries as q
from cragspan.plans.features import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]


def _places(k: SparkSession, d: str) -> DataFrame:
    """The vectors' first three components, one for each place in the plane."""
    return q.vector_cloud(k, d).select("pid", "x", "y", "z")


def _vertices(k: SparkSession, d: str) -> DataFrame:
    return _places(k, d).withColumnRenamed("pid", "vid")


def _surface(k: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _vertices(k, d)
    return v, triangulate.delaunay(v)


_P = "SELECT vid, x, y, z FROM (SELECT pid AS vid, x, y, z, row_number() OVER (PARTITION BY x, y ORDER BY pid) AS k FROM EM ) WHERE k = 1"


def _triangles(name: str, points: str, hidden: str | None = None) -> str:
    """SQL of CTEs ``name``(v0, v1, v2): over each directed edge the corner whose circle bulges least; three edges that agree are a triangle.
    ``hidden``: a CTE of pairs (a, b) that don't see each other."""
    sees = f" AND NOT EXISTS (SELECT 1 FROM {hidden} h WHERE h.a = least(a.vid, b.vid) AND h.b = greatest(a.vid, b.vid)) AND NOT EXISTS (SELECT 1 FROM {hidden} h WHERE h.a = least(a.vid, c.vid) AND h.b = greatest(a.vid, c.vid)) AND NOT EXISTS (SELECT 1 FROM {hidden} h WHERE h.a = least(b.vid, c.vid) AND h.b = greatest(b.vid, c.vid))" if hidden else ""
    return f"""L{name} AS MATERIALIZED (SELECT a.vid AS a, b.vid AS b, arg_min(c.vid, ((a.x-c.x)*(b.x-c.x)+(a.y-c.y)*(b.y-c.y)) / ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))) AS c
 FROM {points} a, {points} b, {points} c WHERE a.vid <> b.vid AND (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) > 0{sees} GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT l.a AS v0, l.b AS v1, l.c AS v2 FROM L{name} l JOIN L{name} m ON m.a = l.b AND m.b = l.c AND m.c = l.a JOIN L{name} n ON n.a = l.c AND n.b = l.a AND n.c = l.b WHERE l.a < l.b AND l.a < l.c)"""


q._add("delaunay", lambda k, d: _surface(k, d)[1].select("v0", "v1", "v2"), f"WITH PP AS MATERIALIZED ({_P}), {_triangles('DT', 'PP')} SELECT v0, v1, v2 FROM DT")
QUERIES["delaunay_events"] = lambda k, d: triangulate.delaunay(q.event_cloud(k, d).withColumnRenamed("pid", "vid")).select("v0", "v1", "v2")


def _spikeless(k: SparkSession, d: str) -> DataFrame:
    v, t = _surface(k, d)
    places = v.groupBy("x", "y").agg(F.min_by(F.struct("vid", "z"), "vid").alias("v")).select("v.vid", "x", "y", "v.z")
    return triangulate.without_spikes(places, t, 0.15)[1].select("v0", "v1", "v2")


_MEANS = "NB AS (SELECT DISTINCT v, u FROM (SELECT unnest([v0,v1,v2,v1,v2,v0]) AS v, unnest([v1,v2,v0,v0,v1,v2]) AS u FROM DT)), SP AS (SELECT v FROM NB JOIN PP p ON p.vid = v JOIN PP u ON u.vid = NB.u GROUP BY v, p.z HAVING abs(p.z - avg(u.z)) > 0.15)"
q._add("spikes_removed", _spikeless, f"WITH PP AS MATERIALIZED ({_P}), {_triangles('DT', 'PP')}, {_MEANS}, P2 AS MATERIALIZED (SELECT * FROM PP WHERE vid NOT IN (SELECT v FROM SP)), {_triangles('DU', 'P2')} SELECT v0, v1, v2 FROM DU")

_ROUNDS = 3


def _grown(k: int) -> str:
    """SQL of a round: the triangulation of G{k} and the points G{k + 1} with those that it takes in."""
    w = [f"((b.x-{a}.x)*(c.y-{a}.y)-(b.y-{a}.y)*(c.x-{a}.x))" for a in "ap"]
    w1 = "((c.x-p.x)*(a.y-p.y)-(c.y-p.y)*(a.x-p.x))"
    w2 = "((a.x-p.x)*(b.y-p.y)-(a.y-p.y)*(b.x-p.x))"
    nz = "((b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y))**2 + ((b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z))**2"
    return f"""{_triangles(f"D{k}", f"G{k}")}, G{k + 1} AS MATERIALIZED (SELECT * FROM G{k} UNION ALL SELECT DISTINCT p.* FROM PP p, D{k} JOIN G{k} a ON a.vid = v0 JOIN G{k} b ON b.vid = v1 JOIN G{k} c ON c.vid = v2
 WHERE p.vid NOT IN (SELECT vid FROM G{k}) AND {w[1]} >= 0 AND {w1} >= 0 AND {w2} >= 0 AND abs(p.z - ({w[1]}*a.z + {w1}*b.z + {w2}*c.z) / {w[0]}) <= 0.15 AND {w[0]} / sqrt({w[0]}**2 + {nz}) >= cos(radians(80)))"""


q._add("triangulated_ground", lambda k, d: ground.triangulated_ground(_places(k, d).groupBy("x", "y").agg(F.min_by(F.struct("pid", "z"), "pid").alias("p")).select("p.pid", "x", "y", "p.z"), 0.1, 0.15, 80.0, _ROUNDS).select("pid"), f"""WITH PP AS MATERIALIZED ({_P}), G0 AS MATERIALIZED (SELECT vid, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x/0.1), floor(y/0.1) ORDER BY z, vid) AS k FROM PP) WHERE k = 1),
{", ".join(map(_grown, range(_ROUNDS)))} SELECT vid AS pid FROM G{_ROUNDS}""")


#: Constraints that can't cross: chains from left to right of every third vertex of a strip.
_STRIP = 0.05


def _constrained(k: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v, t = _surface(k, d)
    strip = Window.partitionBy(F.floor(F.col("y") / _STRIP)).orderBy("x", "y")
    chained = v.groupBy("x", "y").agg(F.min("vid").alias("vid")).where("vid % 3 = 0").select(F.col("vid").alias("a"), F.lead("vid").over(strip).alias("b")).where("b is not null")
    return constrained.constrain(v, t, chained).select("v0", "v1", "v2")


_CHAINS = f"CC AS MATERIALIZED (SELECT p.vid AS a, n.vid AS b, p.x AS ax, p.y AS ay, n.x AS bx, n.y AS by_ FROM (SELECT *, lead(vid) OVER (PARTITION BY floor(y/{_STRIP}) ORDER BY x, y) AS nx FROM PP WHERE vid % 3 = 0) p JOIN PP n ON n.vid = p.nx)"
_HIDE = """HH AS MATERIALIZED (SELECT DISTINCT p.vid AS a, r.vid AS b FROM PP p JOIN PP r ON p.vid < r.vid JOIN CC c ON ((c.bx-c.ax)*(p.y-c.ay)-(c.by_-c.ay)*(p.x-c.ax)) * ((c.bx-c.ax)*(r.y-c.ay)-(c.by_-c.ay)*(r.x-c.ax)) < 0
 AND ((r.x-p.x)*(c.ay-p.y)-(r.y-p.y)*(c.ax-p.x)) * ((r.x-p.x)*(c.by_-p.y)-(r.y-p.y)*(c.bx-p.x)) < 0 WHERE p.vid NOT IN (c.a, c.b) AND r.vid NOT IN (c.a, c.b))"""
q._add("constrained_delaunay", _constrained, f"WITH PP AS MATERIALIZED ({_P}), {_CHAINS}, {_HIDE}, {_triangles('DC', 'PP', 'HH')} SELECT v0, v1, v2 FROM DC")


def _roof_cloud(k: SparkSession, d: str) -> DataFrame:
    at = q._table(k, d, "embeddings")
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    size = F.sqrt(e[4] * e[4] + e[5] * e[5] + 1.0)
    return at.select(F.col("vec_id").alias("pid"), *[(e[i] * 9).alias(a) for i, a in enumerate("xyz")], F.when(F.col("label") % 2 == 0, 6).otherwise(2).alias("classification"), (e[4] / size).alias("nx"), (e[5] / size).alias("ny"), (F.lit(1.0) / size).alias("nz"))


def _roofs(k: SparkSession, d: str) -> DataFrame:
    means = [F.col("attributes")[f"mean_normal_{a}"].cast("double").alias(f"mean_normal_{a}") for a in "xyz"]
    return q._rounded(features.roofs(_roof_cloud(k, d), 0.5, 4.0, 0.8, 3).select("feature_id", "first", F.col("attributes")["point_count"].cast("long").alias("points"), *means))


q._add("roofs", _roofs, """WITH RECURSIVE W AS (SELECT vec_id AS pid, embedding[1]::DOUBLE*9 AS x, embedding[2]::DOUBLE*9 AS y, embedding[5]::DOUBLE AS e4, embedding[6]::DOUBLE AS e5 FROM embeddings WHERE label % 2 = 0),
B AS (SELECT pid, x, y, e4/sqrt(e4*e4+e5*e5+1) AS nx, e5/sqrt(e4*e4+e5*e5+1) AS ny, 1/sqrt(e4*e4+e5*e5+1) AS nz FROM W),
U AS (SELECT * FROM B WHERE nz >= 0.5),
L AS (SELECT a.pid AS a, b.pid AS b FROM U a JOIN U b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.64 AND a.nx*b.nx+a.ny*b.ny+a.nz*b.nz >= cos(radians(4))),
R AS (SELECT pid, pid AS root FROM U UNION SELECT L.b, R.root FROM R JOIN L ON L.a = R.pid WHERE R.root < L.b),
M AS (SELECT pid, min(root) AS root FROM R GROUP BY 1),
S AS (SELECT root AS first, count(*) AS points, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM M JOIN U USING (pid) GROUP BY 1 HAVING count(*) >= 3)
SELECT row_number() OVER (ORDER BY first) AS feature_id, first, points, round(mx/sqrt(mx*mx+my*my+mz*mz),6) AS mean_normal_x, round(my/sqrt(mx*mx+my*my+mz*mz),6) AS mean_normal_y, round(mz,6) AS mean_normal_z FROM S""")


def _detected(k: SparkSession, d: str) -> DataFrame:
    from cragspan.plans.features import _classified

    found = features.detected(_classified(k, d))
    return q._rounded(found.select("feature_type", "feature_id", "first", "category", "geometry_type", "closed", "confidence", F.size("vertices").cast("long").alias("corners"), F.col("vertices")[0]["z"].alias("z"), F.col("attributes")["point_count"].cast("long").alias("points")), 5)


_PLACES = ", ".join(f"('{k}', '{c}', '{g}', {repr(p) if p else 'NULL'})" for k, (c, g, p) in features.GEOMETRY.items())
_CLUSTERS, _KEPT = ORACLE_SQL["detect_features"].split("\nSELECT detector, first, points,")
QUERIES["detected_features"] = _detected
ORACLE_SQL["detected_features"] = f"""{_CLUSTERS},
GG(detector, category, kind, place) AS (VALUES {_PLACES}),
KK AS (SELECT B.*, category, kind, place FROM B JOIN GG USING (detector) {_KEPT[_KEPT.index("WHERE points"):]}),
CP AS (SELECT KK.detector, KK.first, Q.pid, Q.x, Q.y, Q.z FROM KK JOIN M ON M.detector = KK.detector AND M.root = KK.first JOIN Q ON Q.detector = M.detector AND Q.pid = M.pid),
HE AS (SELECT a.detector, a.first, a.pid AS p, b.pid AS r, count(*) FILTER ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < 0) AS beyond FROM CP a JOIN CP b ON a.detector = b.detector AND a.first = b.first AND a.pid <> b.pid JOIN CP c ON c.detector = a.detector AND c.first = a.first AND c.pid <> a.pid AND c.pid <> b.pid GROUP BY ALL),
HC AS (SELECT detector, first, count(*) AS corners FROM HE WHERE beyond = 0 GROUP BY 1, 2),
ZZ AS (SELECT detector, first, quantile_cont(z, 0.5) AS med, min(z) AS low, avg(z) AS mean FROM CP GROUP BY 1, 2)
SELECT detector AS feature_type, row_number() OVER (PARTITION BY detector ORDER BY first) AS feature_id, first, category, kind AS geometry_type, kind = 'polygon' AS closed, 1.0::DOUBLE AS confidence,
 CASE kind WHEN 'polygon' THEN corners ELSE 1 END AS corners, round(CASE WHEN kind = 'polygon' THEN med WHEN place = 'lowest' THEN low ELSE mean END, 5) AS z, points FROM KK JOIN HC USING (detector, first) JOIN ZZ USING (detector, first)"""
