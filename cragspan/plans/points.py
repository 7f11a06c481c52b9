"""Registered queries on samples, adaptive neighbourhoods, ground, segments and classes of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.operators import classify, features, ground, sampling, segments, shape
from cragspan.operators.cloud import grid_ground
from cragspan.plans import queries as q

QUERIES = q.QUERIES


def _far(k: SparkSession, d: str) -> DataFrame:
    """The vectors' cloud, nine times as wide."""
    return q.vector_cloud(k, d).select("pid", *[(F.col(a) * 9).alias(a) for a in "xyz"], "label")


_EM9 = "EM9 AS (SELECT pid, x*9 AS x, y*9 AS y, z*9 AS z, label FROM EM )"
_KNN9 = q._KNN.replace("EM a, EM b", "EM9 a, EM9 b")
_CELL = "CAST(floor(x/24) AS BIGINT) AS vx, CAST(floor(y/24) AS BIGINT) AS vy"
q._add("voxel_all", lambda k, d: sampling.voxel_all(q.event_cloud(k, d), 24.0).select("pid", "vx", "vy", "vz"), f"SELECT pid, {q._VOX} FROM EV")
q._add("stratified_centroid", lambda k, d: sampling.stratified_centroid(q.event_cloud(k, d), 24.0), f"WITH c AS (SELECT *, {_CELL} FROM EV ), m AS (SELECT vx, vy, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY 1, 2) SELECT vx, vy, pid FROM (SELECT c.vx, c.vy, pid, row_number() OVER (PARTITION BY c.vx, c.vy ORDER BY (x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz), pid) AS k FROM c JOIN m USING (vx, vy)) WHERE k = 1")
QUERIES["stratified_random"] = lambda k, d: sampling.stratified_random(q.event_cloud(k, d), 24.0, 2, 3)
_DENS = f"DN AS (SELECT a.pid, count(*) / (4.0/3.0*3.141592653589793::DOUBLE*1000) AS dens FROM EV a, EV b WHERE {q._PAIR} <= 100 GROUP BY 1)"
q._add("adaptive_k", lambda k, d: sampling.adaptive_k(q.event_cloud(k, d), 9, 10.0, 2.0), f"WITH {_DENS} SELECT pid, CAST(least(round_even(9*(1+dens/(dens+1)), 0), 128) AS INTEGER) AS k FROM DN")
q._add("adaptive_radius", lambda k, d: q._rounded(sampling.adaptive_radius(q.event_cloud(k, d), 5.0, 10.0, 3.0)), f"WITH {_DENS} SELECT pid, round(5.0::DOUBLE/(1+dens/(dens+1)*2), 6) AS reach FROM DN")
q._add("density_shares", lambda k, d: q._rounded(sampling.local_density(q.event_cloud(k, d), 10.0).select("pid", sampling.keep_share(F.col("density"), 0.0005, 0.1, 1.0).alias("share"))), f"WITH {_DENS} SELECT pid, round(greatest(least(0.0005::DOUBLE/dens, 1), 0.1::DOUBLE), 6) AS share FROM DN")
QUERIES["density_sample"] = lambda k, d: sampling.density_sample(q.event_cloud(k, d), 0.0005, 10.0).select("pid")
q._add("adaptive_eps", lambda k, d: q._rounded(sampling.adaptive_eps(_far(k, d), 0.5, 5)), f"WITH {_EM9}, o AS (SELECT pid, avg(sqrt(d2)) AS own FROM {_KNN9} WHERE k <= 5 GROUP BY 1) SELECT pid, round(0.5::DOUBLE*greatest(least(own/(SELECT avg(own) FROM o), 2.0), 0.5), 6) AS eps FROM o")
q._add("adaptive_knn", lambda k, d: sampling.adaptive_knn(_far(k, d), 3, 0.8, 4.0).select("pid", "rank", "nid"), f"WITH {_EM9}, dn AS (SELECT a.pid, count(*) / (4.0/3.0*3.141592653589793::DOUBLE*0.8::DOUBLE**3) AS dens FROM EM9 a, EM9 b WHERE {q._PAIR} <= 0.8::DOUBLE*0.8 GROUP BY 1), e AS (SELECT pid, CAST(least(round_even(3*(1+dens/(dens+1)*3), 0), 128) AS INTEGER) AS m FROM dn) SELECT n.pid, CAST(n.k AS INTEGER) AS rank, nid FROM {_KNN9} n JOIN e USING (pid) WHERE n.k <= m")
_STEPS = [("band", lambda c: c.where("z between 50 and 400")), ("west", lambda c: c.where("x < 500")), ("north", lambda c: c.where("y > 3"))]
q._add("filter_chain", lambda k, d: sampling.chained(q.event_cloud(k, d), _STEPS)[1], "WITH n AS (SELECT count(*) AS a, count(*) FILTER (z BETWEEN 50 AND 400) AS b, count(*) FILTER (z BETWEEN 50 AND 400 AND x < 500) AS c, count(*) FILTER (z BETWEEN 50 AND 400 AND x < 500 AND y > 3) AS e FROM EV ) SELECT 0 AS step, 'band' AS name, a AS before, b AS after FROM n UNION ALL SELECT 1, 'west', b, c FROM n UNION ALL SELECT 2, 'north', c, e FROM n")
q._add("filter_masks", lambda k, d: sampling.masks(q.event_cloud(k, d), [("band", F.col("z").between(50, 400)), ("west", F.col("x") < 500)]).select("pid", "band", "west"), "SELECT pid, z BETWEEN 50 AND 400 AS band, CASE WHEN z BETWEEN 50 AND 400 THEN x < 500 END AS west FROM EV")

_AXES = q._MOMENTS[q._MOMENTS.index("C1 AS") :]
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
_WEIGHED = f"""KN AS (SELECT pid, nid, d2 FROM {q._KNN.replace("WHERE a.pid <> b.pid", "")} WHERE k <= 10), SG AS (SELECT avg(sqrt(d2))**2 AS s2 FROM KN),
Q AS (SELECT n.pid, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z, CASE WHEN d2 = 0 THEN 1 ELSE exp(-d2/s2) END AS w FROM KN n JOIN EM a ON a.pid = n.pid JOIN EM b ON b.pid = n.nid CROSS JOIN SG),
C AS (SELECT pid, {", ".join(f"(sum(w*{a}*{b})-sum(w*{a})*sum(w*{b})/sum(w))/10 AS {a}{b}" for a, b in _PAIRS)} FROM Q GROUP BY 1), {_AXES}"""
q._add("weighted_curvature", lambda k, d: q._rounded(shape.weighted_normals(q.vector_cloud(k, d), 10).select("pid", "curvature")), f"WITH {_WEIGHED} SELECT pid, round(l3/(l1+l2+l3),6) AS curvature FROM L3")
q._add("normals_at", lambda k, d: q._rounded(shape.normals_at(q.vector_cloud(k, d), q.vector_cloud(k, d).where("pid % 9 = 4"), 10).select("pid", "curvature")), f"WITH {q._MOMENTS} SELECT pid, round(l3/(l1+l2+l3),6) AS curvature FROM L3 WHERE pid % 9 = 4")

_NEAR9 = q._MOMENTS.replace("EM a", "EM9 a").replace("EM b", "EM9 b")
_RULED = f"""{_EM9}, {_NEAR9},
HG AS (SELECT pid, greatest(z - min(z) OVER (PARTITION BY floor(x), floor(y)), 0) AS h FROM EM9),
NB AS (SELECT a.pid, count(*) AS n FROM EM9 a, EM9 b WHERE {q._PAIR} <= 0.8::DOUBLE*0.8 GROUP BY 1),
FE AS (SELECT pid, h, n, (l2-l3)/l1 AS plan, l3/l1 AS sph, (l1-l2)/l1 AS lin, (l1-l3)/l1 AS ani, cbrt(l1*l2*l3) AS omn, l3/(l1+l2+l3) AS cur, 1-sqrt((xx*yy-xy*xy-l3*(xx+yy)+l3*l3)/((l1-l3)*(l2-l3))) AS up FROM L3 JOIN HG USING (pid) JOIN NB USING (pid))"""
q._add("rule_classes", lambda k, d: classify.by_rules(classify.point_features(_far(k, d), 10, 0.8, 1.0, 4)).select("pid", "label"), f"WITH {_RULED} SELECT pid, CASE WHEN n < 4 THEN 18 WHEN h <= 0.2 THEN 2 WHEN plan >= 0.5 AND sph <= 0.3 AND h <= 50 AND (up <= 0.3 OR up >= 0.7) THEN 6 WHEN h >= 0.1 AND cur >= 0.02 AND plan <= 0.6 AND lin <= 0.8 AND sph >= 0.2 AND ani <= 0.8 AND omn >= 0.01 THEN CASE WHEN h <= 0.5 THEN 3 WHEN h >= 2 THEN 5 ELSE 4 END ELSE 1 END AS label FROM FE")
q._add("class_extract", lambda k, d: classify.of_class(classify.by_rules(classify.point_features(_far(k, d), 10, 0.8, 1.0, 4)), 2, 18).select("pid"), f"WITH {_RULED} SELECT pid FROM FE WHERE n < 4 OR h <= 0.2")
_GROUND9 = "GR AS (SELECT pid, x, y, z FROM (SELECT *, min(z) OVER (PARTITION BY floor(x), floor(y)) AS m FROM EM9) WHERE z - m <= 0.2)"
_OVER = f"""{_EM9}, {_GROUND9}, OV AS (SELECT pid, z - gz AS h FROM (SELECT a.pid, a.z, b.z AS gz, row_number() OVER (PARTITION BY a.pid ORDER BY {q._PAIR}, b.pid) AS k FROM EM9 a, GR b) WHERE k = 1)"""
q._add("height_over_ground", lambda k, d: q._rounded(classify.height_over(_far(k, d), grid_ground(_far(k, d), 1.0, 1.0, 0.2)).select("pid", "height_above_ground")), f"WITH {_OVER} SELECT pid, round(h, 6) AS height_above_ground FROM OV")
q._add("height_band", lambda k, d: segments.height_band(_far(k, d), 0.1, 0.6).select("pid"), f"WITH {_OVER} SELECT pid FROM OV WHERE h BETWEEN 0.1 AND 0.6")
_SLOPE = f"""{_EM9}, SN AS (SELECT p.pid, atan(greatest(sqrt(avg(abs(b.x-a.x))**2+avg(abs(b.y-a.y))**2), 2.0::DOUBLE**-52)) AS slope FROM {_KNN9.replace("WHERE a.pid <> b.pid", "")} p JOIN EM9 a ON a.pid = p.pid JOIN EM9 b ON b.pid = p.nid WHERE k <= 10 GROUP BY 1)"""
q._add("neighbour_slope", lambda k, d: q._rounded(ground.neighbour_slope(_far(k, d))), f"WITH {_SLOPE} SELECT pid, round(slope, 6) AS slope FROM SN")
_THIN = "(0.2::DOUBLE*(1+2*least(slope/radians(30), 1)))"
_JUDGED = "z-m <= {t} OR (slope > radians(15) AND z-m <= 2*{t})".format(t=_THIN)
q._add("adaptive_ground", lambda k, d: ground.adaptive_ground(_far(k, d), 0.5, 2.0).select("pid"), f"""WITH {_SLOPE}, A0 AS (SELECT EM9.*, slope, min(z) OVER w AS m, max(z) OVER w - min(z) OVER w + avg(slope) OVER w AS complexity FROM EM9 JOIN SN USING (pid) WINDOW w AS (PARTITION BY floor(x/2), floor(y/2))),
B0 AS (SELECT quantile_cont(complexity, 0.8) AS bound FROM A0), C0 AS (SELECT pid, z, slope, min(z) OVER (PARTITION BY floor(x/0.5), floor(y/0.5)) AS m FROM A0, B0 WHERE complexity > bound)
SELECT pid FROM A0, B0 WHERE complexity <= bound AND ({_JUDGED}) UNION ALL SELECT pid FROM C0 WHERE {_JUDGED}""")


def _labels(k: SparkSession, d: str) -> DataFrame:
    return _far(k, d).select("pid", F.when(F.col("label") % 3 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("segment"))


q._add("noise_fill", lambda k, d: segments.fill_noise(_far(k, d), _labels(k, d)), f"WITH {_EM9}, lb AS (SELECT *, CASE WHEN label % 3 = 0 THEN -1 ELSE label END AS seg FROM EM9) SELECT pid, CAST(seg AS BIGINT) AS segment FROM lb WHERE seg >= 0 UNION ALL SELECT pid, seg FROM (SELECT a.pid, CAST(b.seg AS BIGINT) AS seg, row_number() OVER (PARTITION BY a.pid ORDER BY {q._PAIR}, b.pid) AS k FROM lb a, lb b WHERE a.seg < 0 AND b.seg >= 0) WHERE k = 1")
q._add("segment_extract", lambda k, d: segments.segment(_far(k, d), _labels(k, d), 4).select("pid"), "SELECT pid FROM EM WHERE label = 4")
QUERIES["region_growing"] = lambda k, d: segments.region_growing(_far(k, d), 10, 0.2, 40.0, 3)
QUERIES["tree_segments"] = lambda k, d: segments.trees(_far(k, d), 0.05, 50.0, 0.8, 3, 3)
QUERIES["building_segments"] = lambda k, d: segments.buildings(_far(k, d), 0.05, 100.0, 10, 0.2, 40.0, 3)


def _learned(k: SparkSession, d: str, boosted: bool) -> DataFrame:
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", 0), ("view", 1), ("error", 2)) for x in kv]), F.col("event_type"))
    every = q.event_cloud(k, d).withColumn("label", kinds)
    points = every.where("label is not null and pid % 5 <> 0")  # a fifth of the labelled points is held out
    fit = classify.gradient_boost(points, list("xyz"), rounds=5, depth=3) if boosted else classify.random_forest(points, list("xyz"), trees=20, depth=5)
    return classify.predict(every.drop("label"), fit).select("pid", "predicted")


QUERIES["random_forest"] = lambda k, d: _learned(k, d, False)
QUERIES["gradient_boost"] = lambda k, d: _learned(k, d, True)
_HULL = """ED AS (SELECT a.label, a.pid AS p, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, count(*) FILTER ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < 0) AS beyond FROM EM9 a JOIN EM9 b ON a.label = b.label AND a.pid <> b.pid JOIN EM9 c ON c.label = a.label AND c.pid <> a.pid AND c.pid <> b.pid GROUP BY ALL)"""
q._add("footprints", lambda k, d: q._rounded(features.footprints(_far(k, d), "label").select("segment", F.size("corners").cast("long").alias("corners"), "area"), 5), f"WITH {_EM9}, {_HULL} SELECT CAST(label AS BIGINT) AS segment, count(*) AS corners, round(sum(ax*by_-ay*bx)/2,5) AS area FROM ED WHERE beyond = 0 GROUP BY 1")
