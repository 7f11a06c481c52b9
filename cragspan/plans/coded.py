"""Registered queries on figures of coded points, features and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.operators import figures
from cragspan.plans import queries as q
from cragspan.sources import catalogs

_CODE = "CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'tree' WHEN event_id % 11 = 0 THEN event_type || '.' || (user_id % 3) || '.Q' WHEN event_id % 5 < 2 THEN event_type ELSE event_type || '.' || (user_id % 3) || {c} END"
_COMMAND = "CASE event_id * 7919 % 7 WHEN 0 THEN '.S' WHEN 1 THEN '.S' WHEN 2 THEN '.E' WHEN 3 THEN '.x' ELSE '' END"


def coded(k: SparkSession, d: str) -> DataFrame:
    cloud = q.event_cloud(k, d).select("pid", "x", "y", "z")
    code = F.expr(_CODE.format(c=_COMMAND))
    points = q._table(k, d, "events").select((F.col("user_id") % 4).cast("long").alias("survey"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), code.alias("code"))
    return points.join(cloud, points.ord == cloud.pid).select("survey", "ord", "id", "x", "y", "z", "code")


def _definitions(k: SparkSession) -> DataFrame:
    rows = [("CLICK", "Edge", "line", "edge", "terrain", "L1", False), ("VIEW", "Plot", "polygon", "plot", "cadastre", "L2", True), ("TREE", "Tree", "point", "tree", "vegetation", "L3", False), ("SIGNUP", "Shot", "ground", None, "terrain", "L4", False), ("ERROR", "Ring", "polygon", "ring", "terrain", "L5", False)]
    return k.createDataFrame(rows, "code string, name string, geometry_type string, feature_type string, category string, layer string, closed boolean")


_POINTS = f"""PT AS (SELECT CAST(user_id % 4 AS BIGINT) AS survey, event_id AS ord, {_CODE.format(c=_COMMAND)} AS code FROM events),
PK AS (SELECT *, string_split(trim(code), '.') AS part FROM PT),
PC AS (SELECT survey, ord, code, CASE WHEN code IS NULL THEN 'none' WHEN len(part) = 1 THEN 'plain' WHEN len(part) = 2 OR upper(part[3]) IN ('S','C','E','X') THEN 'figure' ELSE 'malformed' END AS kind, upper(part[1]) AS b, part[2] AS f, CASE WHEN len(part) = 2 THEN 'C' ELSE upper(part[3]) END AS c FROM PK),
PL AS (SELECT *, max(CASE WHEN fresh THEN ord END) OVER (PARTITION BY survey ORDER BY ord) AS shape FROM (SELECT *, CASE WHEN kind = 'plain' THEN (lag(CASE WHEN kind = 'plain' THEN b END) OVER (PARTITION BY survey ORDER BY ord)) IS DISTINCT FROM b ELSE true END AS fresh FROM PC)),
PF AS (SELECT *, coalesce(last_value(CASE WHEN c <> 'C' THEN c END IGNORE NULLS) OVER (PARTITION BY survey, b, f ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'E') = 'S' AS was FROM PC WHERE kind = 'figure'),
PG AS (SELECT *, CASE WHEN was AND c = 'S' THEN 'duplicate_start' WHEN NOT was AND c = 'C' THEN 'continue_without_start' WHEN NOT was AND c IN ('E','X') THEN 'end_without_start' END AS reason, max(CASE WHEN c = 'S' AND NOT was THEN ord END) OVER (PARTITION BY survey, b, f ORDER BY ord) AS sh FROM PF),
PH AS (SELECT *, max(CASE WHEN c IN ('E','X') AND was THEN c END) OVER (PARTITION BY survey, b, f, CASE WHEN reason IS NULL THEN sh END) AS fin FROM PG),
AS_ AS (SELECT survey, ord, code, b, NULL AS f, shape, false AS closed, NULL AS reason FROM PL WHERE kind = 'plain'
 UNION ALL SELECT survey, ord, code, b, f, CASE WHEN reason IS NULL AND fin IS NOT NULL THEN sh END, reason IS NULL AND coalesce(fin, '') = 'X', CASE WHEN reason IS NULL AND fin IS NULL THEN 'unclosed_figure' ELSE reason END FROM PH
 UNION ALL SELECT survey, ord, code, NULL, NULL, NULL, false, CASE WHEN kind = 'none' THEN 'missing_code' ELSE 'malformed_code' END FROM PC WHERE kind IN ('none', 'malformed'))"""
q._add("survey_figures", lambda k, d: figures.assemble(coded(k, d)).select("survey", "ord", "shape", "closed", "reason"), f"WITH {_POINTS} SELECT survey, ord, shape, closed, reason FROM AS_")

_BUILT = f"""{_POINTS}, DEF(base, geom, always) AS (VALUES ('CLICK','line',false),('VIEW','polygon',true),('TREE','point',false),('SIGNUP','ground',false),('ERROR','polygon',false)),
SHP AS (SELECT survey, b, f, shape, count(*) AS n, max(ord) AS fin, bool_or(closed) AS closed, arg_min(x, ord) AS fx, arg_max(x, ord) AS lx, arg_min(y, ord) AS fy, arg_max(y, ord) AS ly, min(z) AS z0, max(z) AS z1 FROM AS_ JOIN EV ON pid = ord WHERE shape IS NOT NULL GROUP BY 1, 2, 3, 4),
JD AS (SELECT *, CASE WHEN geom IS NULL THEN 'unregistered_code' WHEN (geom = 'line' AND n < 2) OR (geom = 'polygon' AND n < 3) THEN 'insufficient_points' END AS reason FROM SHP LEFT JOIN DEF ON base = b)"""
_FEATURES = f"""WITH {_BUILT}, FT AS (SELECT survey, fin, b AS code, CASE geom WHEN 'line' THEN 'polyline' ELSE 'polygon' END AS geometry_type, n, closed OR always OR sqrt((fx-lx)**2+(fy-ly)**2) <= 5 AS closed, z0, z1 FROM JD WHERE reason IS NULL AND geom IN ('line', 'polygon')
 UNION ALL SELECT survey, ord, b, 'point', 1, false, z, z FROM AS_ JOIN EV ON pid = ord WHERE b = 'TREE' AND shape IS NOT NULL)
SELECT survey, row_number() OVER (PARTITION BY survey ORDER BY fin, code) AS feature_id, code, geometry_type, n AS vertices, closed, round(z0, 6) AS min_z, round(z1, 6) AS max_z FROM FT"""


def _built(k: SparkSession, d: str, grammar: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    return figures.build(coded(k, d), _definitions(k), 5.0, grammar)


def _features(k: SparkSession, d: str) -> DataFrame:
    found = figures.bounds(_built(k, d)[0])
    return q._rounded(found.select("survey", "feature_id", "code", "geometry_type", F.size("vertices").cast("long").alias("vertices"), "closed", "min_z", "max_z"))


q._add("survey_features", _features, _FEATURES)
q._add("survey_ground", lambda k, d: _built(k, d)[1].select("survey", "ord"), f"WITH {_BUILT} SELECT AS_.survey, ord FROM AS_ WHERE b = 'SIGNUP' AND shape IS NOT NULL")
q._add("survey_diagnostics", lambda k, d: _built(k, d)[2], f"""WITH {_BUILT} SELECT survey, b AS code, reason, n AS points, shape AS first FROM JD WHERE reason IS NOT NULL
UNION ALL SELECT survey, CASE WHEN b IS NULL THEN code ELSE b || '.' || f END, reason, 1, ord FROM AS_ WHERE reason IS NOT NULL AND reason <> 'unclosed_figure'
UNION ALL SELECT survey, b || '.' || f, reason, count(*), min(ord) FROM AS_ WHERE reason = 'unclosed_figure' GROUP BY 1, 2, 3""")
q._add("survey_features_by_runs", lambda k, d: _built(k, d, False)[0].groupBy("code", "geometry_type", "closed").agg(F.count("*").alias("features"), F.sum(F.size("vertices")).cast("long").alias("vertices")), """WITH PT AS (SELECT CAST(user_id % 4 AS BIGINT) AS survey, event_id AS ord, upper(string_split(""" + _CODE.format(c=_COMMAND) + """, '.')[1]) AS b FROM events),
RN AS (SELECT *, max(CASE WHEN fresh THEN ord END) OVER (PARTITION BY survey ORDER BY ord) AS shape FROM (SELECT *, b IS NULL OR (lag(b) OVER (PARTITION BY survey ORDER BY ord)) IS DISTINCT FROM b AS fresh FROM PT)),
SH AS (SELECT survey, b, shape, count(*) AS n, arg_min(x, ord) AS fx, arg_max(x, ord) AS lx, arg_min(y, ord) AS fy, arg_max(y, ord) AS ly FROM RN JOIN EV ON pid = ord WHERE b IS NOT NULL GROUP BY 1, 2, 3),
FT AS (SELECT b AS code, CASE b WHEN 'CLICK' THEN 'polyline' ELSE 'polygon' END AS geometry_type, b = 'VIEW' OR sqrt((fx-lx)**2+(fy-ly)**2) <= 5 AS closed, n FROM SH WHERE (b = 'CLICK' AND n >= 2) OR (b IN ('VIEW', 'ERROR') AND n >= 3) UNION ALL SELECT b, 'point', false, 1 FROM RN WHERE b = 'TREE')
SELECT code, geometry_type, closed, count(*) AS features, CAST(sum(n) AS BIGINT) AS vertices FROM FT GROUP BY 1, 2, 3""")
q._add("feature_collection_bounds", lambda k, d: q._rounded(figures.collection_bounds(_built(k, d)[0])), f"WITH {_BUILT}, VX AS (SELECT x, y, z FROM JD JOIN AS_ ON JD.survey = AS_.survey AND JD.b = AS_.b AND JD.f IS NOT DISTINCT FROM AS_.f AND JD.shape = AS_.shape JOIN EV ON pid = ord WHERE JD.reason IS NULL AND geom <> 'ground') SELECT round(min(x),6) AS min_x, round(max(x),6) AS max_x, round(min(y),6) AS min_y, round(max(y),6) AS max_y, round(min(z),6) AS min_z, round(max(z),6) AS max_z FROM VX")


def _entries(k: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = {"code": F.concat(F.lit("C"), (p % 150).cast("string")), "name": F.col("p_name"), "geometry_type": F.element_at(F.array(*map(F.lit, ["point", "symbol", "line", "polygon", "ground", "blob"])), (p % 6 + 1).cast("int")), "feature_type": F.when(p % 6 != 4, F.concat(F.lit("t"), (p % 9).cast("string"))), "category": F.when(p % 31 != 0, F.concat(F.lit("k"), (p % 5).cast("string"))), "layer": F.when(p % 13 == 0, F.lit(" ")).otherwise(F.col("p_brand"))}
    rest = {"closed": F.when(p % 17 != 0, p % 4 == 3), "aliases": F.array(F.concat(F.lit("A"), (p % 97).cast("string")))}
    return q._table(k, d, "part").select(*[v.alias(c) for c, v in (text | rest).items()])


_ENTRY = "EN AS (SELECT 'C' || (p_partkey % 150) AS code, p_name AS name, ['point','symbol','line','polygon','ground','blob'][p_partkey % 6 + 1] AS geom, CASE WHEN p_partkey % 6 <> 4 THEN 't' || (p_partkey % 9) END AS ft, CASE WHEN p_partkey % 31 <> 0 THEN 'k' || (p_partkey % 5) END AS cat, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_brand END AS layer, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 4 = 3 END AS closed, 'A' || (p_partkey % 97) AS alias FROM part)"
_ALLOWED = {"t1": ["point", "symbol"], "t2": ["line", "polygon"]}
_FAULT = "(ft = 't1' AND geom NOT IN ('point','symbol')) OR (ft = 't2' AND geom NOT IN ('line','polygon'))"
q._add("catalog_issues", lambda k, d: catalogs.checked(_entries(k, d), allowed=_ALLOWED).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("entries")), f"WITH {_ENTRY} SELECT issue, count(*) AS entries FROM (SELECT unnest([CASE WHEN cat IS NULL THEN 'missing_category' END, CASE WHEN geom = 'blob' THEN 'geometry_type' END, CASE WHEN closed IS NULL THEN 'closed' END, CASE WHEN (geom = 'ground') <> (ft IS NULL) THEN 'feature_type' END, CASE WHEN {_FAULT} THEN 'geometry' END]) AS issue FROM EN) WHERE issue IS NOT NULL GROUP BY 1")
q._add("catalog_audit", lambda k, d: catalogs.audit(_entries(k, d), _ALLOWED), f"""WITH {_ENTRY} SELECT code AS subject, 'duplicate_code' AS kind FROM EN GROUP BY 1 HAVING count(DISTINCT (name, geom, ft, cat, layer, closed, alias)) > 1
UNION ALL SELECT alias, 'duplicate_alias' FROM EN GROUP BY 1 HAVING count(DISTINCT code) > 1 UNION ALL SELECT code, 'empty_layer' FROM EN WHERE trim(layer) = '' UNION ALL SELECT code, 'invalid_closed' FROM EN WHERE closed AND geom <> 'polygon'
UNION ALL SELECT ft, 'inconsistent_category' FROM EN WHERE ft IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cat) > 1 UNION ALL SELECT code, 'geometry' FROM EN WHERE geom = 'blob' OR ((geom = 'ground') <> (ft IS NULL)) OR {_FAULT}""")
q._add("catalog_counts", lambda k, d: catalogs.audit_counts(_entries(k, d)), f"WITH {_ENTRY} SELECT counted, value, count(*) AS codes FROM (SELECT unnest(['category','geometry_type','feature_type']) AS counted, unnest([cat, geom, ft]) AS value FROM EN) WHERE value IS NOT NULL GROUP BY 1, 2")
