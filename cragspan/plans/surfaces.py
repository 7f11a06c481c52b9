"""Registered queries on ground, registration and distances to meshes, added to those of ``features``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.operators import ground, meshes, registration
from cragspan.plans import queries as q
from cragspan.plans.features import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

_WIDTHS = ground.window_sizes(9)
_LIMITS = [min(120.0, 10.0 + 24.0 * (w // 2 - b // 2)) for w, b in zip(_WIDTHS, [0, *_WIDTHS], strict=False)]


def _opened(k: int, width: int, limit: float) -> str:
    """SQL of one opening: least values by row and by column, then greatest, then the cells that it lowers too far."""
    parts, at = [], f"W{k}"
    for step, (f, part, order) in enumerate((f, p, o) for f in ("min", "max") for p, o in (('"row"', "col"), ("col", '"row"'))):
        parts.append(f'W{k}_{step} AS (SELECT "row", col, terrain, ground, {f}({"z" if step else "terrain"}) OVER (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN {width // 2} PRECEDING AND {width // 2} FOLLOWING) AS z FROM {at})')
        at = f"W{k}_{step}"
    return ", ".join(parts) + f', W{k + 1} AS (SELECT "row", col, CASE WHEN ground AND terrain - z <= {limit}::DOUBLE THEN terrain ELSE z END AS terrain, ground AND terrain - z <= {limit}::DOUBLE AS ground FROM {at})'


_CELLS = f"""P AS (SELECT pid, z, CAST(floor((y - (SELECT min(y) FROM EV )) / 24) AS BIGINT) AS "row", CAST(floor((x - (SELECT min(x) FROM EV )) / 24) AS BIGINT) AS col FROM EV ),
L AS (SELECT "row", col, min(z) AS z FROM P GROUP BY 1, 2),
D AS (SELECT r.range AS "row", k.range AS col FROM range((SELECT max("row") + 1 FROM P)) r CROSS JOIN range((SELECT max(col) + 1 FROM P)) k),
H AS (SELECT D."row", D.col, L.z, row_number() OVER (PARTITION BY D."row", D.col ORDER BY (D."row"-L."row")**2 + (D.col-L.col)**2, L."row", L.col) AS k, D."row" = L."row" AND D.col = L.col AS occupied FROM D CROSS JOIN L),
W0 AS (SELECT "row", col, z AS terrain, occupied AS ground FROM H WHERE k = 1), {", ".join(_opened(k, w, v) for k, (w, v) in enumerate(zip(_WIDTHS, _LIMITS, strict=True)))}"""
q._add("morphological_ground", lambda k, d: ground.morphological_ground(q.event_cloud(k, d), 24.0, 10.0, 120.0, 1.0, _WIDTHS).select("pid"), f'WITH {_CELLS} SELECT pid FROM P JOIN W{len(_WIDTHS)} USING ("row", col) WHERE ground AND z - terrain <= 120')


def _scaled(k: SparkSession, d: str) -> DataFrame:
    return q.event_cloud(k, d).select("pid", (F.col("x") / 40).alias("x"), (F.col("y") / 9).alias("y"), (F.col("z") / 100).alias("z"))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{x}*{b}{x}" for x in "xyz") + ")"


def _off(name: str, to: str, of: str) -> str:
    return ", ".join(f"{x}{to}-{x}{of} AS {name}{x}" for x in "xyz")


_EDGES = [("u", "w"), ("e", "h"), ("f", "w")]  # of corners 0 1, 1 2 and 0 2, each with the vector from its start to the point
_NEAREST = f"""B AS (SELECT pid, x/40 AS xp, y/9 AS yp, z/100 AS zp FROM EV ),
C AS (SELECT pid, {_off("u", "1", "0")}, {_off("f", "2", "0")}, {_off("e", "2", "1")}, {_off("w", "p", "0")}, {_off("h", "p", "1")} FROM B CROSS JOIN FACE ),
K AS (SELECT *, uy*fz-uz*fy AS nx, uz*fx-ux*fz AS ny, ux*fy-uy*fx AS nz FROM C),
M AS (SELECT *, {_dot("n", "n")} AS size, ((uy*wz-uz*wy)*nx+(uz*wx-ux*wz)*ny+(ux*wy-uy*wx)*nz)/{_dot("n", "n")} AS third, ((wy*fz-wz*fy)*nx+(wz*fx-wx*fz)*ny+(wx*fy-wy*fx)*nz)/{_dot("n", "n")} AS second,
 {", ".join(f"greatest(0, least(1, {_dot(w, u)}/{_dot(u, u)})) AS t{u}" for u, w in _EDGES)} FROM K),
X AS (SELECT pid, sqrt(min(CASE WHEN second >= 0 AND third >= 0 AND second+third <= 1 THEN {_dot("w", "n")}*{_dot("w", "n")}/size ELSE least({", ".join("+".join(f"({w}{x}-t{u}*{u}{x})**2" for x in "xyz") for u, w in _EDGES)}) END)) AS distance FROM M GROUP BY 1)"""
q._add("cloud_to_mesh", lambda k, d: q._rounded(meshes.cloud_to_mesh(_scaled(k, d), q._faces(k, d))), f"WITH {_NEAREST} SELECT pid, round(distance,6) AS distance FROM X")
q._add("cloud_to_mesh_summary", lambda k, d: q._rounded(meshes.mesh_distance_summary(meshes.cloud_to_mesh(_scaled(k, d), q._faces(k, d), 0.5))), f"WITH {_NEAREST} SELECT round(avg(distance),6) AS mean, round(stddev_samp(distance),6) AS std, round(max(distance),6) AS max, round(sqrt(avg(distance*distance)),6) AS rmse, count(*) AS n FROM X WHERE distance <= 0.5")


def _registered(k: SparkSession, d: str, plane: bool) -> DataFrame:
    """The motion found for a copy of the vectors' cloud that was turned by 0.05 about z and shifted."""
    cloud = q.vector_cloud(k, d).select("pid", *[(F.col(a) * 9).alias(a) for a in "xyz"])
    source = registration.moved(cloud, registration.turned(np.array([0.0, 0.0, 0.05])), np.array([0.02, -0.01, 0.03]))
    got = registration.register(source, cloud, plane, rounds=15)
    cells = [(f"r{i}{j}", float(got.rotation[i, j])) for i in range(3) for j in range(3)] + [(f"t{i}", float(got.shift[i])) for i in range(3)]
    return q._rounded(k.createDataFrame([*cells, ("rmse", got.rmse), ("fitness", got.fitness)], "name string, value double"), 4)


q._add("register_points", lambda k, d: _registered(k, d, False))
q._add("register_planes", lambda k, d: _registered(k, d, True))
