"""Rigid registration by closest points: Spark finds the pairs and sums moments, the driver solves a 3x3 or 6x6 system."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.operators.neighbours import nearest
from cragspan.operators.shape import normals
from cragspan.plans.storage import materialise


@dataclass(frozen=True)
class Registration:
    """``rotation @ p + shift`` takes the source to the target."""

    rotation: np.ndarray
    shift: np.ndarray
    rmse: float
    fitness: float
    rounds: int
    converged: bool


def moved(cloud: DataFrame, rotation: np.ndarray, shift: np.ndarray) -> DataFrame:
    """The cloud after a rigid motion; other columns stay."""
    at = [sum((F.col(a) * float(rotation[i, j]) for j, a in enumerate("xyz")), F.lit(float(shift[i]))) for i in range(3)]
    return cloud.withColumns(dict(zip("xyz", at, strict=True)))


def turned(turn: np.ndarray) -> np.ndarray:
    """The rotation about the axis ``turn`` by its length."""
    angle = float(np.linalg.norm(turn))
    if angle == 0:
        return np.eye(3)
    x, y, z = turn / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _sums(pairs: DataFrame, values: dict[str, Column]) -> dict[str, float]:
    return pairs.agg(*[F.sum(v).alias(n) for n, v in values.items()]).first().asDict()


def point_step(pairs: DataFrame, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The motion that brings the points x, y, z closest to tx, ty, tz, from sixteen sums about ``origin``."""
    s = {a: F.col(a) - float(o) for a, o in zip("xyz", origin, strict=True)}
    t = {a: F.col(f"t{a}") - float(o) for a, o in zip("xyz", origin, strict=True)}
    got = _sums(pairs, {"n": F.lit(1)} | {f"s{a}": s[a] for a in "xyz"} | {f"t{a}": t[a] for a in "xyz"} | {a + b: s[a] * t[b] for a in "xyz" for b in "xyz"})
    mean_s, mean_t = (np.array([got[k + a] for a in "xyz"]) / got["n"] for k in "st")
    spread = np.array([[got[a + b] for b in "xyz"] for a in "xyz"]) - got["n"] * np.outer(mean_s, mean_t)
    u, _, v = np.linalg.svd(spread)
    rotation = v.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T
    return rotation, origin + mean_t - rotation @ (origin + mean_s)


def plane_step(pairs: DataFrame, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The small motion that brings x, y, z closest to the planes through tx, ty, tz with normals nx, ny, nz."""
    s = [F.col(a) - float(o) for a, o in zip("xyz", origin, strict=True)]
    n = [F.col(f"n{a}") for a in "xyz"]
    row = [s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0], *n]
    gap = sum((n[k] * (F.col(f"t{a}") - F.col(a)) for k, a in enumerate("xyz")), F.lit(0.0))
    got = _sums(pairs, {f"m{i}{j}": row[i] * row[j] for i, j in itertools.combinations_with_replacement(range(6), 2)} | {f"r{i}": row[i] * gap for i in range(6)})
    whole = np.array([[got[f"m{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    answer = np.linalg.lstsq(whole, np.array([got[f"r{i}"] for i in range(6)]), rcond=None)[0]
    rotation = turned(answer[:3])
    return rotation, origin + answer[3:] - rotation @ origin


def register(source: DataFrame, target: DataFrame, plane: bool = False, cutoff: float = 1.0, rounds: int = 50, tolerance: float = 1e-6, shrink: bool = True, k: int = 10) -> Registration:
    """Iterative closest points of ``source`` on ``target``, both ``(pid, x, y, z)``.

    Each round pairs every source point with the nearest target point within the cutoff, solves for a motion and pairs
    anew; one search serves the end of a round and the start of the next.  ``shrink`` takes a twentieth off the cutoff
    each round, down to 0.1.  It ends when the error, or its relative change, is below ``tolerance``.  ``fitness`` is
    the share of source points paired within the first cutoff.  Fewer than three pairs raise.
    """
    source, target = (materialise(t.select("pid", *"xyz"), name) for t, name in ((source, "source"), (target, "target")))  # read many times in each round
    whole = target.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()
    total = source.count()
    if not total or whole["x"] is None:
        raise ValueError("both clouds need points")
    origin = np.array([whole[a] for a in "xyz"])
    goal = target.select(F.col("pid").alias("nid"), *[F.col(a).alias(f"t{a}") for a in "xyz"])
    if plane:
        goal = materialise(goal.join(normals(target, k).select(F.col("pid").alias("nid"), "nx", "ny", "nz"), "nid"), "normals")

    def paired(rotation: np.ndarray, shift: np.ndarray) -> DataFrame:
        now = moved(source, rotation, shift)
        return materialise(nearest(now, target).join(now, "pid").join(goal, "nid"), "pairs")

    rotation, shift, limit = np.eye(3), np.zeros(3), cutoff
    pairs, last, done, error = paired(rotation, shift), None, False, float("inf")
    for turn in range(1, rounds + 1):
        near = pairs.where(F.col("distance") <= limit)
        if near.limit(3).count() < 3:
            raise ValueError("fewer than three pairs within the cutoff")
        more, by = (plane_step if plane else point_step)(near, origin)
        rotation, shift = more @ rotation, more @ shift + by
        pairs = paired(rotation, shift)
        error = pairs.where(F.col("distance") <= limit).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance")))).first()[0]
        error = float("inf") if error is None else error
        if last is not None and (error < tolerance or abs(last - error) / max(1e-12, abs(last)) < tolerance):
            done = True
            break
        last, limit = error, max(0.1, limit * 0.95) if shrink else limit
    fitness = pairs.where(F.col("distance") <= cutoff).count() / total
    return Registration(rotation, shift, error, fitness, turn, done)
