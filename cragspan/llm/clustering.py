"""Centroid clustering by delta Lloyd rounds on whole numbers.

Each round writes every vector's cluster and distance; the sums of the clusters stay with the driver, a row a cluster.
The next round looks at what has changed only: a vector whose centroid stayed where it was is compared with the
centroids that moved, all others with every centroid.  Vectors that change their cluster are added to one sum and
taken from another; these signed transfers, added up inside tasks first, bring the sums up to date.  All
arithmetic is exact, so that rounds, machines and orders of rows can't change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import saved

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
#: Components up to which all distances of 64 components fit into 64 bits.
MOST = 1 << 27
#: Components up to which products and sums of float64 are exact.
EXACT = 1 << 22


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q)``: the vectors with exactly ``dimensions`` components, none null or non-finite, as floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    whole = F.size(F.filter(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))) == 0
    kept = vectors.where((F.size(x) == dimensions) & whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: v * scale).alias("x"))
    wide = F.exists("x", lambda v: F.abs(v) >= MOST)
    told = F.when(wide, F.raise_error(F.concat(F.lit("a component is too large for distances of 64 bits: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return kept.select("vec_id", F.coalesce(told.cast("array<int>"), F.transform("x", lambda v: F.floor(v).cast("int"))).alias("q"))


def seeds(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of the least SHA-256 of ``<seed>:<vec_id>``; of equal ids the lesser vector first, null ids last."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r["q"] for r in vectors.orderBy(drawn.asc_nulls_last(), "q").limit(clusters).collect()]  # a row a cluster


def _distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of int64 vectors to int64 centroids, exactly."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT / max(1.0, q.shape[1] / DIMENSIONS):
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)


def reassign(q: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids (ties: the smaller number) after those in ``moved`` (bool) have moved; cluster -1 is none yet."""
    cluster, distance = cluster.copy(), distance.copy()
    loose = (cluster < 0) | moved[cluster]
    if loose.any():
        d = _distances(q[loose], centroids)
        cluster[loose] = d.argmin(1)
        distance[loose] = d.min(1)
    if moved.any() and not loose.all():
        names = np.flatnonzero(moved)
        d = _distances(q[~loose], centroids[moved])
        best, to = d.min(1), names[d.argmin(1)]
        old, was = distance[~loose], cluster[~loose]
        nearer = (best < old) | ((best == old) & (to < was))
        cluster[~loose], distance[~loose] = np.where(nearer, to, was), np.where(nearer, best, old)
    return cluster, distance


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, dimensions: int) -> DataFrame:
    """The next state: ``(vec_id, q, cluster, distance, was)``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, distance = reassign(q, was, b.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(was.astype(np.int32))], names=["vec_id", "q", "cluster", "distance", "was"])

    return state.mapInArrow(assign, "vec_id long, q array<int>, cluster int, distance long, was int")


def _transfers(state: DataFrame, clusters: int, dimensions: int) -> dict[int, np.ndarray]:
    """What each cluster gains, signed: the sums of the components and, last, the count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((clusters, dimensions + 1), np.int64)
        for b in batches:
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            one = np.concatenate([q, np.ones((len(q), 1), np.int64)], 1)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = b.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]):
                    held[c] += sign * one[of == c].sum(0)
        some = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "gain"])

    gains = state.where("cluster <> was").select("q", "cluster", "was").mapInArrow(add, "cluster int, gain array<long>")
    each = gains.select("cluster", F.posexplode("gain").alias("k", "v")).groupBy("cluster", "k").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in each.collect():  # clusters * (dimensions + 1) rows
        found.setdefault(r["cluster"], np.zeros(dimensions + 1, object))[r["k"]] = r["v"]
    return found


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS) -> tuple[DataFrame, list[list[int]]]:
    """``(state, centroids)`` of ``quantised`` vectors after ``rounds`` rounds and one assignment more.

    A round assigns every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and
    replaces each centroid that has vectors by floor(sum / count) of each component; one without stays.  There
    are fewer clusters than asked for if there are fewer vectors.
    """
    first = saved(vectors.select("vec_id", "q", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was")), "lloyd-vectors")
    at = seeds(first, clusters, seed)
    if not at:
        return first, []
    sums = [np.zeros(dimensions + 1, object) for _ in at]
    moved, state = np.ones(len(at), bool), first
    for k in range(rounds + 1):
        state = saved(_round(state, np.array(at, np.int64), moved, dimensions), "lloyd-round")
        if k == rounds:
            break
        for c, gain in _transfers(state, len(at), dimensions).items():
            sums[c] = sums[c] + gain
        new = [[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else old for s, old in zip(sums, at, strict=True)]
        moved = np.array([a != b for a, b in zip(at, new, strict=True)])
        at = new
    return state, at


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed
    over its cluster and over all) and centroid_sha256 (of its centroid's components, comma-joined).

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; null vectors and others are left
    out.  A component is floor(scale * x); one past 2^27, whose distances could pass 64 bits, raises an
    error.  Rows that share an id, and repeated rows, are vectors of their own; null ids start no centroid unless too few
    others do.  An empty table gives none.  Other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    state, at = lloyd(quantised(vectors, vec_id, vector, dimensions, scale), clusters, rounds, seed, dimensions)
    sums = {r[0]: r[1] for r in state.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a cluster
    total = sum(sums.values())
    known = [(c, sums.get(c, 0), total, hashlib.sha256(",".join(map(str, q)).encode()).hexdigest()) for c, q in enumerate(at)]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
