"""Operators by kind and name, and places where users put their own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.functions import geodesy, geometry
from cragspan.operators import classify, cloud, constrained, features, ground, lines, meshes, neighbours, profiles, registration, sampling, segments, shape, survey, terrain, triangulate, visibility


class Operator(Protocol):
    """Filters, samplers, segmenters, classifiers, detectors and surfaces: functions from tables to a table."""

    def __call__(self, table: DataFrame, *args: object, **options: object) -> DataFrame: ...


METHODS: dict[str, dict[str, Callable]] = {
    "filter": {"pass_through": cloud.pass_through, "crop_box": cloud.crop_box, "clip_polygon": cloud.clip_polygon, "statistical_outliers": neighbours.statistical_outliers, "radius_outliers": neighbours.radius_outliers},
    "sampling": dict(sampling.METHODS),
    "ground": dict(ground.METHODS),
    "normals": dict(shape.METHODS),
    "features": {"shape": shape.shape_features, "density": neighbours.local_density, "relative_height": neighbours.relative_height, "points": classify.point_features},
    "segmentation": dict(segments.METHODS),
    "classification": dict(classify.METHODS),
    "registration": {"point_to_point": registration.register, "point_to_plane": lambda source, target, **o: registration.register(source, target, True, **o)},
    "profile": dict(profiles.METHODS),
    "statistics": {"elevation": cloud.elevation_statistics, "attribute": cloud.attribute_statistics, "area": terrain.surface_area, "density": cloud.density_map, "distribution": cloud.histogram, "slope": terrain.derivatives},
    "surface": {"delaunay": triangulate.delaunay, "constrained": constrained.constrain, "break_lines": constrained.enforce, "without_spikes": triangulate.without_spikes},
    "interpolation": {"linear": terrain.locate, "idw": terrain.idw, "nearest": neighbours.nearest},
    "volume": {"cut_fill": terrain.cut_fill, "tin": terrain.tin_volume, "average_end_area": survey.average_end_area, "prismoidal": survey.prismoidal},
    "distance": {"euclidean": geometry.distance, "slope": geometry.slope_percent, "angle": geometry.slope_angle, "geodesic": geodesy.geodesic},
    "visibility": {"line_of_sight": visibility.line_of_sight, "viewshed": visibility.viewshed, "intervisibility": visibility.intervisibility, "network": visibility.network},
    "quality": {"rmse": survey.rmse, "control_points": survey.control_points, "precision": survey.precision, "completeness": survey.completeness, "correctness": survey.correctness, "registration": survey.registration_quality, "cloud_to_cloud": neighbours.cloud_to_cloud, "cloud_to_mesh": meshes.cloud_to_mesh, "hausdorff": neighbours.hausdorff, "chamfer": neighbours.chamfer},
    "detector": {"clusters": features.detect, "features": features.detected, "roofs": features.roofs, "embankments": features.embankments, "drainage": lines.drainage, "channels": lines.channels, "breaklines": lines.break_lines, "curbs": lines.curbs, "slope_changes": lines.slope_changes, "contours": lines.contour_lines},
}


def register(kind: str, name: str, operator: Callable) -> None:
    """Adds a user's own operator; a name that is taken raises."""
    known = METHODS.setdefault(kind, {})
    if name in known:
        raise ValueError(f"{kind} {name} is there already")
    known[name] = operator


def unregister(kind: str, name: str) -> None:
    METHODS[kind].pop(name)


def run(kind: str, name: str, *tables: object, **options: object) -> DataFrame:
    """The operator of this kind and name, applied."""
    if kind not in METHODS or name not in METHODS[kind]:
        raise ValueError(f"{kind} {name}: one of {sorted(METHODS.get(kind, METHODS))}")
    return METHODS[kind][name](*tables, **options)


def run_detectors(inputs: dict[str, tuple], strict: bool = True) -> dict[str, DataFrame]:
    """Detectors by name on their inputs ``{name: tables}``; an unknown one raises, or is left out unless ``strict``."""
    known = METHODS["detector"]
    if strict and (unknown := set(inputs) - set(known)):
        raise ValueError(f"no detectors {sorted(unknown)}")
    return {name: known[name](*tables) for name, tables in inputs.items() if name in known}


def compute_all(points: DataFrame, computers: dict[str, Callable[[DataFrame], DataFrame | Column]]) -> DataFrame:
    """``points(pid, ...)`` with a column for each computer: a column expression, or a table (pid, value) that is joined."""
    for name, compute in computers.items():
        found = compute(points)
        if isinstance(found, DataFrame):
            value = next(c for c in found.columns if c != "pid")
            points = points.join(found.select("pid", F.col(value).alias(name)), "pid", "left")
        else:
            points = points.withColumn(name, found)
    return points
