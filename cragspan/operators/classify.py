"""Classes of points: by rules on local geometry, and by forests and boosted trees learned with Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.operators.cloud import ground_elevation
from cragspan.operators.neighbours import local_density, radius_count, relative_height
from cragspan.operators.shape import normals, shape_features

#: The thresholds of the rules, by name.
RULES = {
    "ground_height": 0.2, "low_height": 0.5, "high_height": 2.0, "curvature": 0.02, "least_height": 0.1, "vegetation_planarity": 0.6, "vegetation_linearity": 0.8, "vegetation_sphericity": 0.2,
    "vegetation_anisotropy": 0.8, "vegetation_omnivariance": 0.01, "building_planarity": 0.5, "building_sphericity": 0.3, "roof_verticality": 0.3, "wall_verticality": 0.7, "building_height": 50.0,
}
#: The features a learned classifier may use, and those it uses unless told otherwise.
FEATURES = ["height", "height_above_ground", "curvature", "planarity", "linearity", "sphericity", "verticality", "density", "intensity", "return_number", "number_of_returns"]
DEFAULT_FEATURES = ["height", "height_above_ground", "curvature", "planarity", "verticality"]


def point_features(cloud: DataFrame, k: int = 10, radius: float = 1.0, cell: float = 1.0, least_neighbours: int = 4) -> DataFrame:
    """``cloud`` with height, height_above_ground (over its cell's lowest point), curvature, the features of its
    neighbourhood, verticality (1 - |nz|), density, and noise (too few neighbours within the radius)."""
    shape = shape_features(cloud, k).withColumnRenamed("surface_variation", "curvature").drop("eigenentropy")
    upright = normals(cloud, k).select("pid", (1 - F.abs("nz")).alias("verticality"))
    ground = ground_elevation(cloud.select("pid", *"xyz"), cell, cell).select("pid", F.greatest(F.col("z") - F.col("ground"), F.lit(0.0)).alias("height_above_ground"))
    near = radius_count(cloud, radius).select("pid", (F.col("neighbours") < least_neighbours).alias("noise"))
    out = cloud.withColumn("height", F.col("z"))
    for part in (shape, upright, ground, near, local_density(cloud, radius)):
        out = out.join(part, "pid")
    return out


def building_rule(rules: dict[str, float] = RULES) -> Column:
    v = F.col("verticality")
    return (F.col("planarity") >= rules["building_planarity"]) & (F.col("sphericity") <= rules["building_sphericity"]) & (F.col("height_above_ground") <= rules["building_height"]) & ((v <= rules["roof_verticality"]) | (v >= rules["wall_verticality"]))


def vegetation_rule(rules: dict[str, float] = RULES) -> Column:
    return (
        (F.col("height_above_ground") >= rules["least_height"]) & (F.col("curvature") >= rules["curvature"]) & (F.col("planarity") <= rules["vegetation_planarity"]) & (F.col("linearity") <= rules["vegetation_linearity"])
        & (F.col("sphericity") >= rules["vegetation_sphericity"]) & (F.col("anisotropy") <= rules["vegetation_anisotropy"]) & (F.col("omnivariance") >= rules["vegetation_omnivariance"])
    )


def by_rules(features: DataFrame, rules: dict[str, float] = RULES) -> DataFrame:
    """Adds ``label`` by the first rule that holds: noise 18, ground 2, building 6, vegetation 3, 4 or 5 by height, else 1."""
    h = F.col("height_above_ground")
    plant = F.when(h <= rules["low_height"], 3).when(h >= rules["high_height"], 5).otherwise(4)
    label = F.when(F.col("noise"), 18).when(h <= rules["ground_height"], 2).when(building_rule(rules), 6).when(vegetation_rule(rules), plant).otherwise(1)
    return features.withColumn("label", label)


def height_over(cloud: DataFrame, ground: DataFrame) -> DataFrame:
    """``cloud`` with height_above_ground over the nearest of the ground's points."""
    return cloud.join(relative_height(cloud, ground).withColumnRenamed("height", "height_above_ground"), "pid")


def _fit(labelled: DataFrame, model, features: list[str], label: str) -> PipelineModel:
    if unknown := set(features) - set(labelled.columns):
        raise ValueError(f"no columns {sorted(unknown)}")
    seen = labelled.where(f"{label} is not null").agg(F.min(label), F.count_distinct(label)).first()
    if seen[1] < 2 or seen[0] < 0:
        raise ValueError("training needs two classes or more, none of them negative")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), model]).fit(labelled.where(f"{label} is not null"))


def random_forest(labelled: DataFrame, features: list[str] = DEFAULT_FEATURES, label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, predictionCol="predicted", probabilityCol="_probability", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return _fit(labelled, model, features, label)


def gradient_boost(labelled: DataFrame, features: list[str] = DEFAULT_FEATURES, label: str = "label", rounds: int = 100, rate: float = 0.1, depth: int = 5, seed: int = 42) -> PipelineModel:
    """One boosted model a class against the others."""
    one = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)
    return _fit(labelled, OneVsRest(classifier=one, featuresCol="_features", labelCol=label, predictionCol="predicted"), features, label)


def predict(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``features`` with ``predicted`` and, where the model gives probabilities, ``confidence``; rows without a feature are left out."""
    found = model.transform(features)
    if "_probability" in found.columns:
        found = found.withColumn("confidence", F.array_max(vector_to_array("_probability")))
    return found.select(*features.columns, F.col("predicted").cast("int").alias("predicted"), *(["confidence"] if "confidence" in found.columns else []))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def of_class(labelled: DataFrame, *classes: int, label: str = "label") -> DataFrame:
    return labelled.where(F.col(label).isin(*classes))


#: Classifiers by name.
METHODS = {"rules": by_rules, "random_forest": random_forest, "gradient_boost": gradient_boost}
