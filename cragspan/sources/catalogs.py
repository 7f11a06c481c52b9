"""Catalogs of field codes: CSV, JSON and YAML files, their entries' faults, and an audit over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a catalog, those that must be there, and what stands for true and false.
COLUMNS = ["code", "name", "geometry_type", "feature_type", "category", "layer", "closed", "aliases"]
REQUIRED = COLUMNS[:6]
TRUE = ["1", "true", "yes", "y", "si", "sí"]
FALSE = ["0", "false", "no", "n"]
GEOMETRIES = ["point", "symbol", "line", "polygon", "ground"]

_ENTRY = "code string, name string, geometry_type string, feature_type string, category string, layer string, closed boolean, aliases array<string>"


def _text(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CSV catalogs with ``issues``; a missing required column raises, aliases are cut at ``;``."""
    raw = spark.read.csv(path, header=True, escape='"')
    raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    if missing := sorted(set(REQUIRED) - set(raw.columns)):
        raise ValueError(f"the catalog lacks {', '.join(missing)}")
    for name in COLUMNS[6:]:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    said = F.lower(F.trim("closed"))
    closed = F.when(F.coalesce(said, F.lit("")).isin("", *FALSE), False).when(said.isin(*TRUE), True)
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ";"), lambda v: F.trim(v)), lambda a: a != "")
    return checked(raw.select(*[_text(c).alias(c) for c in REQUIRED], closed.alias("closed"), aliases.alias("aliases")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON catalogs (an array of objects, or one a line) with ``issues``; values of another type count as missing."""
    raw = spark.read.schema(_ENTRY).json(path, multiLine=True)
    return checked(raw.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("closed", F.coalesce("closed", F.lit(False))))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of YAML catalogs with ``issues``.  Needs PyYAML where tasks run; a file is read whole in one task."""
    import yaml

    def parse(batches):
        import pandas as pd

        for b in batches:
            rows = [{c: e.get(c) for c in COLUMNS} for content in b["content"] for e in (yaml.safe_load(content) or [])]
            yield pd.DataFrame(rows, columns=COLUMNS)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, _ENTRY)
    return checked(raw.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("closed", F.coalesce("closed", F.lit(False))))


def checked(entries: DataFrame, categories: list[str] | None = None, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Entries with ``issues``: ``missing_<column>``, ``geometry_type``, ``closed`` (unreadable), ``feature_type`` (a ground
    code has one, or another has none), ``category`` (none of ``categories``) and ``geometry`` (none that ``allowed``
    lists for the feature type).  All of an entry's faults are listed."""
    kind = F.lower("geometry_type")
    found = [F.when(F.col(c).isNull(), f"missing_{c}") for c in REQUIRED if c != "feature_type"]
    found.append(F.when(F.col("geometry_type").isNotNull() & ~kind.isin(*GEOMETRIES), "geometry_type"))
    found.append(F.when(F.col("closed").isNull(), "closed"))
    found.append(F.when((kind == "ground") != F.col("feature_type").isNull(), "feature_type"))
    if categories:
        found.append(F.when(F.col("category").isNotNull() & ~F.col("category").isin(*categories), "category"))
    if allowed:
        known = F.element_at(F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("feature_type"))
        found.append(F.when(~F.coalesce(F.array_contains(known, kind), F.lit(True)), "geometry"))
    return entries.withColumn("geometry_type", kind).withColumn("issues", F.array_compact(F.array(*found)))


def definitions(entries: DataFrame) -> DataFrame:
    """The entries, if none of them has a fault; else an error that lists all faults of the first hundred faulty entries."""
    bad = entries.where(F.size("issues") > 0).select(F.coalesce("code", F.lit("")).alias("code"), "issues")
    if first := bad.orderBy("code").limit(100).collect():
        raise ValueError("; ".join(f"{r['code']}: {', '.join(r['issues'])}" for r in first))
    return entries.drop("issues")


def register(known: DataFrame, more: DataFrame, overwrite: bool = False) -> DataFrame:
    """``known`` and ``more`` as one registry by upper-case code.  Codes that both define differently raise, unless the later one is to win."""
    both = known.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1))).withColumn("_key", F.upper("code"))
    whole = F.xxhash64(*[c for c in COLUMNS if c in known.columns])
    latest = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_from"), "code"))
    if not overwrite:
        clash = both.groupBy("_key").agg(F.count_distinct(whole).alias("n")).where("n > 1").select("_key").orderBy("_key").limit(20)
        if names := [r[0] for r in clash.collect()]:
            raise ValueError(f"codes defined twice: {', '.join(names)}")
    return both.withColumn("_k", latest).where("_k = 1").drop("_k", "_key", "_from")


def audit(entries: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Violations ``(subject, kind)`` over a whole catalog: duplicate_code (unequal definitions), duplicate_alias (one that
    names several codes), empty_layer, invalid_closed (not a polygon), geometry, and inconsistent_category (by type)."""
    whole = F.xxhash64("name", "geometry_type", "feature_type", "category", "layer", "closed", "aliases")

    def tell(rows: DataFrame, subject: str, kind: str) -> DataFrame:
        return rows.select(F.col(subject).alias("subject"), F.lit(kind).alias("kind"))

    found = [
        tell(entries.groupBy(F.upper("code").alias("_c")).agg(F.count_distinct(whole).alias("n")).where("n > 1"), "_c", "duplicate_code"),
        tell(entries.select("code", F.explode("aliases").alias("_a")).groupBy(F.upper("_a").alias("_c")).agg(F.count_distinct("code").alias("n")).where("n > 1"), "_c", "duplicate_alias"),
        tell(entries.where(F.coalesce(F.trim("layer"), F.lit("")) == ""), "code", "empty_layer"),
        tell(entries.where(F.col("closed") & (F.lower("geometry_type") != "polygon")), "code", "invalid_closed"),
        tell(entries.where("feature_type is not null").groupBy("feature_type").agg(F.count_distinct("category").alias("n")).where("n > 1"), "feature_type", "inconsistent_category"),
        tell(checked(entries, allowed=allowed).where(F.arrays_overlap("issues", F.array(F.lit("geometry"), F.lit("feature_type"), F.lit("geometry_type")))), "code", "geometry"),
    ]
    return reduce(DataFrame.union, found)


def audit_counts(entries: DataFrame) -> DataFrame:
    """``(counted, value, codes)``: numbers of codes by category, geometry and feature type."""
    parts = F.array(*[F.struct(F.lit(c).alias("counted"), F.col(c).alias("value")) for c in ("category", "geometry_type", "feature_type")])
    return entries.select(F.explode(parts).alias("_p")).where("_p.value is not null").groupBy("_p.counted", "_p.value").agg(F.count("*").alias("codes"))
