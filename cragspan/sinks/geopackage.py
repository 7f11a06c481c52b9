"""GeoPackage files of features: a database file for each task's share, a table for each category and family of geometry.

A feature's geometry is encoded by column expressions; tasks only put finished rows into SQLite.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of geometry, kinds of well-known binary with elevations, and the attributes with columns of their own.
FAMILIES = {"point": "POINT", "polyline": "LINESTRING", "polygon": "POLYGON", "mesh": "MULTIPOLYGON"}
PROMOTED = ["survey_code", "survey_name", "cad_layer"]
WKB = {"POINT": 1001, "LINESTRING": 1002, "POLYGON": 1003, "MULTIPOLYGON": 1006}
#: Fixed value: "GPKG" as a number, the mark of such a file.
APPLICATION = 0x47504B47
#: Well-known text of the systems that are known by name.
SYSTEMS = {4326: ("WGS 84", 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]')}


def family(geometry_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.lower(geometry_type))


def resolve(epsg: int) -> tuple[str, str]:
    """Name and definition of a reference system; -1 and 0 stand for none and raise."""
    if epsg <= 0:
        raise ValueError(f"code {epsg} is no reference system")
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        half = "N" if epsg < 32700 else "S"
        north = 0 if half == "N" else 10000000
        middle = epsg % 100 * 6 - 183
        name = f"WGS 84 / UTM zone {epsg % 100}{half}"
        return name, f'PROJCS["{name}",{SYSTEMS[4326][1]},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{middle}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",{north}],UNIT["metre",1]]'
    if epsg not in SYSTEMS:
        raise ValueError(f"code {epsg} is not known here")
    return SYSTEMS[epsg]


def blob(kind: str, vertices: list, faces: list | None, srs: int) -> bytes:
    """A geometry as GeoPackage binary: header without an envelope, then well-known binary with elevations, little-endian."""
    at = [(v["x"], v["y"], v["z"]) for v in vertices]

    def ring(points: list) -> bytes:
        closed = points if points[0] == points[-1] else [*points, points[0]]
        return struct.pack("<I", len(closed)) + b"".join(struct.pack("<3d", *p) for p in closed)

    head = struct.pack("<2sBBi", b"GP", 0, 1, srs) + struct.pack("<BI", 1, WKB[kind])
    if kind == "POINT":
        return head + struct.pack("<3d", *at[0])
    if kind == "LINESTRING":
        return head + struct.pack("<I", len(at)) + b"".join(struct.pack("<3d", *p) for p in at)
    if kind == "POLYGON":
        return head + struct.pack("<I", 1) + ring(at)
    parts = [[at[k] for k in f] for f in (faces if faces is not None else [])]
    return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<BII", 1, WKB["POLYGON"], 1) + ring(p) for p in parts)


def issues(features: DataFrame) -> Column:
    """``no_geometry`` (an unknown type), ``no_vertices``, ``not_finite``, ``open_polygon``, ``no_faces`` (of a mesh) and ``no_category``."""
    kind = family(F.col("geometry_type"))
    bad = F.exists("vertices", lambda v: F.isnan(v["x"]) | F.isnan(v["y"]) | F.isnan(v["z"]) | (F.greatest(F.abs(v["x"]), F.abs(v["y"]), F.abs(v["z"])) == float("inf")))
    faces = F.coalesce(F.size("faces"), F.lit(0)) if "faces" in features.columns else F.lit(0)
    shut = F.coalesce(F.col("closed"), F.lit(False)) if "closed" in features.columns else F.lit(False)
    found = [F.when(kind.isNull(), "no_geometry"), F.when(F.coalesce(F.size("vertices"), F.lit(0)) <= 0, "no_vertices"), F.when(bad, "not_finite"), F.when((kind == "POLYGON") & ~shut, "open_polygon"), F.when((kind == "MULTIPOLYGON") & (faces <= 0), "no_faces"), F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "no_category")]
    return F.array_compact(F.array(*found))


def split_attributes(attributes: Column) -> list[Column]:
    """The promoted attributes of a map of texts, and the rest as JSON (null if there is none)."""
    rest = F.map_filter(attributes, lambda k, v: ~k.isin(*PROMOTED))
    return [*[F.try_element_at(attributes, F.lit(c)).alias(c) for c in PROMOTED], F.when(F.size(rest) > 0, F.to_json(rest)).alias("attributes_json")]


def table_bounds(features: DataFrame) -> DataFrame:
    """The box of each table, by category and family."""
    ends = [f(F.col(f"vertices.{a}")).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))]
    each = features.select("category", family(F.col("geometry_type")).alias("family"), *ends)
    return each.groupBy("category", "family").agg(*[(F.min if n == "min" else F.max)(f"{n}_{a}").alias(f"{n}_{a}") for a in "xy" for n in ("min", "max")], F.count("*").alias("features"))


#: How the tables of a family end, and the columns of a table of features (in ``_tables``).
ENDINGS = {"POINT": "point", "LINESTRING": "line", "POLYGON": "polygon", "MULTIPOLYGON": "multipolygon"}


def _tables(name: str, kind: str) -> list[str]:
    columns = "fid INTEGER PRIMARY KEY AUTOINCREMENT, geom " + kind + ", feature_id INTEGER, feature_type TEXT NOT NULL, category TEXT NOT NULL, survey_code TEXT, survey_name TEXT, cad_layer TEXT, confidence REAL, producer TEXT, producer_version TEXT, attributes_json TEXT"
    return [f'CREATE TABLE "{name}" ({columns})', f'CREATE VIRTUAL TABLE "rtree_{name}_geom" USING rtree(id, minx, maxx, miny, maxy)']


#: The system tables of the standard.
_SYSTEM = [
    "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id))",
    "CREATE TABLE gpkg_geometry_columns (table_name TEXT UNIQUE REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))",
    "CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name))",
]


def write(features: DataFrame, folder: str, epsg: int, producer: str = "cragspan") -> DataFrame:
    """GeoPackage files, one a task, in a folder that all executors see; returns ``(file, features)``.

    ``features(feature_id, feature_type, category, geometry_type, vertices[, closed, faces, confidence, attributes])``;
    a faulty feature (``issues``) raises.  A file is built under a draft's name and then renamed.
    """
    from pyarrow import fs

    name, definition = resolve(epsg)
    has = features.columns
    faults = issues(features)
    sound = F.when(F.size(faults) == 0, family(F.col("geometry_type"))).otherwise(F.raise_error(F.concat(F.lit("a feature can't be written: "), F.array_join(faults, ", "))).cast("string"))
    attributes = F.col("attributes") if "attributes" in has else F.create_map().cast("map<string,string>")
    optional = [(F.col(c) if c in has else F.lit(None).cast(kind)).alias(c) for c, kind in (("faces", "array<array<int>>"), ("confidence", "double"))]
    rows = features.select(F.col("feature_id").cast("long").alias("feature_id"), "feature_type", "category", sound.alias("family"), "vertices", *optional, *split_attributes(attributes))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as scratch:  # SQLite needs a local file; it is copied when done
            yield from draft(batches, f"{scratch}/features.gpkg")

    def draft(batches: Iterator[pd.DataFrame], local: str) -> Iterator[pd.DataFrame]:
        base = sqlite3.connect(local)
        base.execute(f"PRAGMA application_id = {APPLICATION}")
        base.execute("PRAGMA user_version = 10300")
        for statement in _SYSTEM:
            base.execute(statement)
        system = "INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)"
        base.executemany(system, [("Undefined Cartesian", -1, "NONE", -1, "undefined"), ("Undefined geographic", 0, "NONE", 0, "undefined")])
        base.execute("INSERT OR REPLACE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (name, epsg, epsg, definition))
        boxes: dict[str, list[float]] = {}
        count = 0
        for b in batches:
            for r in b.to_dict("records"):
                kind = r["family"]
                table = "".join(c if c.isalnum() else "_" for c in f"{r['category']}_{ENDINGS[kind]}".lower())
                xs, ys = [v["x"] for v in r["vertices"]], [v["y"] for v in r["vertices"]]
                ends = [min(xs), min(ys), max(xs), max(ys)]
                if table not in boxes:
                    for statement in _tables(table, kind):
                        base.execute(statement)
                    boxes[table] = ends
                    base.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (table, table, epsg))
                    base.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 1, 0)", (table, kind, epsg))
                    base.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (table,))
                own = boxes[table]
                boxes[table] = [min(own[0], ends[0]), min(own[1], ends[1]), max(own[2], ends[2]), max(own[3], ends[3])]
                values = [blob(kind, r["vertices"], r["faces"], epsg), *[None if r[c] is None or r[c] != r[c] else r[c] for c in ("feature_id", "feature_type", "category", *PROMOTED, "confidence")], producer, "1.0", r["attributes_json"]]
                fid = base.execute(f'INSERT INTO "{table}" (geom, feature_id, feature_type, category, survey_code, survey_name, cad_layer, confidence, producer, producer_version, attributes_json) VALUES ({", ".join("?" * 11)})', values).lastrowid
                base.execute(f'INSERT INTO "rtree_{table}_geom" VALUES (?, ?, ?, ?, ?)', (fid, ends[0], ends[2], ends[1], ends[3]))
                count += 1
        for table, ends in boxes.items():
            base.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ? WHERE table_name = ?", (*ends, table))
        base.commit()
        base.close()
        if count:
            system_, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
            system_.create_dir(root, recursive=True)
            final = f"part-{TaskContext.get().partitionId():05d}.gpkg"  # a second attempt replaces the first
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with open(local, "rb") as f, system_.open_output_stream(hidden) as out:
                while part := f.read(1 << 22):
                    out.write(part)
            system_.move(hidden, f"{root}/{final}")
            yield pd.DataFrame({"file": [final], "features": [count]})

    done = rows.mapInPandas(fill, "file string, features long").collect()  # a row a file
    return features.sparkSession.createDataFrame(done, "file string, features long")
