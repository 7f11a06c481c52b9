"""Binary point clouds, LAS and PLY: the driver reads the header, tasks read runs of whole records at their offsets.

Paths are what ``pyarrow.fs`` opens (a local or shared path, or a URI), on the driver and on executors alike.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.sources.lines import numbered_lines

CHUNK = 1_000_000  # records a task reads at once

#: Fields of the point records of the LAS formats read here, and the scalar types of PLY.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
LAS_FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
PLY_COLUMNS = {"red": "red", "green": "green", "blue": "blue", "nx": "nx", "ny": "ny", "nz": "nz", "intensity": "intensity"}


def _open(path: str) -> pyarrow.NativeFile:
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _records(path: str, start: int, dtype: np.dtype, first: int, count: int) -> np.ndarray:
    with _open(path) as f:
        f.seek(start + first * dtype.itemsize)
        body = f.read(count * dtype.itemsize)
    if len(body) < count * dtype.itemsize:
        raise ValueError(f"{path}: the body ends before its last record")
    return np.frombuffer(body, dtype, count)


def _chunks(spark: SparkSession, path: str, start: int, dtype: np.dtype, count: int, schema: str, shape) -> DataFrame:
    pieces = -(-count // CHUNK)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in (int(i) for frame in frames for i in frame["id"]):
            first = piece * CHUNK
            r = _records(path, start, dtype, first, min(CHUNK, count - first))
            yield pd.DataFrame({"pid": np.arange(first, first + len(r)), **shape(r)})

    return spark.range(0, pieces, 1, max(pieces, 1)).mapInPandas(read, "pid long, " + schema)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of an uncompressed LAS file of formats 0-3 and 6-8, scaled; columns a format lacks are null."""
    with _open(path) as f:
        head = f.read(375)
    if head[:4] != b"LASF" or len(head) < 227:
        raise ValueError(f"{path}: not a LAS file")
    start, kind, width, count = struct.unpack_from("<I4xBHI", head, 96)
    if kind & 0xC0:
        raise ValueError(f"{path}: compressed points (LAZ) need a codec that is not part of this library")
    if kind not in LAS_FORMATS:
        raise ValueError(f"{path}: point format {kind} is not read")
    if head[25] >= 4 and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    scale, offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    fields = LAS_FORMATS[kind]
    packed = np.dtype(fields)
    if width < packed.itemsize:
        raise ValueError(f"{path}: records of {width} bytes are too short for point format {kind}")
    dtype = np.dtype({"names": packed.names, "formats": [t for _, t in fields], "offsets": [packed.fields[n][1] for n in packed.names], "itemsize": width})
    bits, classes = (4, 255) if kind >= 6 else (3, 31)

    def shape(r: np.ndarray) -> dict[str, object]:
        out = {a: r[a.upper()] * s + o for a, s, o in zip("xyz", scale, offset, strict=True)}
        out |= {"intensity": r["intensity"].astype("i4"), "return_number": (r["returns"] & (2**bits - 1)).astype("i2"), "number_of_returns": (r["returns"] >> bits & (2**bits - 1)).astype("i2"), "classification": (r["class"] & classes).astype("i2")}
        return out | {n: (r[n].astype(t) if n in r.dtype.names else None) for n, t in (("gps_time", "f8"), ("red", "i4"), ("green", "i4"), ("blue", "i4"))}

    schema = "x double, y double, z double, intensity int, return_number short, number_of_returns short, classification short, gps_time double, red int, green int, blue int"
    return _chunks(spark, path, start, dtype, count, schema, shape)


def _ply_header(path: str) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int, int]:
    lines, size = [], 0
    with _open(path) as f:
        text = b""
        while b"end_header" not in text or b"\n" not in text.split(b"end_header", 1)[1]:
            more = f.read(65536)
            if not more or len(text) > 1 << 24:
                raise ValueError(f"{path}: the header has no end")
            text += more
    size = text.index(b"\n", text.index(b"end_header")) + 1
    lines = text[:size].decode("ascii").split("\n")[:-1]
    if lines[0].strip() != "ply":
        raise ValueError(f"{path}: not a PLY file")
    layout, elements = "", []
    for words in (line.split() for line in lines[1:-1]):
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            layout = words[1]
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property" and elements:
            elements[-1][2].append((words[-1], words[1]))
        else:
            raise ValueError(f"{path}: unknown header line {' '.join(words)}")
    if layout not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"{path}: unknown format {layout}")
    return layout, elements, size, len(lines)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a PLY file: x, y, z and those of colour, normal and intensity that it has; ``vertex`` must be its first element."""
    layout, elements, size, lines = _ply_header(path)
    if not elements or elements[0][0] != "vertex":
        raise ValueError(f"{path}: vertices must come first")
    _, count, properties = elements[0]
    if any(kind not in PLY_TYPES for _, kind in properties) or not {"x", "y", "z"} <= {n for n, _ in properties}:
        raise ValueError(f"{path}: vertices need x, y and z and scalar properties only")
    more = [n for n, _ in properties if n in PLY_COLUMNS]
    schema = ", ".join([f"{a} double" for a in "xyz"] + [f"{n} double" for n in more])
    if layout == "ascii":
        names = [n for n, _ in properties]
        rows = numbered_lines(spark, path)
        body = rows.where((F.col("line") >= lines) & (F.col("line") < lines + count)).select((F.col("line") - lines).alias("pid"), F.split(F.trim("value"), r"\s+").alias("w"))
        whole = F.when(F.size("w") == len(names), F.col("w")).otherwise(F.raise_error(F.lit(f"{path}: a vertex has too few or too many values")))
        return body.withColumn("w", whole).select("pid", *[F.col("w")[names.index(n)].cast("double").alias(n) for n in ("x", "y", "z", *more)])
    order = "<" if layout == "binary_little_endian" else ">"
    dtype = np.dtype([(n, order + PLY_TYPES[kind]) for n, kind in properties])
    return _chunks(spark, path, size, dtype, count, schema, lambda r: {n: r[n].astype("f8") for n in ("x", "y", "z", *more)})
