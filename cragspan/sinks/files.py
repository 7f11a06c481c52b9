"""LAS, XYZ and DXF written as folders of whole files, so that no row passes through the driver.

A task writes each file under a name of its own attempt and then moves it to the name of its partition, so a retried task
replaces what the lost one wrote.  The folder must be new or empty, and one that the driver and all executors see.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a file holds at most.
FILE_ROWS = 1_000_000

#: The point record of LAS format 3, and the length of the header of version 1.2.
LAS_RECORD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("gps_time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
LAS_HEADER = 227


def _system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def _in_files(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for frame in frames:
        while len(frame):
            part, frame = frame.iloc[: most - rows], frame.iloc[most - rows :]
            held.append(part)
            rows += len(part)
            if rows == most:
                yield pd.concat(held)
                held, rows = [], 0
    if held:
        yield pd.concat(held)


def _write(df: DataFrame, folder: str, ending: str, encode: Callable[[pd.DataFrame], bytes], most: int) -> DataFrame:
    """Files of ``encode``'s bytes; returns ``(file, rows)``, already written."""
    system, inner = _system(folder)
    system.create_dir(inner, recursive=True)
    if system.get_file_info(pyarrow.fs.FileSelector(inner)):
        raise ValueError(f"{folder} is not empty")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _system(folder)
        for k, frame in enumerate(_in_files(frames, most)):
            name = f"part-{TaskContext.get().partitionId():05d}-{k:05d}.{ending}"
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(encode(frame))
            fs.move(draft, f"{base}/{name}")
            yield pd.DataFrame({"file": [name], "rows": [len(frame)]})

    spark = df.sparkSession
    done = df.mapInPandas(run, "file string, rows long").collect()  # a row a file
    return spark.createDataFrame(done, "file string, rows long")


def write_las(cloud: DataFrame, folder: str, scale: float = 0.001, offset: tuple[float, float, float] | None = None, most: int = FILE_ROWS) -> DataFrame:
    """LAS 1.2 files of point format 3.  All share the offset, by default the cloud's low corner; columns not there are 0.

    Coordinates that are null or don't fit 32 bits at this scale raise.
    """
    if offset is None:
        low = cloud.agg(*[F.min(a).alias(a) for a in "xyz"]).first()
        offset = tuple(low[a] or 0.0 for a in "xyz")
    origin = tuple(float(v) for v in offset)
    same = {"intensity": "intensity", "classification": "class", "user_data": "user", "point_source_id": "source", "gps_time": "gps_time", "scan_angle": "angle", "red": "red", "green": "green", "blue": "blue"}
    has = [c for c in (*same, "return_number", "number_of_returns") if c in cloud.columns]

    def encode(frame: pd.DataFrame) -> bytes:
        at = frame[["x", "y", "z"]].to_numpy("f8")
        whole = np.rint((at - np.array(origin)) / scale)
        if not (np.abs(whole) < 2**31).all():
            raise ValueError("a coordinate is null or does not fit the scale")
        out = np.zeros(len(frame), np.dtype(LAS_RECORD))
        for k, n in enumerate("XYZ"):
            out[n] = whole[:, k]
        for c in has:
            if c in same:
                out[same[c]] = frame[c].fillna(0).to_numpy()
        first, last = (frame[c].fillna(0).to_numpy("i8") if c in has else np.zeros(len(frame), "i8") for c in ("return_number", "number_of_returns"))
        out["returns"] = (first & 7) | (last & 7) << 3
        head = bytearray(LAS_HEADER)
        head[:4], head[24:26] = b"LASF", bytes([1, 2])
        struct.pack_into("<HI4xBHI", head, 94, LAS_HEADER, LAS_HEADER, 3, out.dtype.itemsize, len(out))
        struct.pack_into("<5I", head, 111, *[int((first == k).sum()) for k in range(1, 6)])
        struct.pack_into("<6d", head, 131, scale, scale, scale, *origin)
        written = whole * scale + np.array(origin)
        struct.pack_into("<6d", head, 179, *[v for k in range(3) for v in (written[:, k].max(), written[:, k].min())])
        return bytes(head) + out.tobytes()

    return _write(cloud.select("x", "y", "z", *has), folder, "las", encode, most)


def write_xyz(cloud: DataFrame, folder: str) -> None:
    """``x y z`` a line without a header."""
    cloud.select(F.concat_ws(" ", "x", "y", "z")).write.text(folder)


def _tags(*pairs: tuple[int, Column | str | int]) -> Column:
    """Group codes and values, a line each."""
    return F.concat(*[v for code, value in pairs for v in (F.lit(f"{code}\n"), (value if isinstance(value, Column) else F.lit(value)).cast("string"), F.lit("\n"))])


def dxf_entity(flat_within: float = 1e-6) -> Column:
    """DXF text of a row ``(geometry_type, vertices, closed, faces, layer)``.

    Points are POINT; lines and polygons LWPOLYLINE if their elevations span at most ``flat_within``, else a
    three-dimensional POLYLINE; meshes a 3DFACE for each of ``faces`` (three vertex indices), the third corner repeated.
    """
    at, layer = F.col("vertices"), F.col("layer")
    z = F.transform(at, lambda v: v["z"])
    shut = F.coalesce(F.col("closed"), F.lit(False)).cast("int")
    place = lambda v, k=0: ((10 + k, v["x"]), (20 + k, v["y"]), (30 + k, v["z"]))
    point = _tags((0, "POINT"), (8, layer), *place(F.get(at, F.lit(0))))
    flat = F.concat(_tags((0, "LWPOLYLINE"), (100, "AcDbEntity"), (8, layer), (100, "AcDbPolyline"), (90, F.size(at)), (70, shut), (38, F.get(z, F.lit(0)))), F.array_join(F.transform(at, lambda v: _tags((10, v["x"]), (20, v["y"]))), ""))
    steep = F.concat(_tags((0, "POLYLINE"), (8, layer), (66, 1), (10, "0.0"), (20, "0.0"), (30, "0.0"), (70, shut + 8)), F.array_join(F.transform(at, lambda v: _tags((0, "VERTEX"), (8, layer), *place(v), (70, 32))), ""), _tags((0, "SEQEND"), (8, layer)))
    corner = lambda f, k: F.get(at, f[k])
    mesh = F.array_join(F.transform("faces", lambda f: _tags((0, "3DFACE"), (8, layer), *[t for k, c in enumerate((0, 1, 2, 2)) for t in place(corner(f, c), k)])), "")
    kind = F.lower("geometry_type")
    line = F.when(F.array_max(z) - F.array_min(z) <= flat_within, flat).otherwise(steep)
    return F.when(kind == "point", point).when(kind.isin("polyline", "polygon"), line).when(kind == "mesh", mesh)


def write_dxf(features: DataFrame, folder: str, most: int = 100_000) -> DataFrame:
    """DXF files of the entities section.  A row that has no entity (unknown type, no vertices, a mesh without faces) raises."""
    text = F.when(F.length("entity") > 0, F.col("entity")).otherwise(F.raise_error(F.lit("a feature has no entity to write")))
    rows = features.select(dxf_entity().alias("entity")).select(text.alias("entity"))
    encode = lambda frame: ("0\nSECTION\n2\nENTITIES\n" + "".join(frame["entity"]) + "0\nENDSEC\n0\nEOF\n").encode()
    return _write(rows, folder, "dxf", encode, most)
