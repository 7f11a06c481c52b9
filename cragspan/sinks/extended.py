"""Extended data of DXF entities: keys and typed values as group codes; layers by feature type."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from cragspan.operators.lines import contour_name

#: Group codes of texts, decimals, flags and whole numbers.
TEXT, REAL, FLAG, WHOLE = 1000, 1040, 1070, 1071
#: Layers of feature types.
LAYERS = {
    "building": "BUILDINGS", "wall": "WALLS", "retaining_wall": "RETAINING_WALLS", "roof": "ROOFS", "road": "ROADS", "curb": "CURBS", "parking": "PARKING", "driveway": "DRIVEWAYS", "drainage": "DRAINAGE", "channel": "CHANNELS",
    "manhole": "MANHOLES", "inspection_chamber": "INSPECTION_CHAMBERS", "tree": "TREES", "shrub": "SHRUBS", "grass": "GRASS", "pole": "POLES", "sign": "SIGNS", "light_pole": "LIGHT_POLES",
}
CONTOURS = {"major": "TOPO_CONTOURS_MAJOR", "minor": "TOPO_CONTOURS_MINOR", None: "TOPO_CONTOURS"}


def encode(payload: dict[str, object]) -> list[tuple[int, object]]:
    """Pairs of key and value; lists and objects of plain values are one text of JSON, and anything else raises."""
    out: list[tuple[int, object]] = []
    for key, value in payload.items():
        if isinstance(value, bool):
            pair = (FLAG, int(value))
        elif isinstance(value, int):
            pair = (WHOLE, value)
        elif isinstance(value, float):
            pair = (REAL, value)
        elif isinstance(value, str):
            pair = (TEXT, value)
        elif isinstance(value, list | tuple) and all(isinstance(v, bool | int | float | str) for v in value):
            pair = (TEXT, json.dumps(list(value), separators=(",", ":")))
        elif isinstance(value, dict) and all(isinstance(v, bool | int | float | str) for v in value.values()):
            pair = (TEXT, json.dumps(value, separators=(",", ":")))
        else:
            raise TypeError(f"{key}: {type(value).__name__} has no extended data")
        out += [(TEXT, str(key)), pair]
    return out


def decode(tags: list[tuple[int, object]]) -> dict[str, object]:
    """Keys and values of encoded pairs; collections come back as their text."""
    turn = {TEXT: str, REAL: float, FLAG: bool, WHOLE: int}
    if len(tags) % 2 or any(code != TEXT for code, _ in tags[::2]):
        raise ValueError("extended data must be pairs of a key and a value")
    if unknown := [code for code, _ in tags[1::2] if code not in turn]:
        raise ValueError(f"unknown group codes {unknown}")
    return {str(key): turn[code](value) for (_, key), (code, value) in zip(tags[::2], tags[1::2], strict=True)}


def extended(attributes: Column, application: str) -> Column:
    """DXF text of a map of texts as extended data: the application, then a key and a text each."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(F.lit("1000\n"), e["key"], F.lit("\n1000\n"), e["value"], F.lit("\n")))
    return F.when(F.size(attributes) > 0, F.concat(F.lit(f"1001\n{application}\n"), F.array_join(pairs, ""))).otherwise("")


def layer(feature_type: Column, own: Column | None = None) -> Column:
    """The layer that a feature names itself, else that of its type, else layer 0."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.lower(feature_type))
    return F.coalesce(*([F.nullif(F.trim(own), F.lit(""))] if own is not None else []), known, F.lit("0"))


def contour_layer(level: Column, base: float | None, interval: float | None, every: int = 5) -> Column:
    """The layer of a contour: every ``every``-th one is major; without base or interval there is one layer."""
    if base is None or interval is None:
        return F.lit(CONTOURS[None])
    if interval <= 0 or every < 1:
        raise ValueError("interval and every must be positive")
    return F.when(level.isNull(), CONTOURS[None]).when(contour_name(level, base, interval, every) == "major", CONTOURS["major"]).otherwise(CONTOURS["minor"])
