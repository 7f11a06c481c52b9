"""Point clouds and surveys as text: whitespace, comma, semicolon or tab; PTS; survey layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragspan.sources.lines import numbered_lines

#: Other names of columns, and the columns of headerless survey layouts.
ALIASES = {"x": ["x", "easting", "east", "e"], "y": ["y", "northing", "north", "n"], "z": ["z", "elevation", "elev", "height"], "intensity": ["intensity", "i"], "classification": ["classification", "class"]}
LAYOUTS = {"ID_XYZ_CODE": ["id", "x", "y", "z", "code"], "NEZ": ["y", "x", "z"], "ENZ": ["x", "y", "z"], "PENZ": ["id", "x", "y", "z"], "PENZD": ["id", "x", "y", "z", "code"], "PNEZ": ["id", "y", "x", "z"], "PNEZD": ["id", "y", "x", "z", "code"], "XYZI": ["x", "y", "z", "intensity"], "XYZRGB": ["x", "y", "z", "red", "green", "blue"]}


def _fields(lines: DataFrame) -> DataFrame:
    """Fields of each line that is neither blank nor a comment; the delimiter is the line's own."""
    text = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#') and not startswith(value, '//')")
    mark = F.when(F.contains("value", F.lit(",")), ",").when(F.contains("value", F.lit(";")), ";").when(F.contains("value", F.lit("\t")), "\t")
    return text.select(F.when(mark.isNotNull(), F.transform(F.split("value", "[,;\\t]"), lambda f: F.trim(f))).otherwise(F.split("value", r"\s+")).alias("f"))


def _typed(fields: DataFrame, columns: list[str]) -> DataFrame:
    texts = {"id", "code"}
    cols = [F.get("f", F.lit(k)) if c in texts else F.get("f", F.lit(k)).cast("double") for k, c in enumerate(columns)]
    few = F.size("f") < len([c for c in columns if c != "code"])
    checked = fields.withColumn("f", F.when(few, F.raise_error(F.concat(F.lit("too few fields: "), F.array_join("f", " ")))).otherwise(F.col("f")))
    return checked.select(*[F.nullif(v, F.lit("")).alias(c) if c in texts else v.alias(c) for c, v in zip(columns, cols, strict=True)])


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """``x y z`` a line, any delimiter, comments and blank lines skipped; a short line raises."""
    return _typed(_fields(spark.read.text(path)), ["x", "y", "z"])


#: The names of survey columns in English and Spanish, without spaces, underscores and dashes.
SURVEY_ALIASES = {"id": ["id", "punto", "pto", "point", "pointid", "station"], "x": ["x", "este", "east", "easting"], "y": ["y", "norte", "north", "northing"], "z": ["z", "cota", "elevacion", "elevation", "elev", "level", "rl"], "code": ["code", "codigo", "descripcion", "description", "desc", "obs", "observacion", "feature"]}
#: Whole-number attributes and their bounds.
WHOLE = {"intensity": (0, 65535), "return_number": (0, 255), "number_of_returns": (0, 255), "classification": (0, 255), "user_data": (0, 255), "point_source_id": (0, 65535), "red": (0, 65535), "green": (0, 65535), "blue": (0, 65535)}


def attribute(name: str) -> str:
    """A column's name as attributes are looked up: lower case, underscores for spaces and dashes; known aliases give the attribute's own name."""
    plain = name.strip().lower().replace("-", "_").replace(" ", "_")
    bare = plain.replace("_", "")
    known = {a: c for c, names in ALIASES.items() for a in names} | {"r": "red", "g": "green", "b": "blue", "gpstime": "gps_time", "returnnumber": "return_number", "numberofreturns": "number_of_returns"}
    return known.get(bare, plain)


def sniff(spark: SparkSession, path: str, aliases: dict[str, list[str]] = ALIASES) -> tuple[str, list[str] | None]:
    """``(delimiter, header)`` by the first line that is neither blank nor a comment; a space stands for any whitespace.

    It is a header if x, y and z are all among its fields, under any alias; else the header is None.
    """
    first = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#') and not startswith(trim(value), '//')").limit(1).collect()
    if not first:
        return " ", None
    line = first[0][0].strip()
    mark = next((m for m in ",;\t" if m in line), " ")
    fields = [f.strip().strip('"') for f in (line.split() if mark == " " else line.split(mark))]
    known = {a: c for c, names in aliases.items() for a in names}
    named = {known.get(f.lower().replace(" ", "").replace("_", "").replace("-", "")) for f in fields}
    return mark, fields if {"x", "y", "z"} <= named else None


def whole_number(text: Column, low: int, high: int, name: str) -> Column:
    """An integer attribute; a value that is no number, not finite or out of bounds raises, an empty one is null."""
    said = F.when(F.trim(text) != "", F.trim(text))
    v = said.try_cast("double")
    sound = v.between(low, high) & ~F.isnan(v)
    wrong = F.raise_error(F.concat(F.lit(f"{name} out of range: "), said)).cast("int")
    return F.when(sound, v.cast("int")).otherwise(F.when(said.isNotNull(), wrong))


def read_table(spark: SparkSession, path: str, header: list[str] | None = None, delimiter: str | None = None) -> DataFrame:
    """Delimited text with the columns that its header (or ``header``) names.

    x, y, z, nx, ny, nz and gps_time are doubles, known whole-number attributes are checked integers; another column is whole,
    decimal or text for the whole file, the first of these that every value fits.  red, green and blue become ``color``, nx, ny and
    nz ``normal``.  Rows with too few fields raise.
    """
    mark, found = sniff(spark, path)
    mark = delimiter or mark
    names = header or found
    if names is None:
        raise ValueError(f"{path}: no header with x, y and z, and none given")
    columns = [attribute(n) for n in names]
    text = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#') and not startswith(value, '//')")
    fields = text.select((F.split("value", r"\s+") if mark == " " else F.transform(F.split("value", f"[{mark}]"), lambda v: F.trim(v))).alias("f"))
    if found is not None:
        same = F.array(*[F.lit(n) for n in found])
        fields = fields.where(F.transform("f", lambda v: F.btrim(v, F.lit('"'))) != same)
    short = F.raise_error(F.concat(F.lit("too few fields: "), F.array_join("f", " "))).cast("array<string>")
    rows = fields.withColumn("f", F.when(F.size("f") < len(columns), short).otherwise(F.col("f"))).select(*[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(columns)])
    real = {"x", "y", "z", "nx", "ny", "nz", "gps_time"}
    other = [c for c in columns if c not in real and c not in WHOLE]
    kinds = {}
    if other:
        fits = rows.agg(*[F.every(F.coalesce(F.col(c).try_cast(kind).isNotNull() | (F.col(c) == ""), F.lit(True))).alias(f"{c}_{kind}") for c in other for kind in ("int", "double")]).first()
        kinds = {c: next((kind for kind in ("int", "double") if fits[f"{c}_{kind}"]), "string") for c in other}
    typed = rows.select(*[whole_number(F.col(c), *WHOLE[c], c).alias(c) if c in WHOLE else F.when(F.col(c) != "", F.col(c)).cast("double" if c in real else kinds[c]).alias(c) for c in columns])
    for name, parts in (("color", ["red", "green", "blue"]), ("normal", ["nx", "ny", "nz"])):
        if set(parts) <= set(columns):
            typed = typed.withColumn(name, F.struct(*parts)).drop(*parts)
    return typed


def read_survey(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A headerless survey file; whatever the layout's order, columns come as id, x, y, z and then the rest."""
    columns = LAYOUTS[layout]
    order = ["id", "x", "y", "z"]
    return _typed(_fields(spark.read.text(path)), columns).select(*[c for c in order if c in columns], *[c for c in columns if c not in order])


def read_survey_table(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ord, id, x, y, z, code)`` of survey files with a header in English or Spanish; fields may be quoted.

    Points without an id, and those of a file without such a column, are numbered from 1 in the file's order; an empty code is null.
    """
    mark, header = sniff(spark, path, SURVEY_ALIASES)
    if header is None:
        raise ValueError(f"{path}: no header with x, y and z")
    known = {a: c for c, names in SURVEY_ALIASES.items() for a in names}
    columns = [known.get(f.lower().replace(" ", "").replace("_", "").replace("-", "")) or f"_{k}" for k, f in enumerate(header)]
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '#') and not startswith(value, '//')")
    schema = ", ".join(f"`{c}` string" for c in columns)
    plain = F.regexp_replace("value", r"\s+", " ") if mark == " " else F.col("value")
    rows = lines.withColumn("r", F.from_csv(plain, schema, {"sep": mark, "quote": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))
    body = rows.where(F.lower("r.x") != F.lit(header[columns.index("x")].lower()))
    place = F.row_number().over(Window.partitionBy("path", F.expr("line div 100000")).orderBy("line"))
    counted = body.withColumns({"_part": F.expr("line div 100000"), "_k": place})
    sizes = counted.groupBy("path", "_part").agg(F.count("*").alias("_n"))
    before = sizes.select("path", "_part", (F.sum("_n").over(Window.partitionBy("path").orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = counted.join(before, ["path", "_part"]).withColumn("ord", F.col("_before") + F.col("_k"))
    number = {c: F.col(f"r.{c}").cast("double").alias(c) for c in "xyz"}
    text = {c: F.nullif(F.trim(f"r.{c}"), F.lit("")) if c in columns else F.lit(None).cast("string") for c in ("id", "code")}
    return numbered.select("path", "ord", F.coalesce(text["id"], F.col("ord").cast("string")).alias("id"), *number.values(), text["code"].alias("code"))


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV; known columns under any alias are doubles, the rest stays text.  Without a header the first three columns are x, y and z."""
    raw = spark.read.option("header", header).csv(path)
    if not header:
        raw = raw.withColumnsRenamed(dict(zip(raw.columns[:3], "xyz", strict=False)))
    known = {a: name for name, names in ALIASES.items() for a in names}
    out = []
    for c in raw.columns:
        name = known.get(c.lower().replace(" ", "").replace("_", "").replace("-", ""))
        out.append(F.col(f"`{c}`").cast("double").alias(name) if name else F.col(f"`{c}`"))
    return raw.select(*out)


def read_pts(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and, where lines have them, intensity, red, green and blue.  The first line is the number of points; a first line
    that is no such number, or another number of lines, raises."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where("value <> ''")
    head = lines.orderBy("line").limit(1).collect()
    if not head or not head[0]["value"].isdigit():
        raise ValueError("the file doesn't begin with its number of points")
    rest = _fields(lines.where(F.col("line") > head[0]["line"]))
    width = rest.agg(F.min(F.size("f")).alias("low"), F.count("*").alias("n")).first()
    if int(head[0]["value"]) != width["n"]:
        raise ValueError("the declared number of points does not match")
    points = _typed(rest, ["x", "y", "z", *(["intensity"] if (width["low"] or 0) in (4, 7) else [])])
    if (width["low"] or 0) >= 6:
        first = width["low"] - 3
        colours = [F.get("f", F.lit(first + k)).cast("int").alias(c) for k, c in enumerate(("red", "green", "blue"))]
        has = ["intensity"] if width["low"] == 7 else []
        points = rest.select(*[F.get("f", F.lit(k)).cast("double").alias(c) for k, c in enumerate(["x", "y", "z", *has])], *colours)
    return points
